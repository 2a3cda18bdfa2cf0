"""Intervals cover where they should, and are known not to where they cannot."""

import pytest

from tallgrass import calibrate, policies
from tallgrass.operators.estimators import AVG, COUNT, SUM
from tallgrass.service import Engine


@pytest.mark.parametrize(("shape", "func"), [("normal", SUM), ("normal", AVG), ("lognormal", SUM), ("zero_inflated", SUM), ("offset", AVG)])
def test_coverage(spark, shape, func):
    assert not calibrate.study(spark, shape, func).is_short


def test_bounds_are_wider(spark):
    assert calibrate.study(spark, "lognormal", SUM, method="bernstein", trials=100).share >= calibrate.study(spark, "lognormal", SUM, trials=100).share


@pytest.mark.parametrize("func", [SUM, COUNT])
def test_groups_are_covered_together(spark, func):
    assert not calibrate.simultaneous(spark, "normal", func).is_short


@pytest.mark.parametrize("order", ["shuffled", "clustered", "banded"])
def test_block_samples_cover_whatever_the_layout(spark, order):
    assert not calibrate.study_blocks(spark, order).is_short


def test_wilson():
    low, high = calibrate.wilson(95, 100)
    assert low == pytest.approx(0.8882, abs=1e-3) and high == pytest.approx(0.9785, abs=1e-3)


def test_layouts(spark):
    df = calibrate.population(spark, "normal", 500)
    assert {r[0] for r in calibrate.laid_out(df, "clustered").select("place").collect()} == set(range(500))
    ordered = [r["x"] for r in calibrate.laid_out(df, "clustered").orderBy("place").collect()]
    assert ordered == sorted(ordered)


def test_refinement_ends(spark):
    spark.range(20_000).selectExpr("id % 2 as g", "rand(3) + 1 as x").persist().createOrReplaceTempView("two")
    answer = policies.refined(Engine(spark), "SELECT g, COUNT(*) AS c, AVG(x) AS a FROM two GROUP BY g", 0.1)
    assert answer.reason in ("bound_within_target", "progression_exhausted") and answer.wide.count() == 2
    with pytest.raises(ValueError):
        policies.refined(Engine(spark), "SELECT COUNT(*) AS c FROM two a JOIN two b ON a.g = b.g")
