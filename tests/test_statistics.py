"""Quantiles, estimators, cluster estimates, stopping, completeness."""

import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass import sequential
from tallgrass.functions import quantiles as q
from tallgrass.operators import cluster, completeness, estimators, joins, sampling
from tallgrass.operators.estimators import AVG, COUNT, SUM, Agg


@pytest.mark.parametrize(("level", "df", "value"), [(0.95, 1, 12.7062), (0.95, 2, 4.3027), (0.95, 5, 2.5706), (0.99, 10, 3.1693), (0.95, 30, 2.0423), (0.90, 120, 1.6577), (0.999, 4, 8.6103)])
def test_student_quantiles_match_published_tables(level, df, value):
    assert q.t_quantile(level, df) == pytest.approx(value, abs=6e-5)


def test_student_column_agrees_with_the_driver(spark):
    degrees = [1, 2, 3, 7, 60, 61, 100, 500, 1999, 2000, 10**6]
    rows = spark.createDataFrame([(d,) for d in degrees], "d long").select("d", q.t_column(0.99, F.col("d")).alias("t")).collect()
    for r in rows:
        assert r["t"] == pytest.approx(q.t_quantile(0.99, r["d"]), rel=1e-7)


def test_levels_and_alpha():
    assert q.adjusted_level(0.95, 10) == pytest.approx(0.995)
    assert q.adjusted_level(0.95, 10, "sidak") == pytest.approx(0.95**0.1)
    assert q.adjusted_level(0.95, 10, "none") == 0.95
    assert q.look_alpha(0.05, 1) == pytest.approx(0.025)
    assert 1 - q.look_alpha(0.05, 2) == pytest.approx(0.99167, abs=1e-5)
    assert sum(q.look_alpha(0.05, t) for t in range(1, 10_000)) < 0.05
    assert sum(q.look_alpha(0.05, t, 5) for t in range(1, 6)) == pytest.approx(0.05)
    with pytest.raises(ValueError):
        q.z_quantile(1.0)


def cells(spark, rows, func, n, total, **options):
    """Intervals of cells given by (n_domain, values)."""
    made = []
    for values in rows:
        x = np.array(values, float)
        d = len(x)
        var = float(x.var(ddof=1)) if d > 1 else None
        skew = float(((x - x.mean()) ** 3).mean() / x.std() ** 3 * math.sqrt(d * (d - 1)) / (d - 2)) if d > 2 and x.std() > 0 else None
        made.append((func, 1.0, False, d, float(x.sum()) if d else None, float((x**2).sum()) if d else None, float((x**3).sum()) if d else None, var, float(x.min()) if d else None, float(x.max()) if d else None, skew))
    schema = "func string, effect double, known boolean, n_domain long, sum_x double, sum_xx double, sum_xxx double, variance double, min_x double, max_x double, skewness double"
    return estimators.intervals(spark.createDataFrame(made, schema), n, total, **options).collect()


def test_all_samples_of_a_small_population_are_unbiased(spark):
    """Every sample of 5 of 8 rows, 4 of them in the domain: means of estimates and of variance estimates are exact."""
    population = [4.0, 7.0, 2.0, 11.0, None, None, None, None]
    samples = [[x for x in s if x is not None] for s in itertools.combinations(population, 5)]
    assert len(samples) == 56
    for func, truth in ((SUM, 24.0), (COUNT, 4.0)):
        got = cells(spark, samples, func, 5, 8, method="clt")
        values = [r["estimate"] for r in got]
        assert statistics.fmean(values) == pytest.approx(truth, abs=1e-9)
        variances = [r["variance"] for r in got]
        assert statistics.fmean(variances) == pytest.approx(statistics.pvariance(values), abs=1e-9)


def test_edges(spark):
    empty, full = cells(spark, [[], [1.0] * 100], COUNT, 100, 1000)
    assert empty["estimate"] == 0 and empty["ci_high"] == pytest.approx(1000 * -math.log(0.05) / 100) and empty["method"] == "rule_of_three"
    assert full["estimate"] == 1000 and full["ci_low"] == pytest.approx(1000 - empty["ci_high"])
    flat = cells(spark, [[0.0] * 50], SUM, 50, 500)[0]
    assert flat["half_width"] is None and flat["note"].startswith("degenerate") and flat["relative_half_width"] is None
    one = cells(spark, [[3.0]], AVG, 50, 500)[0]
    assert one["estimate"] == 3 and one["half_width"] is None and one["note"].startswith("undefined")
    census = cells(spark, [[1.0, 5.0]], SUM, 2, 2)[0]
    assert census["half_width"] == 0 and census["method"] == "census" and census["estimate"] == 6


def test_interval_methods_are_ordered_and_chosen(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(50, 12, 400)]
    widths = [cells(spark, [values], AVG, 1000, 100_000, method=m)[0]["half_width"] for m in ("clt", "bernstein", "hoeffding")]
    assert widths[0] < widths[1] and widths[0] < widths[2]
    assert cells(spark, [values], AVG, 1000, 100_000)[0]["method"] == "clt"
    skewed = [1.0] * 199 + [1e6]
    assert cells(spark, [skewed], SUM, 1000, 100_000)[0]["method"] == "bernstein"


@pytest.mark.parametrize(("func", "least"), [(SUM, 0.92), (COUNT, 0.92), (AVG, 0.92)])
def test_coverage_of_a_filtered_population(spark, func, least):
    rng = np.random.default_rng(5)
    population = rng.lognormal(3, 0.6, 12_000)
    inside = rng.random(12_000) < 0.35
    truth = {SUM: population[inside].sum(), COUNT: inside.sum(), AVG: population[inside].mean()}[func]
    picks = [rng.choice(12_000, 1200, replace=False) for _ in range(400)]
    got = cells(spark, [population[p][inside[p]].tolist() for p in picks], func, 1200, 12_000, method="clt")
    assert np.mean([r["ci_low"] <= truth <= r["ci_high"] for r in got]) >= least


def test_clustered_layout_is_seen_by_the_design_effect(spark):
    rng = np.random.default_rng(2)
    values = np.sort(rng.normal(100, 20, 20_000))
    effects = {}
    for name, x in (("sorted", values), ("shuffled", rng.permutation(values))):
        df = spark.createDataFrame([(i // 50, float(v)) for i, v in enumerate(x)], "b long, x double")
        sample = sampling.logical_blocks(df, F.col("b"), 200)
        m, n = sample.rows.agg(F.count_distinct(sampling.BLOCK), F.count("*")).first()
        agg = Agg(AVG, F.col("x"), "a")
        summary = cluster.block_summary(cluster.block_totals(sample.rows, [], [agg]), [], [agg])
        effects[name] = cluster.design_effects(summary, [], [agg], m, 400, n, 20_000).first()["design_effect"]
        cell = cluster.cluster_grid(summary, [], [agg], m, 400).first()
        assert cell["ci_low"] <= x.mean() <= cell["ci_high"]
    assert effects["sorted"] > 10 and 0.5 < effects["shuffled"] < 2
    assert cluster.projected_effect(0.0, 64) == 1


def test_cluster_census_and_single_block(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, None)], "__block long, x double")
    aggs = [Agg(SUM, F.col("x"), "s"), Agg(COUNT, F.col("x"), "c")]
    summary = cluster.block_summary(cluster.block_totals(df, [], aggs), [], aggs)
    whole = {r["alias"]: r for r in cluster.cluster_grid(summary, [], aggs, 2, 2).collect()}
    assert whole["s"]["estimate"] == 3 and whole["s"]["half_width"] == 0 and whole["c"]["estimate"] == 2
    assert all(r["half_width"] is None for r in cluster.cluster_grid(summary, [], aggs, 1, 5).collect())


def test_lost_precision_is_noted(spark):
    """Values of a billion plus or minus one: the raw sums lose the variance, the sample variance does not, and the cell says so."""
    agg = Agg(AVG, F.col("x"), "a")
    for base, noted in ((1e9, True), (10.0, False)):
        df = spark.range(1000).select((F.lit(base) + F.col("id") % 3 - 1).alias("x"))
        cell = estimators.grid(estimators.statistics(df, [], [agg]), [], [agg], 1000, 10_000).first()
        assert (cell["note"] == "precision: raw sums cancel") is noted and cell["half_width"] == pytest.approx(0.048, rel=0.05)


def test_sequential():
    run = sequential.Sequential(target=0.05)
    assert run.level() == pytest.approx(0.975)
    assert not run.look(0.01, 0.2) and not run.look(0.04, 0.01, complete=False) and run.look(0.1, 0.04)
    assert run.summary()["stopped"] and run.spent() < 0.05
    with pytest.raises(ValueError):
        run.look(0.05, 0.1)
    assert sequential.price_of_peeking(0.05, 5) > 1


def test_samples_are_nested_and_blocks_whole(spark):
    df = spark.range(0, 20_000, numPartitions=4)
    small, large = (set(r[0] for r in sampling.by_hash(df, f, "id").rows.collect()) for f in (0.05, 0.2))
    assert small < large and 0.15 < len(large) / 20_000 < 0.25
    a, b = (set(r[0] for r in sampling.bernoulli(df, f, 3).rows.collect()) for f in (0.05, 0.2))
    assert a < b
    picked = sampling.blocks(df, 0.3, 100)
    assert picked.total_blocks == 200
    assert {r["count"] for r in picked.rows.groupBy(sampling.BLOCK).count().collect()} == {100}
    with pytest.raises(ValueError):
        sampling.bernoulli(df, 0)


def test_completeness(spark):
    rows = spark.createDataFrame([(i // 100,) for i in range(1000)] + [(100 + i,) for i in range(5)], "g int")
    found = completeness.assess(rows, ["g"])
    assert (found.observed, found.singletons, found.doubletons) == (15, 5, 0) and found.chao1 == 15 + 5 * 4 / 2
    assert not found.is_complete and completeness.assess(rows, ["g"], 15).is_complete
    nothing = completeness.assess(rows.where("g < 0"), ["g"])
    assert nothing.coverage == 0 and not nothing.is_complete


def test_sketches_and_join_rules(spark):
    df = spark.range(20_000).withColumn("k", F.col("id") % 10_000)
    assert joins.hll(df, "k").first()[0] == pytest.approx(10_000, rel=0.02)
    bloom = joins.Bloom(df, "k", 10_000)
    kept = bloom.reduced(spark.range(40_000).withColumnRenamed("id", "k"), "k")
    assert kept.where("k < 10000").count() == 10_000 and kept.where("k >= 10000").count() <= 900
    assert bloom.might_contain(77) and 90_000 < bloom.bits < 100_000
    with pytest.raises(ValueError):
        joins.Bloom(df, "k", 10**9)
    assert joins.Bloom(df.where("false"), "k", 0).reduced(df, "k").count() == 0
    few, all_ = df.where("k < 100").select(F.col("k").alias("a")).distinct(), df.select(F.col("k").alias("b")).distinct()
    reduced, how = joins.two_phase(df, [(all_, "k", "b"), (few, "k", "a")], pilot=0.2)
    assert [(r.key, r.by) for r in how] == [("k", "bloom"), ("k", "none")] and how[0].selectivity < 0.05 and 200 <= reduced.count() <= 800
    assert joins.starting_rate(10**6, 10, 2) == 0.07 and joins.starting_rate(1000, 100, 1) == 0.60
    one = joins.Join(df, F.lit(True), "inner", "a = b", True)
    assert joins.complexity_multiplier([one]) == 2 and joins.complexity_multiplier([one] * 2) == 3.5
    assert joins.interval_is_defensible([one]) and not joins.interval_is_defensible([joins.Join(df, F.lit(True), "left", "a = b", True)])
    assert not joins.interval_is_defensible([joins.Join(df, F.lit(True), "inner", "a >= b")])
    assert joins.interval_is_defensible([joins.Join(df, F.lit(True), "left", "a > b")], wide=True)
    assert joins.selectivity(df, df.where("k < 1000").select("k"), "k") == pytest.approx(0.1)
    graph = joins.JoinGraph({"fact": 1e6, "dim": 100.0, "tiny": 5.0}, {("fact", "dim"): (100.0, 100.0), ("dim", "tiny"): (5.0, 5.0)})
    assert [t for t, _ in graph.order()] == ["tiny", "dim", "fact"]
    a = spark.range(1000).withColumn("k", F.col("id") % 100)
    assert joins.sampled_cardinality(a, spark.range(100).withColumnRenamed("id", "k"), "k", 1.0, 1.0) == 1000


def test_predicted_size():
    assert estimators.predicted_sample_size(100, 0.2, 0.1) == 400 and estimators.predicted_sample_size(100, 0.05, 0.1) == 100
