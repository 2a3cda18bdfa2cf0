"""Sampling policies to compare the controller with, and how answers are scored."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.controller import COMPLEXITY, Answer, Controller, Look, complexity, exact, largest_change, widened
from tallgrass.functions.quantiles import adjusted_level
from tallgrass.operators import estimators, joins, sampling
from tallgrass.plans.frontend import AqpQuery, finish
from tallgrass.service import Engine, mean_relative_error
from tallgrass.session import new_path
from tallgrass.sources.tables import data_version


def _scaled(query: AqpQuery, fraction: float, seed: int = 1) -> DataFrame:
    rows = joins.joined(sampling.bernoulli(query.fact, fraction, seed).rows, query.joins)
    rows = rows if query.where is None else rows.where(query.where)
    return joins.scaled(rows, [c.alias(k) for k, c in query.keys.items()], query.aggs, fraction)


def exact_policy(engine: Engine, sql: str) -> Answer:
    query = engine.parse(sql)
    return Answer(exact(query), None, "exact", [Look(1.0, engine.populations.rows(query.fact), 0.0, 0.0)])


def fixed_fraction(engine: Engine, sql: str, fraction: float = 0.05, seed: int = 1) -> Answer:
    """One sample, scaled, no interval."""
    query = engine.parse(sql)
    return Answer(finish(query, _scaled(query, fraction, seed)), None, "fixed_fraction", [Look(fraction, 0, 0.0, 0.0)], False)


def online(engine: Engine, sql: str, fraction: float = 0.10, seed: int = 1) -> Answer:
    """One pass over a tenth, its running totals scaled when the pass ends."""
    query = engine.parse(sql)
    rows = round(fraction * engine.populations.rows(query.fact))
    return Answer(finish(query, _scaled(query, fraction, seed)), None, "online_single_pass", [Look(fraction, rows, 0.0, 0.0)], False)


def ladder(engine: Engine, sql: str, fractions: tuple[float, ...] = (0.01, 0.05, 0.10, 0.25, 0.50, 1.0), threshold: float = 0.04, seed: int = 1) -> Answer:
    """Scaled samples up a ladder until two successive ones agree."""
    query, before, looks = engine.parse(sql), None, []
    for fraction in fractions:
        now = _scaled(query, fraction, seed).persist()
        change = float("inf") if before is None else largest_change(before, now, list(query.keys), [a.alias for a in query.aggs])
        if before is not None:
            before.unpersist()
        looks.append(Look(fraction, 0, 0.0, 0.0, change=change))
        if change <= threshold:
            return Answer(finish(query, now), None, "converged", looks, fraction >= 1, held=[now])
        before = now
    return Answer(finish(query, now), None, "progression_exhausted", looks, fractions[-1] >= 1, held=[now])


def geometric(engine: Engine, sql: str, first: float = 0.01, factor: float = 2.0, threshold: float = 0.04, seed: int = 1) -> Answer:
    fractions = [first]
    while fractions[-1] < 1:
        fractions.append(min(1.0, fractions[-1] * factor))
    return ladder(engine, sql, tuple(fractions), threshold, seed)


_drawn: dict[tuple, tuple[DataFrame, float, int]] = {}


def static_sample(fact: DataFrame, draw: Callable[[DataFrame], sampling.Sample], name: str) -> tuple[DataFrame, float, int]:
    """A sample that is drawn once, written to the shared folder and kept until the table's files change: rows, fraction, size."""
    spark, key = fact.sparkSession, (name, data_version(fact)[0])
    if key not in _drawn:
        sample, path = draw(fact), new_path(fact.sparkSession, "static-sample")
        sample.rows.write.parquet(path)
        rows = spark.read.schema(sample.rows.schema).parquet(path)
        _drawn[key] = rows, sample.fraction, rows.count()
    return _drawn[key]


def static_ci(engine: Engine, sql: str, fraction: float = 0.05, level: float = 0.95, seed: int = 1, draw: Callable[[DataFrame], sampling.Sample] | None = None, name: str = "") -> Answer:
    """One kept sample of a fixed size with intervals, whatever their width. ``draw``, called ``name``, replaces the Bernoulli
    draw."""
    query = engine.parse(sql)
    rows, fraction, n = static_sample(query.fact, draw or (lambda df: sampling.bernoulli(df, fraction, seed)), name or f"{fraction}:{seed}")
    keys = [c.alias(k) for k, c in query.keys.items()]
    # the kept rows go by the table's own name
    stats = estimators.statistics(rows.alias(query.name) if query.name else rows, keys, query.aggs, query.where).persist()
    groups = stats.count()
    one = adjusted_level(level, max(1, groups) * len(query.aggs))
    cells = estimators.grid(stats, list(query.keys), query.aggs, n, engine.populations.rows(query.fact), one, universe=query.universe)
    return Answer(widened(query, cells), cells, "static", [Look(fraction, n, 0.0, 0.0, level, groups=groups)], False, held=[stats])


def adaptive(engine: Engine, sql: str, mode: str = "balanced", target: float | None = None) -> Answer:
    return engine.approximate(sql, mode, target)


def online_with_intervals(engine: Engine, sql: str, target: float = 0.05, level: float = 0.95, seed: int = 1) -> Answer:
    """The controller's ladder with intervals at the nominal level at each look: stops sooner, and covers less than it says."""
    query, looks, last = engine.parse(sql), [], None
    total = engine.populations.rows(query.fact)
    for fraction in (*COMPLEXITY[complexity(query)][0], 1.0):
        seen = Controller(engine.populations).row_cells(query, fraction, total, level, seed)
        count, open_, width = estimators.widest(seen.cells)
        if last is not None:
            last.table.unpersist()
        last = seen
        looks.append(Look(fraction, seen.n, 0.0, 0.0, level, width, open_, seen.groups))
        if count and not open_ and width is not None and width <= target:
            return Answer(widened(query, seen.cells), seen.cells, "ci_within_target", looks, held=[seen.table])
    return Answer(widened(query, last.cells), last.cells, "progression_exhausted", looks, held=[last.table])


POLICIES: dict[str, Callable[..., Answer]] = {
    "exact": exact_policy, "fixed_fraction": fixed_fraction, "geometric": geometric, "fixed_ladder": ladder, "online_agg": online,
    "static_ci": static_ci, "ola": online_with_intervals, "adaptive": adaptive,
}


@dataclass
class Score:
    policy: str
    seconds: float
    fraction: float
    reason: str
    mean_relative_error: float | None
    covered: float | None  #: share of cells whose interval holds the truth
    grid_covered: bool | None  #: whether all do


def coverage(cells: DataFrame, true: DataFrame, keys: list[str], values: list[str]) -> tuple[float | None, bool | None]:
    """Share of cells whose interval holds the exact value (a cell without interval does not), and whether all do."""
    truth = true.select(*(F.col(k).alias(f"t_{k}") for k in keys), F.explode(F.array(*(F.struct(F.lit(v).alias("t_alias"), F.col(v).cast("double").alias("truth")) for v in values))).alias("x"))
    truth = truth.select(*(f"t_{k}" for k in keys), "x.t_alias", "x.truth")
    on = F.col("alias") == F.col("t_alias")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    slack = 1e-9 * F.abs("truth")
    held = F.coalesce((F.col("ci_low") <= F.col("truth") + slack) & (F.col("truth") <= F.col("ci_high") + slack), F.lit(False)).cast("int")
    row = cells.join(truth, on).agg(F.avg(held), F.min(held)).first()
    return row[0], None if row[1] is None else bool(row[1])


def score(engine: Engine, sql: str, policies: dict[str, Callable[..., Answer]] = POLICIES) -> list[Score]:
    """Each policy's answer against the exact one."""
    query = engine.parse(sql)
    keys, values = list(query.keys), [a.alias for a in query.aggs]
    true, out = exact(query).persist(), []
    for name, policy in policies.items():
        began = time.perf_counter()
        answer = policy(engine, sql)
        wide = answer.wide.persist()
        wide.count()
        seconds = time.perf_counter() - began
        held, grid = coverage(answer.cells, true, keys, values) if answer.cells is not None else (None, None)
        out.append(Score(name, seconds, answer.looks[-1].fraction, answer.reason, mean_relative_error(true, wide, keys, values), held, grid))
        wide.unpersist()
        answer.close()
    true.unpersist()
    return out


def refined(engine: Engine, sql: str, target: float = 0.05, level: float = 0.95, first: float = 0.01, factor: float = 2.5, seed: int = 1) -> Answer:
    """Growing samples under the simple bounds (Hoeffding for COUNT and SUM, normal means), up to a full scan; no joins."""
    query = engine.parse(sql)
    if query.joins:
        raise ValueError("the simple bounds do not hold for joins")
    keys, looks, fraction = [c.alias(k) for k, c in query.keys.items()], [], first
    while True:
        stats = estimators.statistics(sampling.bernoulli(query.fact, fraction, seed).rows, keys, query.aggs, query.where).persist()
        widths = []
        for a in query.aggs:
            n, c = F.col(a.alias)["n_domain"], F.col(a.alias)
            if a.func == "count":
                widths.append(estimators.bounded_count(n, fraction, level) / (n / fraction))
            elif a.func == "sum":
                widths.append(estimators.bounded_sum(n, c["min_x"], c["max_x"], fraction, level) / F.abs(c["sum_x"] / fraction))
            else:
                widths.append(estimators.normal_mean(F.sqrt(c["variance"]), n, level) / F.abs(c["sum_x"] / n))
        worst = stats.agg(*(F.max(w) for w in widths), *(F.coalesce(F.max(w.isNull().cast("int")), F.lit(1)) for w in widths)).first()
        width = None if any(worst[len(widths) :]) else max(worst[: len(widths)])
        looks.append(Look(fraction, 0, 0.0, 0.0, level, 0.0 if fraction >= 1 else width))
        stats.unpersist()
        if fraction >= 1 or (width is not None and width <= target):
            wide = finish(query, joins.scaled(stats_rows(query, fraction, seed), keys, query.aggs, fraction))
            return Answer(wide, None, "bound_within_target" if fraction < 1 else "progression_exhausted", looks, fraction >= 1)
        fraction = min(1.0, fraction * factor)


def stats_rows(query: AqpQuery, fraction: float, seed: int) -> DataFrame:
    rows = sampling.bernoulli(query.fact, fraction, seed).rows
    return rows if query.where is None else rows.where(query.where)
