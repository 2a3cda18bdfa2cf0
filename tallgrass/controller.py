"""The adaptive controller: growing samples until every cell of the result is inside the error target.

Looks of one run are nested (one seed), and each look's intervals share the error rate by the harmonic rule; the union bound
does not mind that looks depend on each other. A result that may miss groups is labelled, never hidden.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.quantiles import adjusted_level
from tallgrass.operators import cluster, estimators, joins, sampling
from tallgrass.plans.frontend import AqpQuery, finish
from tallgrass.sequential import Sequential
from tallgrass.sources.tables import Populations, below_views, leaves_of


@dataclass(frozen=True)
class Mode:
    ladder: tuple[float, ...]
    threshold: float
    seconds: float


#: Sample ladders, error thresholds and time budgets of the modes.
MODES = {
    "fast": Mode((0.01, 0.05, 0.10), 0.08, 0.75),
    "balanced": Mode((0.01, 0.05, 0.10, 0.25, 0.50), 0.04, 1.5),
    "accurate": Mode((0.02, 0.08, 0.15, 0.30, 0.60, 1.00), 0.02, 3.0),
}
#: Ladders and least seconds by complexity class; class borders by score.
COMPLEXITY = {"simple": ((0.005, 0.01, 0.02, 0.05), 3.0), "medium": ((0.01, 0.03, 0.05, 0.10, 0.20), 6.0), "complex": ((0.02, 0.05, 0.10, 0.20, 0.40, 0.60), 12.0)}
SIMPLE_TO, MEDIUM_TO = 4, 10
#: Highest rung by accuracy target, and all rungs.
RUNG_FROM = ((98.0, 1.00), (95.0, 0.75), (90.0, 0.50), (85.0, 0.25), (0.0, 0.10))
RUNGS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 1.00)
#: Growth of the fraction by (pseudo-)confidence in percent.
GROWTH = ((50, 4.0), (70, 2.0), (90, 1.5), (math.inf, 1.25))

#: Tables of fewer rows are read at once: up to there a scan is no slower than a look.
INCOMPLETE_LOOKS, GROUP_CEILING, LEAST_ROWS = 4, 50_000, 1_000_000
#: From so many files on a table is sampled by whole files: looks then read no more than their share of it.
FILES_FROM = 100
#: Up to so many groups the statistics of a look stand on the driver: one job a look, nothing is cached.
FEW_GROUPS = 500


def for_target(mode: str, target: float | None) -> Mode:
    """A mode's settings, or those that an accuracy target in percent asks for."""
    base = MODES.get(mode, MODES["balanced"])
    if target is None:
        return base
    target = min(99.9, max(50.0, float(target)))
    top = next(rung for least, rung in RUNG_FROM if target >= least)
    return Mode(tuple(r for r in RUNGS if r <= top), min(0.20, max(0.005, 1 - target / 100)), min(5.0, max(0.5, 0.6 + 4 * (target - 50) / 49.9)))


def target_error(mode: str, target: float | None) -> float:
    """Relative half width wanted of every cell."""
    return MODES.get(mode, MODES["balanced"]).threshold if target is None else min(0.5, max(0.005, 1 - target / 100))


def complexity(query: AqpQuery) -> str:
    score = 2 * len(query.keys) + len(query.order_by) + 2 * (query.where is not None) + 2 * len(query.aggs) + 4 * query.distinct
    score += 4 * len(query.joins) + 2 * sum(j.how != "inner" for j in query.joins) + 3 * (query.having is not None) + (query.limit is None)
    return "simple" if score <= SIMPLE_TO else "medium" if score <= MEDIUM_TO else "complex"


def next_fraction(fraction: float, confidence: float) -> float | None:
    """The following look's fraction, None after a full one."""
    if fraction >= 1:
        return None
    grown = min(1.0, fraction * next(g for border, g in GROWTH if confidence < border))
    return round(grown, 4) if round(grown, 4) > fraction else min(1.0, grown + 1e-4)


def pseudo_confidence(change: float, fraction: float) -> float:
    """Percent, from the change between two looks: only for results without intervals."""
    if math.isinf(change):
        return 0.0
    return round(0.8 * 100 * min(1.0, max(0.0, 1 - change)) + 0.2 * 100 * min(1.0, fraction), 2)


@dataclass
class Look:
    fraction: float
    rows: int
    seconds: float
    elapsed: float
    level: float | None = None
    width: float | None = None
    open_cells: int = 0
    groups: int = 0
    missing: bool = False
    ci_met: bool = False
    change: float | None = None


@dataclass
class Answer:
    """Estimates (wide), cells with intervals (long; None without), and how they came about."""

    wide: DataFrame
    cells: DataFrame | None
    reason: str
    looks: list[Look] = field(default_factory=list)
    complete: bool = True
    downgraded: str | None = None  #: why there are no intervals, where they were wanted
    held: list[DataFrame] = field(default_factory=list)  #: persisted statistics that the results are made of

    def close(self) -> None:
        """Free the statistics; results that are used afterwards are computed again."""
        for table in self.held:
            table.unpersist()

    def report(self) -> dict:
        last = self.looks[-1] if self.looks else None
        return {
            "approx": bool(last and last.fraction < 1), "stop_reason": self.reason, "fraction": last.fraction if last else 1.0, "looks": [asdict(x) for x in self.looks],
            "ci": self.cells is not None, "max_relative_half_width": last.width if last else 0.0, "groups_incomplete": not self.complete, "downgraded": self.downgraded,
        }


@dataclass(frozen=True)
class Seen:
    """What one look gives."""

    cells: DataFrame
    n: int
    groups: int
    table: DataFrame


def widened(query: AqpQuery, cells: DataFrame) -> DataFrame:
    """Cells as one row for each group, with the HAVING, ORDER BY and LIMIT of the statement."""
    keys = [F.col(k) for k in query.keys]
    values = [F.max(F.when(F.col("alias") == a.alias, F.col("estimate"))).alias(a.alias) for a in query.aggs]
    wide = cells.groupBy(*keys).agg(*values)
    return finish(query, wide.select(*(f"`{c}`" for c in query.columns) or ["*"]))


def exact(query: AqpQuery) -> DataFrame:
    rows = joins.joined(query.fact, query.joins)
    rows = rows if query.where is None else rows.where(query.where)
    out = joins.scaled(rows, [c.alias(k) for k, c in query.keys.items()], query.aggs, 1.0)
    return finish(query, out.select(*(f"`{c}`" for c in query.columns) or ["*"]))


class Controller:
    """``patience`` stretches the time budgets: a distributed look costs more than one in a single process."""

    def __init__(self, populations: Populations | None = None, clock: Callable[[], float] = time.perf_counter, patience: float = 10.0):
        self.populations, self.clock, self.patience = populations or Populations(), clock, patience

    # one look: cells, units of the sample (rows, blocks or files), groups, and the table behind the cells

    @staticmethod
    def kept(stats: DataFrame) -> tuple[DataFrame, pa.Table | None]:
        """Statistics that are computed once: of few groups a table on the driver (and its rows), else one that executors hold."""
        own = stats.limit(FEW_GROUPS + 1).toArrow()
        if len(own) <= FEW_GROUPS:
            return stats.sparkSession.createDataFrame(own, stats.schema), own
        return stats.persist(), None

    def row_cells(self, query: AqpQuery, fraction: float, total: int, level: float, seed: int) -> Seen:
        """A Bernoulli look at one table. The sample is counted and summed up in one pass; a full look lets the predicate
        into the scan."""
        keys = [c.alias(k) for k, c in query.keys.items()]
        if fraction >= 1:
            found, own = self.kept(estimators.statistics(query.fact, keys, query.aggs, query.where))
            n, groups, stats = total, len(own) if own is not None else found.count(), found
        else:
            rows = sampling.bernoulli(query.fact, fraction, seed).rows
            if query.subquery:  # cannot be counted beside the rows that it leaves out
                found, own = self.kept(estimators.statistics(rows, keys, query.aggs, query.where))
                n, groups = rows.count(), len(own) if own is not None else found.count()
                one = adjusted_level(level, max(1, groups) * len(query.aggs))
                return Seen(estimators.grid(found, list(query.keys), query.aggs, n, total, one), n, groups, found)
            found, own = self.kept(estimators.counted_statistics(rows, keys, query.aggs, query.where))
            if own is not None:
                n, groups = sum(own["n_bucket"].to_pylist()), sum(x > 0 for x in own["n_rows"].to_pylist())
            else:
                n, groups = found.agg(F.coalesce(F.sum("n_bucket"), F.lit(0)), F.count_if(F.col("n_rows") > 0)).first()
            stats = found.where("n_rows > 0") if keys else found
        one = adjusted_level(level, max(1, groups) * len(query.aggs))
        return Seen(estimators.grid(stats, list(query.keys), query.aggs, n, total, one, universe=query.universe), n, groups, found)

    def cluster_cells(self, query: AqpQuery, sample: sampling.Sample, m: int, total: int, level: float) -> Seen:
        """A look at whole blocks or files of the (first) table, m of total."""
        rows = joins.joined(sample.rows, query.joins)
        rows = rows if query.where is None else rows.where(query.where)
        keys = [c.alias(k) for k, c in query.keys.items()]
        totals = cluster.block_totals(rows, keys, query.aggs)
        summary, own = self.kept(cluster.block_summary(totals, list(query.keys), query.aggs))
        groups = len(own) if own is not None else summary.count()
        one = adjusted_level(level, max(1, groups) * len(query.aggs))
        return Seen(cluster.cluster_grid(summary, list(query.keys), query.aggs, m, total, one), m, groups, summary)

    def block_cells(self, query: AqpQuery, fraction: float, total: int, level: float, seed: int, block_rows: int) -> Seen:
        """Blocks of successive rows: for tables of few files, which are read as a whole."""
        sample = sampling.blocks(query.fact, fraction, block_rows, seed, total)
        m = sample.rows.select(sampling.BLOCK).distinct().count() if fraction < 1 else total
        return self.cluster_cells(query, sample, m, total, level)

    def file_cells(self, query: AqpQuery, fraction: float, total: int, level: float, seed: int) -> Seen:
        """Whole files: only those are read, and the predicate reaches their scan."""
        m = sampling.picked_files(query.fact, fraction, seed)[0] if fraction < 1 else total
        return self.cluster_cells(query, sampling.files(query.fact, fraction, seed), m, total, level)

    # the loop

    def run(
        self, query: AqpQuery, mode: str = "balanced", target: float | None = None, alpha: float = 0.05, seed: int = 1,
        block_rows: int = sampling.BLOCK_ROWS, on_look: Callable[[Look], None] | None = None, least_rows: int = LEAST_ROWS,
    ) -> Answer:
        """The answer within the target, as far as the mode's ladder and time budget go."""
        files = self.files(query.fact)
        by_file = files >= FILES_FROM
        total = files if by_file else self.populations.rows(query.fact)
        if query.distinct or (not by_file and total < least_rows):  # distinct values do not scale; small tables are read at once
            return Answer(exact(query), None, "single_pass", [Look(1.0, total, 0.0, 0.0)])
        if query.joins and not joins.interval_is_defensible(query.joins):
            return self.converge(query, mode, target, self.populations.rows(query.fact), seed, on_look)
        settings, kind = for_target(mode, target), complexity(query)
        wanted, (ladder, least_seconds) = target_error(mode, target), COMPLEXITY[kind]
        budget = self.patience * max(settings.seconds, least_seconds * joins.complexity_multiplier(query.joins))
        fraction, expected = ladder[0], None if by_file else self.expected_groups(query)
        if by_file:
            fraction = max(fraction, min(1.0, 2 * cluster.LEAST_BLOCKS / files))
        elif query.joins:
            fraction = max(fraction, joins.starting_rate(total, self.guessed_groups(query, total), len(query.joins)))
            blocks = sampling.count_blocks(query.fact, block_rows)
        began, looks, before, seen, recounted = self.clock(), [], None, None, False
        trace = Sequential(alpha, target=wanted)
        while True:
            level, start, last = trace.level(), self.clock(), seen
            try:
                if by_file:
                    seen = self.file_cells(query, fraction, total, level, seed)
                elif query.joins:
                    seen = self.block_cells(query, fraction, blocks, level, seed, block_rows)
                else:
                    seen = self.row_cells(query, fraction, total, level, seed)
                cells, n, groups = seen.cells, seen.n, seen.groups
                count, open_, width = estimators.widest(cells)
            except Exception as e:  # intervals that cannot be made do not fail the query; the answer says so
                answer = self.converge(query, mode, target, self.populations.rows(query.fact), seed, on_look)
                return replace(answer, downgraded=f"{type(e).__name__}: {str(e)[:200]}")
            finally:
                if last is not None:
                    last.table.unpersist()
            if not by_file and not query.joins and fraction < 1 and not recounted and abs(n - fraction * total) > 8 * math.sqrt(max(1.0, fraction * (1 - fraction) * total)):
                self.populations.clear()  # the table is not of the remembered size
                total, expected, recounted = self.populations.rows(query.fact), self.expected_groups(query), True
                continue
            missing = fraction < 1 and bool(query.keys) and (groups < expected if expected is not None else before is None or groups != before)
            few = (by_file or query.joins) and fraction < 1 and n < cluster.LEAST_BLOCKS
            met = trace.look(fraction, width if count and not open_ and not few else None)
            look = Look(fraction, n, self.clock() - start, self.clock() - began, level, width, open_, groups, missing, met)
            looks.append(look)
            if on_look:
                on_look(look)
            reason = self.stop(query, looks, budget)
            if reason is None:
                confidence = 0.0 if missing or not width else min(100.0, 100 * wanted / width)
                following = next_fraction(fraction, confidence)
                reason = "progression_exhausted" if following is None else None
            if reason:
                return Answer(widened(query, cells), cells, reason, looks, not missing, held=[seen.table])
            fraction, before = following, groups

    @staticmethod
    def files(fact: DataFrame) -> int:
        """Files of a table that can be sampled by them, 0 if it cannot."""
        leaves = leaves_of(fact._jdf.queryExecution().analyzed())
        if [leaf.getClass().getSimpleName() for leaf in leaves] != ["LogicalRelation"] or len(found := fact._jdf.inputFiles()) < FILES_FROM:
            return 0
        try:
            below_views(fact).select("_metadata.file_path")
        except AnalysisException:  # a view that computes more than columns
            return 0
        return len(found)

    def guessed_groups(self, query: AqpQuery, total: int) -> int:
        """About how many groups a join has: distinct values of each key in the table that owns it, never of the join."""
        groups = 1
        for key in query.keys.values():
            for table in (query.fact, *(j.table for j in query.joins)):
                try:
                    table.select(key)
                except AnalysisException:
                    continue
                groups *= max(1, joins.approximate_groups(table, [key]))
                break
        return min(groups, total)

    @staticmethod
    def stop(query: AqpQuery, looks: list[Look], budget: float) -> str | None:
        last = looks[-1]
        if last.ci_met and not last.missing:
            return "ci_within_target"
        if last.elapsed >= budget and len(looks) >= 2 and not last.missing:
            return "time_budget_exceeded"
        if last.missing and ((query.joins and last.groups >= GROUP_CEILING) or (not query.joins and len(looks) >= INCOMPLETE_LOOKS)):
            return "groups_incomplete"
        return None

    def expected_groups(self, query: AqpQuery) -> int | None:
        """Exact number of groups where it is cheap to know: one table, no predicate beyond NOT NULL of its keys."""
        if query.joins or not query.keys:
            return None
        text = query.where_text.replace("`", "").replace("(", "").replace(")", "").upper()
        allowed = {f"{k.upper()} IS NOT NULL" for k in query.keys}
        if text and not {p.strip() for p in text.split(" AND ")} <= allowed:
            return None
        fact = query.fact if query.where is None else query.fact.where(query.where)
        return self.populations.groups(fact, [c.alias(k) for k, c in query.keys.items()])

    def converge(self, query: AqpQuery, mode: str, target: float | None, total: int, seed: int, on_look=None) -> Answer:
        """Joins that allow no interval: scaled samples until two looks agree."""
        settings, (ladder, least_seconds) = for_target(mode, target), COMPLEXITY[complexity(query)]
        budget = self.patience * max(settings.seconds, least_seconds * joins.complexity_multiplier(query.joins))
        fraction = max(ladder[0], joins.RATE_FLOOR[min(len(query.joins), 3)])
        keys, began, looks, before = list(query.keys), self.clock(), [], None
        while True:
            start = self.clock()
            rows = joins.joined(sampling.bernoulli(query.fact, fraction, seed).rows, query.joins)
            rows = rows if query.where is None else rows.where(query.where)
            now = joins.scaled(rows, [c.alias(k) for k, c in query.keys.items()], query.aggs, fraction).persist()
            groups = now.count()
            change = math.inf if before is None else largest_change(before, now, keys, [a.alias for a in query.aggs])
            if before is not None:
                before.unpersist()
            look = Look(fraction, round(total * fraction), self.clock() - start, self.clock() - began, groups=groups, change=change)
            looks.append(look)
            if on_look:
                on_look(look)
            reason = "converged" if change <= settings.threshold else "time_budget_exceeded" if look.elapsed >= budget and len(looks) >= 2 else None
            following = next_fraction(fraction, pseudo_confidence(change, fraction))
            if reason is None and following is None:
                reason = "progression_exhausted"
            if reason:
                return Answer(finish(query, now.select(*(f"`{c}`" for c in query.columns) or ["*"])), None, reason, looks, fraction >= 1, held=[now])
            fraction, before = following, now


def largest_change(before: DataFrame, now: DataFrame, keys: list[str], values: list[str]) -> float:
    """Largest relative change of any value between two results; infinite where a group came or went."""
    a = before.select(*(F.col(k).alias(f"a_{k}") for k in (*keys, *values)), F.lit(1).alias("a_there"))
    b = now.select(*(F.col(k).alias(f"b_{k}") for k in (*keys, *values)), F.lit(1).alias("b_there"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    both = a.join(b, on, "full") if keys else a.crossJoin(b)  # two single rows
    infinite = F.lit(float("inf"))
    changes = []
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        relative = F.when(x == y, 0.0).when(x.isNull() & y.isNull(), 0.0).when(x.isNull() | y.isNull() | (x == 0), infinite).otherwise(F.abs(y - x) / F.abs(x))
        changes.append(F.when(F.col("a_there").isNull() | F.col("b_there").isNull(), infinite).otherwise(relative))
    found = both.agg(F.max(F.greatest(*changes, F.lit(0.0)))).first()[0]
    return found if found is not None else 0.0
