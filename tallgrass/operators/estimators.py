"""Sufficient statistics and estimators with confidence intervals, as column expressions.

``statistics`` takes one pass over a sample: one row for each group, one struct for each aggregate. ``grid`` turns it into
one row for each cell (group x aggregate) with estimate and interval. Everything stays in Spark; the driver sees only counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.quantiles import t_column, t_sql

COUNT, SUM, AVG = "count", "sum", "avg"

#: A skewed cell needs this many rows for each unit of squared skewness before a normal interval is trusted.
ROWS_PER_SKEW = 100
#: Variance of a block sample against a row sample where it is not measured.
BLOCK_EFFECT = 1.75
EFFECT_RANGE = (1.0, 12.0)
#: Sum of squares left after taking off the mean, relative to before, under which precision is doubtful.
CANCELLED = 1e-10


@dataclass(frozen=True)
class Agg:
    """An aggregate: ``func`` of ``expr`` (None: of rows), named ``alias``."""

    func: str
    expr: Column | None
    alias: str
    distinct: bool = False  #: over distinct values: exact only, no sample tells

    def __post_init__(self):
        if self.func not in (COUNT, SUM, AVG):
            raise ValueError(f"{self.func} has no sampled estimator")
        if self.expr is None and self.func != COUNT:
            raise ValueError("only COUNT takes rows")


def plain_aggregate(agg: Agg) -> Column:
    """The aggregate itself, over all rows."""
    if agg.expr is None:
        return F.count(F.lit(1))
    if agg.func == COUNT:
        return F.count_distinct(agg.expr) if agg.distinct else F.count(agg.expr)
    x = agg.expr.cast("double")
    if agg.func == AVG:
        return F.sum_distinct(x) / F.count_distinct(x) if agg.distinct else F.avg(x)
    return F.sum_distinct(x) if agg.distinct else F.sum(x)


def default_alias(func: str, text: str | None) -> str:
    """Name of an aggregate without one: ``sum_l_quantity``, ``count_all``."""
    words = "".join(c if c.isalnum() else " " for c in (text or "")).split()
    return f"{func}_{'_'.join(words).lower() if words else 'all'}"


def unbiased_skewness(column: Column) -> Column:
    """Sample skewness corrected for its size (Spark's own is that of the population)."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


STATISTICS = ("n_domain", "sum_x", "sum_xx", "sum_xxx", "variance", "min_x", "max_x", "skewness")


def cell_statistics(agg: Agg, where: Column | None) -> Column:
    """Struct of the sufficient statistics of one aggregate over the rows of a group inside the predicate."""
    if agg.expr is None:
        inside = F.lit(1) if where is None else F.when(where, 1)
        n, zero = F.count(inside), F.lit(None).cast("double")
        return F.struct(n.alias("n_domain"), *(zero.alias(k) for k in STATISTICS[1:]))
    if agg.func == COUNT:  # non-null values of any type
        inside = agg.expr if where is None else F.when(where, agg.expr)
        zero = F.lit(None).cast("double")
        return F.struct(F.count(inside).alias("n_domain"), *(zero.alias(k) for k in STATISTICS[1:]))
    x = agg.expr.cast("double")
    x = x if where is None else F.when(where, x)
    return F.struct(
        F.count(x).alias("n_domain"), F.sum(x).alias("sum_x"), F.sum(x * x).alias("sum_xx"), F.sum(x * x * x).alias("sum_xxx"),
        F.var_samp(x).alias("variance"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), unbiased_skewness(x).alias("skewness"),
    )


def statistics(rows: DataFrame, keys: list[Column], aggs: list[Agg], where: Column | None = None) -> DataFrame:
    """Group keys, ``n_rows`` (inside the predicate) and one struct for each aggregate.

    The size of the sample before the predicate belongs to the design and is counted apart, so the predicate is free to be
    pushed into the scan; groups without a row inside it never arise.
    """
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *(cell_statistics(a, None).alias(a.alias) for a in aggs))


def filtered_statistics(rows: DataFrame, keys: list[Column], aggs: list[Agg], where: Column) -> DataFrame:
    """The same with the predicate inside the aggregates, so that ``n_bucket`` counts the rows before it; one pass, no pushdown."""
    out = counted_statistics(rows, keys, aggs, where)
    return out.where("n_rows > 0") if keys else out


def counted_statistics(rows: DataFrame, keys: list[Column], aggs: list[Agg], where: Column | None) -> DataFrame:
    """The same with the groups that have no row inside the predicate: ``n_bucket`` adds up to the size of the sample."""
    inside = F.count("*") if where is None else F.count(F.when(where, 1))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_bucket"), inside.alias("n_rows"), *(cell_statistics(a, where).alias(a.alias) for a in aggs))


FIELDS = ("estimate", "variance", "df", "ci_low", "ci_high", "half_width", "relative_half_width", "method", "note")


def only(func: str, funcs: set[str] | None) -> Column:
    """Whether a cell is of this function; a literal where the functions at hand settle it, so that the optimizer drops the
    branches of the others."""
    if funcs is None or (func in funcs and len(funcs) > 1):
        return F.col("func") == func
    return F.lit(func in funcs)


def intervals(cells: DataFrame, n: int, total: int, level: float = 0.95, method: str | None = None, funcs: set[str] | None = None) -> DataFrame:
    """Rows with ``func``, ``effect`` (design effect), ``known`` (a COUNT of the whole table) and the statistics of a cell, with
    ``FIELDS`` added. n, total: rows of the sample and of the population; ``method``: "clt", "bernstein", "hoeffding", or None
    to choose for each cell; ``funcs``: all functions at hand, if known. The work is laid out in steps, so that each expression
    is evaluated once.
    """
    # as SQL text: some dozens of expressions are parsed here, where building them piece by piece takes thousands of calls
    f, rest, whole, census = n / total if total else 1.0, max(0.0, 1 - n / total) if total else 0.0, float(total), n >= total
    is_count, is_sum = (f"(func = '{k}')" if funcs is None or (k in funcs and len(funcs) > 1) else str(k in funcs) for k in (COUNT, SUM))
    nothing = "CAST(NULL AS DOUBLE)"
    size, share = (number(x) if x else nothing for x in (n, f))
    d, three = "__d", number(math.log(3 / (1 - level)))
    by_sign = lambda one, two, other: f"CASE WHEN {is_count} THEN {one} WHEN {is_sum} THEN {two} ELSE {other} END"
    totals = f"({is_count} OR {is_sum})"
    m1, m2, m3 = (f"({k} / {size})" for k in ("sum_x", "sum_xx", "sum_xxx"))
    second = f"({m2} - {m1} * {m1})"
    expanded = f"CASE WHEN {d} > 0 THEN (coalesce(__ss, 0D) + sum_x * sum_x * ({size} - {d}) / ({d} * {size})) / ({size} - 1) END"
    skewed = f"CASE WHEN {second} > 0 AND {size} > 2 THEN ({m3} - 3 * {m1} * {m2} + 2 * {m1} * {m1} * {m1}) / pow({second}, 1.5D) * sqrt({size} * ({size} - 1)) / ({size} - 2) END"
    steps = cells.withColumn("__d", F.expr("CAST(n_domain AS DOUBLE)"))
    steps = steps.withColumn("__ss", F.expr(f"coalesce(({d} - 1) * variance, CASE WHEN {d} > 0 THEN greatest(0D, sum_xx - sum_x * sum_x / {d}) END)"))
    steps = steps.withColumns({k: F.expr(v) for k, v in {
        "__spread": by_sign("1D", "greatest(0D, max_x) - least(0D, min_x)", "max_x - min_x"),
        "__var": by_sign(f"{size} * ({d} / {size}) * (1 - {d} / {size}) / ({size} - 1)" if n > 1 else nothing, expanded if n > 1 else nothing, f"CASE WHEN {d} >= 2 THEN __ss / ({d} - 1) END"),
        "__skew": by_sign(nothing, skewed, "skewness"),
        "__rows": f"CASE WHEN {totals} THEN {size} ELSE {d} END",
        "estimate": by_sign(f"{d} / {share}", f"sum_x / {share}", f"CASE WHEN {d} > 0 THEN sum_x / {d} END"),
    }.items()})
    spread_of_mean = f"CASE WHEN {d} >= 2 THEN {number(rest * n)} * __ss / ({d} * {d} * ({size} - 1)) END"
    bernstein_rows = f"{ROWS_PER_SKEW} * __skew * __skew"
    steps = steps.withColumns({k: F.expr(v) for k, v in {
        "variance": f"(CASE WHEN {totals} THEN {number(whole * whole * rest / n)} * __var ELSE {spread_of_mean} END) * effect" if n > 1 else nothing,
        "df": f"CASE WHEN {totals} THEN {size} - 1 ELSE {d} - 1 END",
        "__size": "__rows / effect",
        "__scale": f"CASE WHEN {totals} THEN {number(whole)} ELSE 1D END",
        "method": f"'{method}'" if method else f"CASE WHEN NOT {is_count} AND __skew IS NOT NULL AND max_x IS NOT NULL AND __rows < {bernstein_rows} THEN 'bernstein' ELSE 'clt' END",
    }.items()})
    steps = steps.withColumn("__t", F.expr(f"CASE WHEN {totals} THEN {t_sql(level, n - 1)} ELSE {t_sql(level, 'df')} END"))
    normal = "__t * sqrt(variance)"
    concentrated = f"__scale * (sqrt(2 * __var * {three} / __size) + CASE WHEN __size <> 1 THEN 3 * __spread * {three} / (__size - 1) END)"
    bounded = f"__scale * __spread * sqrt({number(math.log(2 / (1 - level)) / 2)} / __size)"
    steps = steps.withColumn("__flat", F.expr("coalesce(variance <= 0, true)"))
    steps = steps.withColumn("__half", F.expr(f"CASE WHEN NOT __flat THEN CASE method WHEN 'bernstein' THEN {concentrated} WHEN 'hoeffding' THEN {bounded} ELSE {normal} END END"))
    # counts at the edge: nothing seen, or nothing else seen
    edge, known = "(__empty OR __full)", f"({census} OR ({is_count} AND known))"
    steps = steps.withColumns({k: F.expr(v) for k, v in {
        "__three": f"least({number(whole)}, {number(whole)} * {number(-math.log(1 - level))} / ({size} / effect))" if n > 0 else number(whole),
        "__empty": f"{is_count} AND {d} = 0",
        "__full": f"{is_count} AND {d} = {size}",
        "estimate": f"CASE WHEN {is_count} AND known THEN {number(whole)} ELSE estimate END",
    }.items()})
    low = f"CASE WHEN {is_count} OR ({is_sum} AND min_x >= 0) THEN greatest(0D, estimate - __half) ELSE estimate - __half END"
    cancelled = f"NOT {is_count} AND sum_xx > 0 AND {d} > 0 AND abs(sum_xx - sum_x * sum_x / {d}) / sum_xx < {number(CANCELLED)}"
    steps = steps.withColumns({k: F.expr(v) for k, v in {
        "ci_low": f"CASE WHEN {known} THEN estimate WHEN __empty THEN 0D WHEN __full THEN {number(whole)} - __three WHEN __half IS NOT NULL THEN {low} END",
        "ci_high": f"CASE WHEN {known} THEN estimate WHEN __empty THEN __three WHEN __full THEN {number(whole)} ELSE estimate + __half END",
        "half_width": f"CASE WHEN {known} AND estimate IS NOT NULL THEN 0D WHEN {edge} THEN __three ELSE __half END",
        "note": f"""CASE WHEN {known} OR {edge} THEN CAST(NULL AS STRING) WHEN NOT {is_count} AND NOT {is_sum} AND {d} < 2 THEN 'undefined: fewer than two rows'
            WHEN __flat THEN 'degenerate: no spread in the sample' WHEN {cancelled} THEN 'precision: raw sums cancel' END""",
    }.items()})
    steps = steps.withColumns({k: F.expr(v) for k, v in {
        "relative_half_width": "CASE WHEN half_width = 0 THEN 0D WHEN estimate <> 0 THEN half_width / abs(estimate) END",
        "variance": f"CASE WHEN {known} THEN 0D ELSE variance END",
        "method": f"CASE WHEN {census} THEN 'census' WHEN {known} THEN 'known' WHEN {edge} THEN 'rule_of_three' ELSE method END",
    }.items()})
    return steps.select(*(f"`{k}`" for k in cells.columns if k not in FIELDS), *FIELDS)


def number(x: float) -> str:
    """A double as SQL."""
    return f"({float(x)!r}D)"


def long_cells(stats: DataFrame, keys: list[str], aggs: list[Agg], effects: dict[str, float] | None = None, universe: bool = False) -> DataFrame:
    """One row for each cell: keys, alias, func, effect, known and the statistics."""
    quote = lambda name: "`" + name.replace("`", "``") + "`"
    text = lambda value: "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cells = []
    for a in aggs:
        fields = ", ".join(f"'{k}', {quote(a.alias)}.{k}" for k in STATISTICS)
        cells.append(F.expr(f"named_struct('alias', {text(a.alias)}, 'func', '{a.func}', 'effect', {number((effects or {}).get(a.alias, 1.0))}, 'known', {universe and a.expr is None}, {fields})"))
    return stats.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*")


def grid(
    stats: DataFrame, keys: list[str], aggs: list[Agg], n: int, total: int, level: float = 0.95,
    effects: dict[str, float] | None = None, method: str | None = None, universe: bool = False,
) -> DataFrame:
    """One row for each cell: keys, alias, func, n_domain and ``FIELDS``.

    ``level`` is that of a single cell; use ``adjusted_level`` for all cells together. ``effects`` by alias.
    """
    return intervals(long_cells(stats, keys, aggs, effects, universe), n, total, level, method, {a.func for a in aggs}).select(*keys, "alias", "func", "n_domain", *FIELDS)


def widest(cells: DataFrame) -> tuple[int, int, float | None]:
    """Cells, cells without an interval, and the largest relative half width: what a stopping rule needs."""
    row = cells.agg(F.count("*"), F.coalesce(F.sum(F.col("relative_half_width").isNull().cast("int")), F.lit(0)), F.max("relative_half_width")).first()
    return row[0], row[1], row[2]


def meets_target(cells: DataFrame, target: float) -> bool:
    """Whether every cell has an interval within the target; a cell without one never does."""
    n, open_, width = widest(cells)
    return n > 0 and open_ == 0 and width is not None and width <= target


# Simple bounds for a sample with n rows in the domain


def bounded_count(n_domain: Column, fraction: float, level: float) -> Column:
    """Half width of a scaled COUNT by Hoeffding's inequality over the sample."""
    return F.sqrt(n_domain * (math.log(2 / (1 - level)) / 2)) / fraction


def bounded_sum(n: Column, low: Column, high: Column, fraction: float, level: float) -> Column:
    """Half width of a scaled SUM of n values in a range."""
    return n * (high - low) * F.sqrt(F.lit(math.log(2 / (1 - level)) / 2) / n) / fraction


def normal_mean(deviation: Column, n: Column, level: float) -> Column:
    """Half width of a mean of at least 30 values."""
    return F.when(n >= 30, t_column(level, n - 1) * deviation / F.sqrt(n))


def predicted_sample_size(n: int, width: float, target: float) -> int:
    """Rows after which the relative half width should reach the target (it shrinks with the square root)."""
    return n if width <= target else math.ceil(n * (width / target) ** 2)
