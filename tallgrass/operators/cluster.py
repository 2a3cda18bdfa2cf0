"""Block (cluster) samples: estimates from block totals, design effects.

Blocks without a row of a group count as zero; they need no row, because the number of sampled blocks m is known. All sums
that an interval needs are taken in two aggregations: (block, group) totals, then groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.quantiles import t_column
from tallgrass.operators.estimators import AVG, COUNT, EFFECT_RANGE, FIELDS, Agg, only
from tallgrass.operators.sampling import BLOCK

#: Blocks under which a cell is not allowed to stop a ladder, and from which its interval is trusted.
LEAST_BLOCKS = 20
TRUSTED = {AVG: 300}
TRUSTED_OTHERWISE = 100


def trusted_blocks(func: str) -> int:
    return TRUSTED.get(func, TRUSTED_OTHERWISE)


def block_totals(rows: DataFrame, keys: list[Column], aggs: list[Agg], block: str = BLOCK) -> DataFrame:
    """(block, group): rows, and for each aggregate the number k, sum t and sum of squares of its non-null values."""
    out = [F.count("*").alias("n_rows")]
    for a in aggs:
        x = F.lit(1.0) if a.expr is None else (F.when(a.expr.isNotNull(), 1.0) if a.func == COUNT else a.expr.cast("double"))
        out.append(F.struct(F.count(x).cast("double").alias("k"), F.coalesce(F.sum(x), F.lit(0.0)).alias("t"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("xx")).alias(a.alias))
    return rows.groupBy(block, *keys).agg(*out)


def block_summary(totals: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """Group: blocks met, and for each aggregate the sums over blocks of t, t^2, k, k^2, t k and x^2."""

    def sums(c: Column) -> Column:
        t, k = c["t"], c["k"]
        parts = {"t": t, "tt": t * t, "k": k, "kk": k * k, "tk": t * k, "xx": c["xx"]}
        return F.struct(*(F.sum(v).alias(n) for n, v in parts.items()))

    return totals.groupBy(*keys).agg(F.count("*").alias("n_blocks"), *(sums(F.col(a.alias)).alias(a.alias) for a in aggs))


def cluster_intervals(cells: DataFrame, m: int, total: int, level: float = 0.95, funcs: set[str] | None = None) -> DataFrame:
    """Rows with ``func`` and the block sums of a cell, with ``FIELDS`` added. m, total: sampled and all blocks."""
    col, grow, rest = F.col, total / max(m, 1), max(0.0, 1 - m / total) if total else 0.0
    is_avg, is_count, census = only(AVG, funcs), only(COUNT, funcs), m >= total
    sum_, squares = (F.when(is_count, col(a)).otherwise(col(b)) for a, b in (("k", "t"), ("kk", "tt")))
    steps = cells.withColumns({"__t": sum_, "__tt": squares})
    steps = steps.withColumn("estimate", F.when(is_avg, F.when(col("k") > 0, col("t") / col("k"))).otherwise(grow * col("__t")))
    residual = col("tt") - 2 * col("estimate") * col("tk") + col("estimate") * col("estimate") * col("kk")
    spread = F.greatest(F.lit(0.0), F.when(is_avg, residual).otherwise(col("__tt") - col("__t") * col("__t") / max(m, 1)))
    unit = F.when(is_avg, F.pow(grow * col("k"), F.lit(2.0))).otherwise(1.0)
    steps = steps.withColumn("variance", float(total) * total * rest / m * spread / (m - 1) / unit if m >= 2 else F.lit(None).cast("double"))
    half = F.lit(0.0) if census else F.when(col("variance") > 0, t_column(level, m - 1) * F.sqrt("variance"))
    steps = steps.withColumn("half_width", half)
    low = col("estimate") - col("half_width")
    few = F.lit(m) < F.when(is_avg, trusted_blocks(AVG)).otherwise(trusted_blocks(COUNT))
    note = F.lit(None).cast("string") if census else F.lit("undefined: fewer than two blocks") if m < 2 else F.when(col("half_width").isNull(), "degenerate: no spread between blocks").when(few, "few blocks")
    steps = steps.withColumns({
        "df": F.lit(float(m - 1)),
        "ci_low": F.when(is_count, F.greatest(F.lit(0.0), low)).otherwise(low),
        "ci_high": col("estimate") + col("half_width"),
        "relative_half_width": F.when(col("half_width") == 0, 0.0).when(col("estimate") != 0, col("half_width") / F.abs("estimate")),
        "method": F.lit("census" if census else "cluster"),
        "note": note,
    })
    return steps.select(*(f"`{k}`" for k in cells.columns if k not in FIELDS), *FIELDS)


SUMS = ("t", "tt", "k", "kk", "tk", "xx")


def long_sums(summary: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    cells = [F.struct(F.lit(a.alias).alias("alias"), F.lit(a.func).alias("func"), *(F.col(a.alias)[k].alias(k) for k in SUMS)) for a in aggs]
    return summary.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*")


def cluster_grid(summary: DataFrame, keys: list[str], aggs: list[Agg], m: int, total: int, level: float = 0.95) -> DataFrame:
    """One row for each cell, with the columns of the row-sample grid."""
    cells = cluster_intervals(long_sums(summary, keys, aggs), m, total, level, {a.func for a in aggs})
    return cells.select(*keys, "alias", "func", F.col("k").cast("long").alias("n_domain"), *FIELDS)


def row_variance(n: float, total: float) -> Column:
    """Variance that the rows of a cell would have as a simple random sample of n rows of the table."""
    col, f = F.col, n / total
    x, xx = (F.when(col("func") == COUNT, col("k")).otherwise(col(k)) for k in ("t", "xx"))
    mean = (1 - f) * n * F.greatest(F.lit(0.0), col("xx") - col("t") * col("t") / col("k")) / (col("k") * col("k") * (n - 1))
    return F.when(col("func") == AVG, mean).otherwise(total * total * (1 - f) / n * F.greatest(F.lit(0.0), xx - x * x / n) / (n - 1))


def design_effects(summary: DataFrame, keys: list[str], aggs: list[Agg], m: int, total_blocks: int, n: int, total_rows: int) -> DataFrame:
    """Cell: design effect (cluster against row variance), its clamped value, and the correlation within blocks."""
    cells = cluster_intervals(long_sums(summary, keys, aggs), m, total_blocks, funcs={a.func for a in aggs})
    cells = cells.select(*keys, "alias", (F.col("variance") / row_variance(float(n), float(total_rows))).alias("design_effect"))
    clamped = F.least(F.greatest(F.col("design_effect"), F.lit(EFFECT_RANGE[0])), F.lit(EFFECT_RANGE[1]))
    return cells.withColumn("clamped", clamped).withColumn("block_correlation", (F.col("design_effect") - 1) / F.lit(max(n / max(m, 1) - 1, 1e-9)))


def projected_effect(correlation: float, block_rows: float) -> float:
    """Design effect at another block size."""
    return max(0.0, 1 + (block_rows - 1) * correlation)
