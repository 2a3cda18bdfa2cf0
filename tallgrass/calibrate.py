"""Do the intervals cover? Synthetic populations, repeated samples, and verdicts with a margin for chance.

All trials of a study run as one Spark aggregation: every trial is a group, its sample is drawn by a hash of (trial, row).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions.quantiles import adjusted_level, z_quantile
from tallgrass.operators import cluster, estimators
from tallgrass.operators.estimators import AVG, COUNT, SUM, Agg
from tallgrass.operators.sampling import BLOCK, SCALE

ROWS, DOMAIN = 40_000, 0.35


def _normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def shapes(u: Column, v: Column) -> dict[str, Column]:
    """Value columns of the standard populations from two uniform columns."""
    z = _normal(u, v)
    return {
        "normal": 50 + 12 * z,
        "lognormal": F.exp(3 + 0.9 * z),
        "pareto": F.pow(u, F.lit(-1 / 1.8)),
        "zero_inflated": F.when(v < 0.7, 0.0).otherwise(10 + 100 * u),
        "constant": F.lit(7.0),
        "offset": 1e6 + z,
    }


def population(spark: SparkSession, shape: str, rows: int = ROWS, domain: float = DOMAIN, seed: int = 1) -> DataFrame:
    """id, x, inside (whether a row lies in the domain) and g (twelve groups of falling size)."""
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(SCALE)) + 0.5) / SCALE
    zipf = F.least(F.lit(12), F.floor(F.lit(1.0) / uniform(4))).cast("int")
    return spark.range(rows).select("id", shapes(uniform(1), uniform(2))[shape].alias("x"), (uniform(3) < domain).alias("inside"), zipf.alias("g"))


def laid_out(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``place``: rows shuffled, sorted by value ("clustered"), or sorted within bands ("banded")."""
    mixed = F.xxhash64("id")
    by = {"shuffled": [mixed], "clustered": [F.col("x"), mixed], "banded": [F.floor(F.col("x") / 10), mixed]}[order]
    # ranges of the order over all tasks; a row's place is that within its task and the rows of the tasks before (a row a task)
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()).persist()
    part, within = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    return dealt.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn("place", F.col("__before") + within).drop("__id", "__part", "__before")


def wilson(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Score interval of a proportion."""
    z, p = z_quantile(level), hits / n
    middle, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, (middle - half) / (1 + z * z / n)), min(1.0, (middle + half) / (1 + z * z / n))


@dataclass(frozen=True)
class Coverage:
    shape: str
    func: str
    trials: int
    covered: int
    level: float

    @property
    def share(self) -> float:
        return self.covered / self.trials

    @property
    def upper(self) -> float:
        return wilson(self.covered, self.trials)[1]

    @property
    def is_short(self) -> bool:
        """Whether coverage is below nominal by more than chance allows."""
        return self.upper < self.level


def study(spark: SparkSession, shape: str, func: str, fraction: float = 0.1, trials: int = 200, rows: int = 5000, level: float = 0.95, method: str | None = None) -> Coverage:
    """Coverage of simple random samples of a population, over its domain."""
    people = population(spark, shape, rows).persist()
    truth = people.where("inside").agg({COUNT: F.count("*").cast("double"), SUM: F.sum("x"), AVG: F.avg("x")}[func]).first()[0]
    agg = Agg(func, None if func == COUNT else F.col("x"), "a")
    drawn = spark.range(trials).withColumnRenamed("id", "trial").withColumn("ids", F.sequence(F.lit(0), F.lit(rows - 1).cast("long")))
    n = round(fraction * rows)
    first = F.row_number().over(Window.partitionBy("trial").orderBy(F.xxhash64(F.lit(99), "trial", "id")))
    drawn = drawn.select("trial", F.explode("ids").alias("id")).withColumn("nth", first).where(F.col("nth") <= n)
    stats = estimators.filtered_statistics(drawn.join(people, "id"), [F.col("trial")], [agg], F.col("inside"))
    cells = estimators.intervals(estimators.long_cells(stats, ["trial"], [agg]), n, rows, level, method)
    covered = cells.where((F.col("ci_low") <= truth) & (F.col("ci_high") >= truth)).count()
    people.unpersist()
    return Coverage(shape, func, trials, covered, level)


def simultaneous(spark: SparkSession, shape: str, func: str, fraction: float = 0.2, trials: int = 100, rows: int = 6000, level: float = 0.95, adjust: str = "bonferroni") -> Coverage:
    """How often the intervals of all groups (of falling size) of a trial hold together, at a level adjusted for their number."""
    people = population(spark, shape, rows).where("g <= 6").persist()
    size = people.count()
    agg = Agg(func, None if func == COUNT else F.col("x"), "a")
    truth = people.groupBy("g").agg({COUNT: F.count("*").cast("double"), SUM: F.sum("x"), AVG: F.avg("x")}[func].alias("truth")).persist()
    one = adjusted_level(level, truth.count(), adjust)
    n = round(fraction * size)
    first = F.row_number().over(Window.partitionBy("trial").orderBy(F.xxhash64(F.lit(99), "trial", "id")))
    drawn = spark.range(trials).withColumnRenamed("id", "trial").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(rows - 1).cast("long"))))
    drawn = drawn.join(people, F.col("other") == F.col("id")).withColumn("nth", first).where(F.col("nth") <= n)
    stats = estimators.statistics(drawn, [F.col("trial"), F.col("g")], [agg])
    cells = estimators.intervals(estimators.long_cells(stats, ["trial", "g"], [agg]), n, size, one).join(truth, "g")
    held = cells.groupBy("trial").agg(F.count_if((F.col("ci_low") <= F.col("truth")) & (F.col("ci_high") >= F.col("truth"))).alias("k"))
    covered = held.where(F.col("k") == truth.count()).count()
    people.unpersist()
    truth.unpersist()
    return Coverage(shape, func, trials, covered, level)


def study_blocks(spark: SparkSession, order: str, func: str = AVG, fraction: float = 0.2, trials: int = 60, rows: int = 16_000, block: int = 40, level: float = 0.95) -> Coverage:
    """Coverage of the block-sample intervals over a layout ("shuffled", "clustered" or "banded")."""
    placed = laid_out(population(spark, "normal", rows), order).withColumn(BLOCK, F.expr(f"place div {block}")).persist()
    truth = placed.agg({COUNT: F.count("*").cast("double"), SUM: F.sum("x"), AVG: F.avg("x")}[func]).first()[0]
    agg, total = Agg(func, None if func == COUNT else F.col("x"), "a"), rows // block
    m = round(fraction * total)
    nth = F.row_number().over(Window.partitionBy("trial").orderBy(F.xxhash64(F.lit(7), "trial", "picked")))
    drawn = spark.range(trials).withColumnRenamed("id", "trial").withColumn("picked", F.explode(F.sequence(F.lit(0), F.lit(total - 1).cast("long"))))
    drawn = drawn.withColumn("nth", nth).where(F.col("nth") <= m).join(placed, F.col("picked") == F.col(BLOCK))
    summary = cluster.block_summary(cluster.block_totals(drawn, [F.col("trial")], [agg]), ["trial"], [agg])
    cells = cluster.cluster_grid(summary, ["trial"], [agg], m, total, level)
    covered = cells.where((F.col("ci_low") <= truth) & (F.col("ci_high") >= truth)).count()
    placed.unpersist()
    return Coverage(order, func, trials, covered, level)
