"""Samplers. Each returns the sampled DataFrame and what is known of its design; nothing runs until counts are asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.sources.tables import below_views

BLOCK_ROWS = 2048
SCALE = 1 << 30
BLOCK = "__block"


@dataclass(frozen=True)
class Sample:
    rows: DataFrame
    fraction: float
    design: str  #: "bernoulli", "hash" or "block"
    total_blocks: int | None = None


def _bound(fraction: float) -> float:
    if not 0 < fraction <= 1:
        raise ValueError("a fraction lies in (0, 1]")
    return fraction


def bernoulli(df: DataFrame, fraction: float, seed: int = 1) -> Sample:
    """Each row by a draw of its own. Draws with one seed are nested: a larger fraction holds the smaller one's rows, as long
    as the scan is dealt out alike."""
    return Sample(df if _bound(fraction) >= 1 else df.where(F.rand(seed) < fraction), fraction, "bernoulli")


def by_hash(df: DataFrame, fraction: float, *keys: str | Column, seed: int = 1) -> Sample:
    """Rows whose key hash falls under the fraction: the same rows under any partitioning, nested in the fraction."""
    place = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(SCALE))
    return Sample(df if _bound(fraction) >= 1 else df.where(place < int(fraction * SCALE)), fraction, "hash")


def by_modulus(df: DataFrame, threshold: int, modulus: int, expression: str) -> Sample:
    """A sample any SQL engine can draw: ``expression mod modulus < threshold``."""
    return Sample(df.where(F.pmod(F.expr(expression), F.lit(modulus)) < threshold), threshold / modulus, "hash")


def number_blocks(df: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with the physical block of each row: ``rows`` successive rows of a scan partition."""
    place = F.monotonically_increasing_id()
    part, within = F.shiftrightunsigned(place, 33), F.pmod(place, F.lit(1 << 33))
    return df.withColumn(BLOCK, F.shiftleft(part, 33) + F.floor(within / rows))


def count_blocks(df: DataFrame, rows: int = BLOCK_ROWS) -> int:
    """Blocks of the whole scan: one row for each partition is added up."""
    parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.ceil(F.count("*") / rows).alias("b"))
    return parts.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]


def blocks(df: DataFrame, fraction: float, rows: int = BLOCK_ROWS, seed: int = 1, total: int | None = None) -> Sample:
    """Whole blocks of successive rows, the analogue of page sampling; nested in the fraction."""
    total = count_blocks(df, rows) if total is None else total
    numbered = number_blocks(df, rows)
    place = F.pmod(F.xxhash64(F.lit(seed), BLOCK), F.lit(SCALE))
    return Sample(numbered if _bound(fraction) >= 1 else numbered.where(place < int(fraction * SCALE)), fraction, "block", total)


def logical_blocks(df: DataFrame, block: Column, threshold: int, modulus: int = 1009, factor: int = 40503) -> Sample:
    """Blocks given by a column (say, ranges of a key); portable arithmetic picks them."""
    marked = df.withColumn(BLOCK, block)
    total = marked.agg(F.count_distinct(BLOCK)).first()[0]
    return Sample(marked.where(F.pmod(F.col(BLOCK) * factor, F.lit(modulus)) < threshold), threshold / modulus, "block", total)


def _file_place(path: Column, seed: int) -> Column:
    """A place for a file by its path; listings and metadata columns write the slashes after the scheme differently."""
    return F.pmod(F.xxhash64(F.lit(seed), F.regexp_replace(path, "^[^/]*/+", "/")), F.lit(SCALE))


def picked_files(df: DataFrame, fraction: float, seed: int = 1) -> tuple[int, int]:
    """Files that ``files`` picks, and all files: from the listing, no data is read."""
    paths = df.sparkSession.createDataFrame([(p,) for p in df.inputFiles()], "p string")
    picked = F.count_if(_file_place(F.col("p"), seed) < int(_bound(fraction) * SCALE))
    return tuple(paths.agg(picked, F.count("*")).first())


def files(df: DataFrame, fraction: float, seed: int = 1) -> Sample:
    """Whole input files: the sample whose unread rows cost no input. Blocks are files; the pick is made on the listing
    (a filter on a constant of each file prunes files), nested in the fraction, and other predicates reach the scan."""
    df, path = below_views(df), F.col("_metadata.file_path")
    marked = df.withColumn(BLOCK, F.xxhash64(path))
    kept = marked.where(_file_place(path, seed) < int(_bound(fraction) * SCALE)) if fraction < 1 else marked
    return Sample(kept, fraction, "file")


def probe(df: DataFrame, sample: Sample, order: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """How contiguous a sample is: rows, share, runs of successive ``order`` values and blocks touched."""
    place = Window.partitionBy(F.floor(F.col(order) / rows)).orderBy(order)
    marked = sample.rows.select(order, (F.col(order) - F.lag(order).over(place)).alias("gap"))
    total = df.count()
    return marked.agg(
        F.count("*").alias("n_rows"),
        (F.count("*") / F.lit(total)).alias("share"),
        F.sum(F.when(F.col("gap") == 1, 0).otherwise(1)).cast("long").alias("n_runs"),
        F.count_distinct(F.floor(F.col(order) / rows)).alias("n_blocks"),
    )
