"""Usable rows of an embedding table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` (long), ``v`` (array of double) and ``ok`` of every row: whether it has an id and a non-zero vector without null
    or non-finite components; where lengths differ, of the most frequent length (the smaller among equals)."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.expr("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    lengths = rows.where(fine).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.withColumn("ok", F.coalesce(fine & (F.size("v") == (lengths[0]["n"] if lengths else 0)), F.lit(False)))


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` of the rows that are ``ok``."""
    return judged(table, id_col, vector_col).where("ok").drop("ok")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a two-dimensional array."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those of the smallest hashes of the id (a documented bound for fitting only)."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").toArrow().column(0).combine_chunks()
    return matrix(got) if len(got) else np.zeros((0, 0))
