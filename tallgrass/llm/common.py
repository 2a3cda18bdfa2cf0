"""Helpers shared by the training-data operators: durable tables, memoised encoders, hashing."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.session import new_path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: after an executor is lost nothing before the table is computed again. The shuffle files that
    made the table are removed as soon as it is written.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


READ_BYTES = 8 << 20  #: of the files behind a table, for each partition that ``compact`` leaves at least


def compact(df: DataFrame) -> DataFrame:
    """``df`` in a partition for each core, or for each ``READ_BYTES`` that its statement reads, whichever is more.

    Partitions are put together without a shuffle; where there are no more, nothing changes. A small table would else be a
    file for each shuffle partition, and every file has its price: on a local disk without Hadoop's native library the JVM
    starts a process for each (``chmod``, and again for its checksum). Not for rows whose order or partition matters.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-read // READ_BYTES))
    return df.coalesce(parts) if parts < 1 << 20 else df  # more: tables of unknown size


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``written`` in few files (see ``compact``)."""
    return written(compact(df), name, codec)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Statements that run inside leave no shuffle files behind (executors remove them when a statement ends)."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(names: list[str]) -> list[str]:
    return [f"`{n.replace('`', '``')}`" for n in names]


#: Bytes of an Arrow batch on its way to a Python worker: texts may be long, and rows alone do not bound a batch.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded(spark: SparkSession) -> None:
    """Batches to Python workers are bounded by bytes, for the session (unless it has a smaller bound already)."""
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, whose workers give back what they have used."""
    bounded(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            trimmed()

    return df.mapInArrow(run, schema)


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``arrow`` for columns of any name: the function gets them by place."""
    return arrow(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), function, schema)


def trimmed() -> None:
    """Give freed memory back to the system: workers are used again and again, and each would keep its peak."""
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Memo(dict):
    """``memo[word]`` computes each new word once; keeps at most ``limit`` short words, later ones are computed each time."""

    def __init__(self, compute, limit: int = 600_000, longest: int = 40):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, word):
        value = self.compute(word)
        if len(self) < self.limit and len(word) <= self.longest:
            self[word] = value
        return value


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


class PolyHash:
    """Hashes of any substring of a byte array through prefix sums modulo 2**64.

    Bytes go through a table of random words first; results are finalised by ``mix64``.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n + 1:
            size = max(n + 1, 2 * len(self.power))
            with np.errstate(over="ignore"):
                inverse = pow(self.BASE, -1, 2**64)
                for name, base in (("power", self.BASE), ("inverse", inverse)):
                    factors = np.full(size, base, np.uint64)
                    factors[0] = 1
                    setattr(self, name, np.multiply.accumulate(factors))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``data[start:end]`` for arrays of starts and ends."""
        with np.errstate(over="ignore"):
            return mix64((prefix[end] - prefix[start]) * self.inverse[start] + np.asarray(end - start).astype(np.uint64))

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of each ``width``-byte substring, by start."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix64((prefix[width:] - prefix[:n]) * self.inverse[:n] + np.uint64(width))


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for name in table.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
