"""Epsilon grid order join of embeddings by cosine.

On unit vectors a cosine of at least c is a distance of at most eps = sqrt(2 - 2c). Vectors are projected on the leading
principal dimensions of a bounded sample (projections never lengthen distances, so skipping by them is safe whatever the
sample), sorted by their grid cells, and cut into sequence intervals. Interval pairs are joined recursively, from the whole
sequence down to groups of blocks and, within a task, to blocks and tiles; pairs whose bounding boxes are more than eps apart
are skipped. A block travels once for each pair of groups it is in, so groups grow with the table, up to ``GROUP`` blocks: a task
holds one group and one more block.

Equal vectors are first joined into classes. A tile gives counts for each vector and a spanning forest of its links, never
the list of all pairs, so a large group of near copies costs comparisons but no output.

Defined cases: vectors that are null, zero, of an unusual length, or hold null or non-finite components link with nothing;
rows with a null id link with nothing, have no component and are kept; rows that share an id are one node, and their
vectors count one by one (a row that has no usable vector links with nothing, whatever the others of its id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import arrow, written
from tallgrass.llm.components import components, forest
from tallgrass.llm.vectors import judged, matrix, sample

SAMPLE, DIMENSIONS = 20_000, 8
BLOCK_BYTES, TILE, FAN, GROUP = 1 << 19, 512, 8, 32


def principal(points: np.ndarray) -> np.ndarray:
    """Leading principal directions (orthonormal rows) of the sample."""
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    _, directions = np.linalg.eigh(np.cov(unit.T)) if len(unit) > 1 else (None, np.eye(points.shape[1]))
    return np.ascontiguousarray(directions[:, ::-1].T[:DIMENSIONS])


def apart(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Squared distance of bounding boxes, along the last axis."""
    return (np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a)) ** 2).sum(-1)


class Block:
    """A sequence interval: class sizes, ids and vectors, with the boxes of its tiles."""

    def __init__(self, ids: bytes, sizes: bytes, vectors: bytes, directions: np.ndarray, tile: int = TILE):
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        v = np.frombuffer(vectors, "<f8").reshape(len(self.ids), -1)
        self.unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        self.short = self.unit.astype(np.float32)
        flat = self.unit @ directions.T
        self.low, self.high = flat.min(0), flat.max(0)
        self.tiles = [(a, min(a + tile, len(v)), flat[a : a + tile].min(0), flat[a : a + tile].max(0)) for a in range(0, len(v), tile)]
        self.counts = np.zeros(len(self.ids), np.int64)


def join_blocks(x: Block, y: Block, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Adds to the counts of x and of y (which may be x); edges of spanning forests."""
    eps2, us, vs = 2 - 2 * cosine + 1e-9, [], []
    if apart(x.low, x.high, y.low, y.high) <= eps2:
        for i, (a, b, lo_a, hi_a) in enumerate(x.tiles):
            for c, d, lo_c, hi_c in y.tiles[i if x is y else 0 :]:
                if apart(lo_a, hi_a, lo_c, hi_c) > eps2 or (x.short[a:b] @ y.short[c:d].T).max() < cosine - 1e-4:
                    continue
                mask = x.unit[a:b] @ y.unit[c:d].T >= cosine
                same = x is y and a == c
                if same:
                    np.fill_diagonal(mask, False)
                x.counts[a:b] += mask @ y.sizes[c:d]
                if not same:
                    y.counts[c:d] += mask.T @ x.sizes[a:b]
                u, v = forest(mask, x.ids[a:b], y.ids[c:d])
                us.append(u)
                vs.append(v)
    empty = np.zeros(0, np.int64)
    return np.concatenate(us) if us else empty, np.concatenate(vs) if vs else empty


def linked(table: DataFrame, cosine: float = 0.95, block: int | None = None, group: int | None = None, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id of every row. ``block`` vectors and ``group`` blocks are worked out from the table if not
    given."""
    spark = table.sparkSession
    every = judged(table)
    rows = every.where("ok").drop("ok")
    keyed = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(7), F.col("v"))})
    made = written(keyed.select("vec_id", "k1", "k2"), "vectors")
    classes = written(made.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("size")), "classes")
    # what cannot be compared, row by row: an id may have usable rows besides
    unused = every.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    points = sample(rows, SAMPLE)
    if not len(points):
        return unused
    block = block or max(1, BLOCK_BYTES // (8 * points.shape[1]))
    directions, width = principal(points), math.sqrt(2 - 2 * cosine)

    def project(batches):
        for batch in batches:
            v = matrix(batch.column(2))
            cells = np.floor(v / np.linalg.norm(v, axis=1, keepdims=True) @ directions.T / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], ["node", "size", "v", "cells"])

    # one row of each class, in epsilon grid order
    reps = keyed.withColumnRenamed("vec_id", "node").join(classes, ["k1", "k2", "node"]).dropDuplicates(["k1", "k2"])
    ordered = written(arrow(reps.select("node", "size", "v"), project, "node long, size long, v array<double>, cells array<int>"), "cells")
    ordered = ordered.repartitionByRange("cells", "node").sortWithinPartitions("cells", "node").select("node", "size", "v")

    def cut(batches):
        part, seen, held = TaskContext.get().partitionId(), 0, []

        def flush():
            ids, sizes = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            v = np.concatenate([h[2] for h in held])
            flat = v / np.linalg.norm(v, axis=1, keepdims=True) @ directions.T
            box = {"lo": [flat.min(0).tolist()], "hi": [flat.max(0).tolist()]}
            raw = {"ids": [ids.astype("<i8").tobytes()], "sizes": [sizes.astype("<i8").tobytes()], "vectors": [v.astype("<f8").tobytes()]}
            return pa.RecordBatch.from_pydict({"part": [part], "nth": [seen], **box, **raw})

        for batch in batches:
            at = 0
            while at < len(batch):
                some = batch.slice(at, block - sum(len(h[0]) for h in held))
                at += len(some)
                held.append((some.column(0).to_numpy(zero_copy_only=False), some.column(1).to_numpy(zero_copy_only=False), matrix(some.column(2))))
                if sum(len(h[0]) for h in held) == block:
                    yield flush()
                    seen, held = seen + 1, []
        if held:
            yield flush()

    blocks = written(arrow(ordered, cut, "part long, nth long, lo array<double>, hi array<double>, ids binary, sizes binary, vectors binary"), "blocks", "lz4")

    # place of each block in the sequence: parts in order, blocks of a part in order (one row for each part is summed up)
    parts = blocks.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(parts), "part").withColumn("b", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    boxes = written(placed.select("b", "lo", "hi"), "boxes")
    last = boxes.agg(F.max("b")).first()[0]
    group = group or max(1, min(GROUP, last // FAN))
    fold = lambda c, f: F.array(*(f(F.col(c)[d]) for d in range(len(directions))))

    # recursion over intervals of FAN ** level groups
    level = 0
    while FAN**level <= last // group:
        level += 1
    pairs = spark.createDataFrame([(0, 0)], "i long, j long")
    far = F.expr("aggregate(sequence(0, size(lo) - 1), double(0), (s, d) -> s + pow(greatest(0, lo[d] - hi2[d], lo2[d] - hi[d]), 2))")
    while level > 0:
        level -= 1
        level_boxes = boxes.groupBy(F.expr(f"b div {group * FAN**level}").alias("b")).agg(fold("lo", F.min).alias("lo"), fold("hi", F.max).alias("hi"))
        inner = pairs.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(FAN * FAN - 1))))
        pairs = inner.select((F.col("i") * FAN + F.expr(f"c div {FAN}")).alias("i"), (F.col("j") * FAN + F.col("c") % FAN).alias("j")).where("i <= j")
        pairs = pairs.join(level_boxes.withColumnRenamed("b", "i"), "i").join(level_boxes.select(F.col("b").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "j")
        pairs = written(pairs.where(far <= 2 - 2 * cosine + 1e-9).select("i", "j"), "intervals")

    # the blocks of the first group of a pair, then those of the second
    dealt = placed.select(F.expr(f"b div {group}").alias("g"), "b", "ids", "sizes", "vectors")
    cell = (F.col("i") * (1 << 31) + F.col("j")).alias("cell")
    first = pairs.join(dealt.withColumnRenamed("g", "i"), "i").select(cell, F.lit(0).alias("side"), "b", "ids", "sizes", "vectors")
    second = pairs.where("i < j").join(dealt.withColumnRenamed("g", "j"), "j").select(cell, F.lit(1).alias("side"), "b", "ids", "sizes", "vectors")
    both = first.union(second).repartition("cell").sortWithinPartitions("cell", "side", "b").select("cell", "ids", "sizes", "vectors", "side")

    def compare(batches):
        now, held = None, []  # the first group of the pair at hand (all its blocks so far, if it is paired with itself)

        def edges(us, vs):
            return pa.RecordBatch.from_arrays([pa.array(us), pa.array(vs), pa.array(np.zeros(len(us), np.int64))], ["u", "v", "n"])

        def counts(some):
            for one in some:
                at = np.flatnonzero(one.counts)
                yield pa.RecordBatch.from_arrays([pa.array(one.ids[at]), pa.array(np.full(len(at), -1)), pa.array(one.counts[at])], ["u", "v", "n"])

        for batch in batches:
            for r in range(len(batch)):
                cell, side = batch.column(0)[r].as_py(), batch.column(4)[r].as_py()
                if cell != now:
                    yield from counts(held)
                    now, held = cell, []
                one = Block(*(batch.column(c)[r].as_py() for c in (1, 2, 3)), directions, tile)
                if side == 0:
                    held.append(one)
                if side or cell >> 31 == cell & ((1 << 31) - 1):
                    for other in held:
                        yield edges(*join_blocks(other, one, cosine))
                if side:
                    yield from counts([one])
        yield from counts(held)

    found = written(arrow(both, compare, "u long, v long, n long"), "found")
    counts = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.where("n = 0").select("u", "v"))
    # a class's rows link with each other and with all rows of the classes it is linked with
    joined = classes.join(counts, "node", "left").join(groups, "node", "left")
    joined = written(joined.select("k1", "k2", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "joined")
    return made.join(joined, ["k1", "k2"]).select("vec_id", "n_links", "component_id").union(unused)


def op6_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def sql(table: str = "embeddings", cosine: float = 0.95) -> str:
    """The same by all pairs and plain reachability, in DuckDB's SQL (for small tables)."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM {table}),
fine AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {cosine}),
reach AS (SELECT vec_id AS node, vec_id AS met FROM v UNION SELECT node, w FROM reach JOIN links ON u = met),
found AS (SELECT node, min(met) AS component_id FROM reach GROUP BY node),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN found ON node = vec_id LEFT JOIN degree ON u = vec_id
"""
