"""Approximate nearest neighbours over balanced posting lists.

Lists come from balanced bisection of a bounded sample, so that they have like sizes; list centroids are linked in a graph
that is searched in memory, best first. A vector is replicated to every list whose centroid is nearly as close as its
closest one (boundary vectors, ``REPLICAS`` lists at most); every vector is in a list. A query reads the lists whose
distance is within ``PRUNE`` of its closest centroid's, and a number of its closest lists in any case. That number is set
on the table itself: the ``CALIBRATION`` queries of the smallest id hashes are answered by brute force, and it is the least
for which they find ``TARGET`` of their neighbours. Largest inner product becomes smallest distance by one further
component, ``sqrt(M^2 - |x|^2)``, with M the largest norm of all rows.

Lists next to each other in bisection order are neighbours in space, so ``GROUP`` of them travel together: a vector or query
is sent once to each group that has a list of it, with a mask of those lists. Groups that have grown large (copies of one
vector cannot be told apart) are dealt out in chunks of vectors and of queries; every chunk is read. Each task keeps the best of its lists for a bounded number of queries, so what is shuffled for the
last ranking is a few rows for each query and task. Scores are sums in a fixed order: equal vectors get equal scores.

Defined cases: rows with a null id, or with a vector that is null, zero, or holds null or non-finite components take no part, nor do vectors
whose length is not the usual one; equal rows are one candidate; without candidates the result is empty; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm.vectors import matrix, sample, usable
from tallgrass.llm.common import arrow, written

SAMPLE, LIST, LISTS = 20_000, 256, 4096
REPLICAS, REPLICATE = 4, 1.10
PRUNE, BEAM = 1.10, 512
CALIBRATION, TARGET = 256, 0.95
CHUNK, HELD, GROUP = 8192, 100_000, 8


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(-1)[:, None] - 2 * a @ b.T + (b * b).sum(-1)[None], 0)


def balanced_centroids(points: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Centroids of ``lists`` (rounded to a power of two) equal parts by repeated two-means with a median split."""
    rng, parts = np.random.default_rng(seed), [points]
    while 2 * len(parts) <= lists and min(map(len, parts)) >= 4:
        halves = []
        for own in parts:
            two = own[rng.choice(len(own), 2, replace=False)]
            for _ in range(6):
                side = own @ (two[0] - two[1]) - (two[0] @ two[0] - two[1] @ two[1]) / 2
                order = np.argsort(-side, kind="stable")
                a, b = own[order[: len(own) // 2]], own[order[len(own) // 2 :]]
                two = np.stack([a.mean(0), b.mean(0)])
            halves += [a, b]
        parts = halves
    return np.stack([p.mean(0) for p in parts])


class CentroidGraph:
    """Nearest-neighbour links and a few random ones between centroids, searched best first for many points at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, seed: int = 1):
        n, rng = len(centroids), np.random.default_rng(seed)
        self.centroids = centroids
        near = np.argsort(squared(centroids, centroids), axis=1, kind="stable")[:, 1 : degree + 1]
        self.links = np.concatenate([near, rng.integers(0, n, (n, 4)), ((np.arange(n) + 1) % n)[:, None]], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))

    def search(self, points: np.ndarray, beam: int, expand: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Indices and squared distances of up to ``beam`` close centroids for each point, closest first (-1: none)."""
        n, k = len(points), len(self.centroids)
        beam = min(beam, k)
        sizes, row = (self.centroids**2).sum(1), np.arange(n)[:, None]
        seen = np.zeros((n, k), bool)

        def distances(index):
            d = (points**2).sum(1)[:, None] + sizes[index] - 2 * np.einsum("nd,nkd->nk", points, self.centroids[index])
            return np.maximum(d, 0)

        index = np.tile(self.entries, (n, 1))
        seen[row, index] = True
        far, done = distances(index), np.zeros(index.shape, bool)
        while True:
            rank = np.where(done, np.inf, far)
            picked = np.argsort(rank, axis=1, kind="stable")[:, :expand]
            open_ = np.isfinite(np.take_along_axis(rank, picked, 1))
            if not open_.any():
                break
            np.put_along_axis(done, picked, True, 1)
            new = np.where(open_[:, :, None], self.links[np.take_along_axis(index, picked, 1)], -1).reshape(n, -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[(new >= 0) & seen[row, new]] = -1
            at = np.nonzero(new >= 0)
            seen[at[0], new[at]] = True
            far = np.concatenate([far, np.where(new >= 0, distances(new), np.inf)], axis=1)
            index, done = np.concatenate([index, new], axis=1), np.concatenate([done, new < 0], axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            far, index, done = (np.take_along_axis(x, order, 1) for x in (far, index, done))
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(index, order, 1), np.take_along_axis(far, order, 1)


    def closest(self, points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``search``, for queries: beyond ``BEAM`` lists all distances cost less than a search."""
        if most <= BEAM < len(self.centroids):
            return self.search(points, BEAM)
        far = squared(points, self.centroids)
        order = np.argsort(far, axis=1, kind="stable")
        return order, np.take_along_axis(far, order, 1)


def merged(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then id; an id counts once. -inf marks empty places."""
    order = np.lexsort((ids, -scores), axis=1)
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    scores = scores.copy()
    scores[:, 1:][(ids[:, 1:] == ids[:, :-1]) & (scores[:, 1:] == scores[:, :-1])] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k candidates of largest inner product, itself left out; scores summed in a fixed order."""
    near = q @ x.T
    near[q_ids[:, None] == ids[None]] = -np.inf
    some = min(k, len(ids))
    cut = np.partition(near, len(ids) - some, axis=1)[:, len(ids) - some]
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
    rows, columns = np.nonzero((near >= (cut - slack)[:, None]) & np.isfinite(near))
    exact = np.zeros(len(rows))
    for d in range(q.shape[1]):
        exact += q[rows, d] * x[columns, d]
    order = np.lexsort((ids[columns], -exact, rows))
    rows, columns, exact = rows[order], columns[order], exact[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < k
    out_ids, out = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
    out_ids[rows[keep], rank[keep]], out[rows[keep], rank[keep]] = ids[columns[keep]], exact[keep]
    return out_ids, out


def _scan(batches, k: int):
    """Rows (cell, kind, id, v, mask) sorted by cell and kind: queries (0), then vectors (1); masks tell the lists of each.
    Best candidates of each query."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    cell, q_ids, q, q_masks = None, [], [], []

    def out():
        counts = [int(np.isfinite(s).sum()) for _, s in held.values()]
        got = [np.repeat(np.fromiter(held, np.int64, len(held)), counts), *(np.concatenate([x[j][: c] for x, c in zip(held.values(), counts, strict=True)]) if held else np.zeros(0) for j in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1].astype(np.int64), pa.int64()), pa.array(got[2], pa.float64())], ["query_id", "vec_id", "score"])

    for batch in batches:
        cells, kinds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        ids, v, masks = batch.column(2).to_numpy(zero_copy_only=False), matrix(batch.column(3)), batch.column(4).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1]), [True])))
        for a, b in zip(edges, edges[1:], strict=False):
            if cells[a] != cell:
                cell, q_ids, q, q_masks = cells[a], [], [], []
            if kinds[a] == 0:
                q_ids.append(ids[a:b])
                q.append(v[a:b])
                q_masks.append(masks[a:b])
                continue
            for bit in range(GROUP) if q_ids else ():
                reads, has = (np.concatenate(q_masks) >> bit) & 1 > 0, (masks[a:b] >> bit) & 1 > 0
                if not (reads.any() and has.any()):
                    continue
                own, points, candidates, x = np.concatenate(q_ids)[reads], np.concatenate(q)[reads], ids[a:b][has], v[a:b][has]
                for c in range(0, len(own), 512):
                    part = own[c : c + 512]
                    found, scores = best(part, points[c : c + 512], candidates, x, k)
                    before = [held.get(int(i)) for i in part]
                    none = (np.full(k, -1, np.int64), np.full(k, -np.inf))
                    found = np.concatenate([found, np.stack([(x or none)[0] for x in before])], axis=1)
                    scores = np.concatenate([scores, np.stack([(x or none)[1] for x in before])], axis=1)
                    found, scores = merged(found, scores, k)
                    held.update((int(i), (f, s)) for i, f, s in zip(part, found, scores, strict=True))
                    if len(held) > HELD:
                        yield out()
                        held.clear()
    if held:
        yield out()


def build_index(rows: DataFrame) -> tuple[CentroidGraph, float] | None:
    """The centroid graph, and the largest norm of all rows."""
    n, top = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return None
    points = sample(rows, SAMPLE)
    points = np.concatenate([points, np.sqrt(np.maximum(top - (points**2).sum(1), 0))[:, None]], axis=1)
    return CentroidGraph(balanced_centroids(points, min(LISTS, max(1, n // LIST)))), top


def lists_of(graph: CentroidGraph, top: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``REPLICAS`` lists of each vector, and which of them hold it."""
    extra = np.sqrt(np.maximum(top - (x**2).sum(1), 0))
    lists, far = graph.search(np.concatenate([x, extra[:, None]], axis=1), 4 * REPLICAS)
    lists, far = lists[:, :REPLICAS], far[:, :REPLICAS]
    return lists, (lists >= 0) & (far <= far[:, :1] * REPLICATE**2 + 1e-12)


def lists_read(graph: CentroidGraph, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists by distance from each query, and which of them it reads."""
    lists, far = graph.closest(np.concatenate([q, np.zeros((len(q), 1))], axis=1), least)
    return lists, (lists >= 0) & ((far <= far[:, :1] * PRUNE**2 + 1e-12) | (np.arange(lists.shape[1]) < least))


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def exact(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The k nearest of a few queries by brute force: every task compares its rows with all of them."""
    names = ["cell", "kind", "id", "v", "mask"]

    def cell(ids: pa.Array, v: pa.Array, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int64)), pa.array(np.full(len(ids), kind, np.int32)), ids, v, pa.array(np.ones(len(ids), np.int32))], names)

    def scan(batches):
        flat = pa.array(q.ravel(), pa.float64())
        asked = cell(pa.array(q_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32()), flat), 0)
        own = (cell(b.column(0).slice(a, CHUNK), b.column(1).slice(a, CHUNK), 1) for b in batches for a in range(0, len(b), CHUNK))
        yield from _scan(itertools.chain([asked], own), k)

    return ranked(arrow(rows.select("vec_id", "v"), scan, "query_id long, vec_id long, score double"), k)


def lists_to_read(rows: DataFrame, graph: CentroidGraph, top: float, is_query: str, k: int) -> int:
    """How many of its closest lists each query has to read for ``TARGET`` of the neighbours of the calibration queries."""
    asked = rows.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toArrow().combine_chunks()
    if not len(asked):
        return 1
    q_ids, first = np.unique(asked["vec_id"].to_numpy(), return_index=True)
    q = matrix(asked["v"].combine_chunks())[first]
    # at most k rows of each calibration query; rows that share an id are told apart by their scores
    truth = exact(rows, q_ids, q, k).withColumnRenamed("score", "wanted")
    near = F.broadcast(truth).join(rows.select("vec_id", "v"), "vec_id").select("query_id", "vec_id", "wanted", "v").distinct().toArrow().combine_chunks()
    if not len(near):
        return 1
    owner, x = np.searchsorted(q_ids, near["query_id"].to_numpy()), matrix(near["v"].combine_chunks())
    same = np.isclose((q[owner] * x).sum(1), near["wanted"].to_numpy(), rtol=1e-9, atol=1e-12)
    owner, x = owner[same], x[same]
    order, _ = lists_read(graph, q, len(graph.centroids))
    place = np.empty_like(order)  # of each list in the order of each query
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    lists, holds = lists_of(graph, top, x)
    need = np.where(holds, place[owner[:, None], lists], len(graph.centroids)).min(1) + 1
    return int(np.sort(need)[math.ceil(TARGET * len(need)) - 1])


def postings(rows: DataFrame, graph: CentroidGraph, top: float, is_query: str, least: int) -> DataFrame:
    """(group, kind, id, v, mask): every vector with its lists (kind 1), every query with the lists that it reads (kind 0)."""

    def assign(batches):
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                ids, v, asks = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1)), np.array(part.column(2).to_pylist(), bool)
                for kind, chosen in ((1, slice(None)), (0, asks)):
                    x = v[chosen]
                    if not len(x):
                        continue
                    lists, near = lists_of(graph, top, x) if kind else lists_read(graph, x, least)
                    rows_of, at = np.nonzero(near)
                    place = lists[rows_of, at]
                    key = rows_of * (1 << 32) + place // GROUP  # a vector and a group of lists
                    once, which = np.unique(key, return_inverse=True)
                    masks = np.zeros(len(once), np.int32)
                    np.bitwise_or.at(masks, which, (1 << (place % GROUP)).astype(np.int32))
                    owners, groups, own = once >> 32, (once & 0xFFFFFFFF).astype(np.int32), ids[chosen]
                    for b in range(0, len(owners), CHUNK):
                        owner, cells = owners[b : b + CHUNK], groups[b : b + CHUNK]
                        flat = pa.array(x[owner].ravel(), pa.float64())
                        v_out = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1) * x.shape[1], pa.int32()), flat)
                        out = [pa.array(cells, pa.int32()), pa.array(np.full(len(owner), kind), pa.int32()), pa.array(own[owner], pa.int64()), v_out]
                        yield pa.RecordBatch.from_arrays([*out, pa.array(masks[b : b + CHUNK])], ["group", "kind", "id", "v", "mask"])

    return arrow(rows.select("vec_id", "v", F.expr(is_query)), assign, "group int, kind int, id long, v array<double>, mask int")


def nearest(table: DataFrame, k: int = 20, is_query: str = "vec_id % 20 = 0") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row among all other rows."""
    spark = table.sparkSession
    rows = usable(table)
    index = build_index(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    least = lists_to_read(rows, *index, is_query, k)
    lists = written(postings(rows, *index, is_query, least), "postings")
    # LISTS / GROUP rows at most
    sizes = lists.groupBy("group").agg(F.ceil(F.sum("kind") / CHUNK).cast("int").alias("vs"), F.ceil(F.sum(1 - F.col("kind")) / CHUNK).cast("int").alias("qs"))
    dealt = lists.join(F.broadcast(sizes), "group").where("vs > 0 and qs > 0")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("kind") == 1, F.col("vs")).otherwise(F.col("qs")))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 1, F.col("qs")).otherwise(F.col("vs")) - 1)))
    v_chunk, q_chunk = (F.when(F.col("kind") == 1, F.col(a)).otherwise(F.col(b)).cast("long") for a, b in (("own", "other"), ("other", "own")))
    dealt = dealt.select((F.col("group").cast("long") * (1 << 40) + v_chunk * (1 << 20) + q_chunk).alias("cell"), "kind", "id", "v", "mask")
    found = arrow(dealt.repartition("cell").sortWithinPartitions("cell", "kind"), lambda b: _scan(b, k), "query_id long, vec_id long, score double")
    return ranked(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(table: str = "embeddings", k: int = 20, is_query: str = "vec_id % 20 = 0") -> str:
    """Brute force in DuckDB's SQL. Tables of fewer than ``2 * LIST`` vectors are one list, so that all neighbours are found and the
    rows are the same; on larger ones the operator finds most of them."""
    product = "list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda s, x: s + x)"
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM {table}),
fine AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, {product} AS score FROM (SELECT * FROM fine WHERE {is_query}) q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored QUALIFY rank <= {k}
"""
