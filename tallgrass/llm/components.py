"""Connected components by repeated local contraction, on DataFrames.

In each round every node joins the neighbour (or itself) that comes first in a fresh random order; joined nodes become one,
so that a constant share of the nodes goes away in a round whatever the shape, chains and stars included. Minima are
aggregated before the shuffle, relabelling is a join whose hot keys adaptive execution can split. Each round is a written
table. Once at most ``SMALL`` edges are left, one task finishes them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import arrow, stored

SMALL = 10_000


def _union_find(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["label", "to"])


def forest(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links ``mask`` between nodes ``a`` (rows) and ``b`` (columns)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    rows, columns = place[: len(a)], place[len(a) :]
    root, us, vs = np.arange(len(nodes)), [], []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left = mask
    while True:
        left = left & (root[rows][:, None] != root[columns][None])
        some = np.flatnonzero(left.any(axis=1))
        if not len(some):
            return nodes[us], nodes[vs]
        for r, c in zip(rows[some], columns[left[some].argmax(axis=1)], strict=True):
            x, y = find(r), find(c)
            if x != y:
                root[max(x, y)] = min(x, y)
                us.append(r)
                vs.append(c)
        while (root != root[root]).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node of the edges ``u``, ``v`` (long)."""
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    labels, rounds = None, 0
    while True:
        count = edges.count()
        if count <= SMALL:
            last = stored(arrow(edges.coalesce(1), _union_find, "label long, to long"), "roots") if count else None
        else:
            order = lambda c: F.struct(F.xxhash64(F.lit(rounds), c).alias("p"), F.col(c).alias("to"))  # noqa: B023, E731
            both = edges.select("u", "v").union(edges.select("v", "u"))
            best = both.groupBy(F.col("u").alias("label")).agg(F.min(order("v")).alias("best"))
            own = F.struct(F.xxhash64(F.lit(rounds), "label").alias("p"), F.col("label").alias("to"))
            last = stored(best.select("label", F.least("best", own)["to"].alias("to")), "roots")
        if last is not None:
            if labels is None:
                labels = last.select(F.col("label").alias("node"), F.col("to").alias("label"))
            else:
                labels = labels.join(last, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = stored(labels, "labels")
        if count <= SMALL:
            break
        for end in ("u", "v"):
            edges = edges.join(last.withColumnRenamed("label", end), end).drop(end).withColumnRenamed("to", end)
        edges = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        rounds += 1
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    smallest = stored(labels.groupBy("label").agg(F.min("node").alias("component")), "smallest")
    return labels.join(smallest, "label").select("node", "component")
