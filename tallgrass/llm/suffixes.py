"""Exact removal of repeated substrings by longest previous factors in suffix order.

A byte goes if it is covered by a string of ``length`` bytes that also starts elsewhere (``keep="none"``), or that starts
earlier in the corpus (``keep="first"``, earlier by doc_id, then text hash, then position). Sorting all suffixes of a large corpus is out of the
question, and not needed:

1. *Cells.* Every window of ``length`` bytes has an anchor, its minimal ``GRAM``-gram by hash; equal windows have equal
   anchors at equal places. A cell is a run of windows with one anchor. An anchor seen once has no repeated window.
2. Of the repeated anchors, each distinct cell (by 128 bits: the hashes of its anchor and of its bytes) is looked at once. A
   cell that occurs twice is repeated as a whole.
3. *Suffix order.* The distinct cells of an anchor are put one after the other in corpus order, their window suffixes are
   sorted by their bytes, and the common prefixes of neighbours are measured (up to ``length``). For each suffix the
   previous and the next smaller position in suffix order are found; the longer prefix shared with one of the two is its
   longest previous factor. Where that reaches ``length`` the window has been met before, at that smaller position.
4. Spans of cells are carried to all their occurrences and joined for each document.

Anchors with more than ``CELLS_HELD`` distinct cells are too large for one task's memory. Spark sorts their windows (ranges of
the same suffix order, over all tasks), and a pass over the sorted rows finds the same: among suffixes that agree on all
``length`` bytes and stand in corpus order, the previous smaller position is the row before. Shuffled rows are cells, about
one for each ``(length - GRAM) / 2`` bytes, and only repeated ones go further than the first count.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; rows that share an id are ordered by text
hash; rows that share id and text are occurrences of their own, but with ``keep="first"`` they are told apart by nothing
and keep the same bytes; null ids come first; an empty table gives an empty result; other columns are kept by ``remove``
and ignored by the query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import PolyHash, arrow, bounded, compact, dropped, fresh, mix64, quoted, stored, text_or_empty

LENGTH, GRAM = 200, 64
SEGMENT = 1 << 19  #: windows handled at once in a long text
CELLS_HELD = 4096  #: cells of an anchor that one task sorts in memory
BATCH = 1 << 20  #: bytes of cells that are sorted at once


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` successive values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def cells_of(data: np.ndarray, poly: PolyHash, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, cell hash, first window and number of windows of each cell of a text."""
    parts = []
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        own = data[at : at + SEGMENT + length - 1]
        prefix = poly.prefix(own)
        grams = poly.windows(prefix, gram)
        place = np.uint64((1 << 20) - 1)
        least = sliding_minimum((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        anchor = (least & place).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.append(first, len(anchor)))
        spot = anchor[first]
        with np.errstate(over="ignore"):
            cell = mix64(poly.spans(prefix, first, first + count + length - 1) + (spot - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        parts.append((grams[spot], cell, first + at, count))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def suffix_order(data: bytes, starts: list[int], edges: list[int], length: int) -> np.ndarray:
    """Indices of ``starts`` in suffix order (``length`` bytes, then position), within each group ``edges[i]:edges[i+1]``."""
    order: list[int] = []
    for a, b in zip(edges, edges[1:], strict=False):
        suffixes = [data[at : at + length] for at in starts[a:b]]
        order += [a + i for i in sorted(range(b - a), key=suffixes.__getitem__)]
    return np.array(order, np.int64)


def common_prefixes(data: bytes, starts: np.ndarray, length: int, step: int = 1 << 14) -> np.ndarray:
    """Bytes that the suffix at each place shares with the one before it, ``length`` at most (0 for the first)."""
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    out = np.zeros(len(starts), np.int64)
    for a in range(1, len(starts), step):
        own = rows[starts[a - 1 : a + step]]
        differ = own[1:] != own[:-1]
        out[a : a + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return out


def smaller_before(position: np.ndarray, shared: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the closest place before it with a smaller position (-1: none), and the prefix shared with that one.

    ``shared`` is the prefix shared with the place before. Minima over 1, 2, 4, ... places are tabulated; each search jumps
    back over runs of larger positions, longest runs first. No search goes back ``longest`` places or more.
    """
    tables = [(position, shared)]
    while 1 << len(tables) < longest:
        span, (p, s) = 1 << (len(tables) - 1), tables[-1]
        tables.append(tuple(np.concatenate((x[:span], np.minimum(x[span:], x[:-span]))) for x in (p, s)))
    at, least = np.arange(len(position)) - 1, shared.copy()
    for k in reversed(range(len(tables))):
        p, s = tables[k]
        jump = (at >= (1 << k) - 1) & (p[at] > position)
        least = np.where(jump, np.minimum(least, s[at]), least)
        at = np.where(jump, at - (1 << k), at)
    found = (at >= 0) & (position[at] < position)
    return np.where(found, at, -1), np.where(found, least, 0)


def previous_factors(position: np.ndarray, shared: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of the suffix at each place of the suffix order, and the place of the earlier match (-1: none)."""
    last = len(position) - 1
    before, by_before = smaller_before(position, shared, longest)
    after, by_after = smaller_before(position[::-1], np.concatenate((shared[:1] * 0, shared[:0:-1])), longest)
    after, by_after = np.where(after >= 0, last - after, -1)[::-1], by_after[::-1]
    factor = np.maximum(by_before, by_after)
    return factor, np.where(factor > 0, np.where(by_before >= by_after, before, after), -1)


def factors(data: bytes, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of each suffix within its group, up to ``length``, and the index of its earlier match (-1: none).

    ``starts`` rise, ``group`` too.
    """
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    order = suffix_order(data, starts.tolist(), edges.tolist(), length)
    shared = common_prefixes(data, starts[order], length)
    shared[edges[:-1]] = 0
    found, match = previous_factors(order, shared, int(np.diff(edges).max()))
    factor, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    factor[order], source[order] = found, np.where(match >= 0, order[match], -1)
    return factor, source


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each run of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pairs(mask: np.ndarray) -> list[int]:
    """Runs of windows as a flat list: first, last + 1, ..."""
    return np.stack(runs(mask), axis=1).ravel().tolist()


CELLS = "did long, k1 long, anchor long, cell long, start long, count long"
SPANS = "anchor long, cell long, before array<long>, either array<long>"


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("did"), text_or_empty().alias("text"))
    return rows.select("did", F.xxhash64("text").alias("k1"), "text")


def repeated_spans(docs: DataFrame, keep: str = "none", length: int = LENGTH) -> DataFrame:
    """did, k1 (hash of the text) and spans (flat list of first byte, last byte + 1 of each removed run) of the documents
    that lose something."""
    spark, texts = docs.sparkSession, _texts(docs)

    def find(batches):
        poly = PolyHash()
        for batch in batches:
            made = [cells_of(np.frombuffer(t.as_py().encode(), np.uint8), poly, length) for t in batch.column(2)]
            sizes = [len(m[0]) for m in made]
            for a in range(0, len(made), 256):
                some = made[a : a + 256]
                flat = [np.concatenate(x) for x in zip(*some, strict=True)]
                owner = pa.array(np.repeat(np.arange(a, a + len(some)), sizes[a : a + 256]))
                cells = [pa.array(flat[0].view(np.int64)), pa.array(flat[1].view(np.int64)), pa.array(flat[2]), pa.array(flat[3])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *cells], [x.split()[0] for x in CELLS.split(", ")])

    cells = stored(arrow(texts, find, CELLS), "cells")
    anchors = cells.groupBy("anchor").agg(F.count("*").alias("n"), F.min("cell").alias("a"), F.max("cell").alias("b")).where("n > 1")
    anchors = stored(anchors.select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchors")
    seen = stored(cells.join(anchors, "anchor"), "seen")
    dropped(cells, anchors)
    place = F.struct("did", "k1", "start", "count")
    distinct = stored(seen.groupBy("anchor", "cell").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.min(place).alias("first")), "distinct")
    sizes = stored(distinct.where("mixed").groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > CELLS_HELD).select("anchor", F.lit(True).alias("large")), "large")

    # bytes of each distinct cell of a mixed anchor, cut from the first text that has it
    cell = F.struct("anchor", "cell", F.col("first.start").alias("start"), F.col("first.count").alias("count"), F.coalesce("large", F.lit(False)).alias("large"))
    wanted = distinct.where("mixed").join(sizes, "anchor", "left").select("first.did", "first.k1", cell.alias("c"))
    wanted = wanted.groupBy("did", "k1").agg(F.collect_list("c").alias("cells"))
    cut = texts.alias("t").join(wanted.alias("w"), F.col("t.did").eqNullSafe(F.col("w.did")) & (F.col("t.k1") == F.col("w.k1"))).select("t.did", "t.k1", "text", "cells")

    def take(batches):
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
        for batch in batches:
            for r in range(0, len(batch), 64):
                out: list[list] = [[] for _ in kinds]
                for did, k1, text, own in zip(*(c.slice(r, 64).to_pylist() for c in batch.columns), strict=True):
                    data = text.encode()
                    for c in own:
                        for values, x in zip(out, (c["anchor"], c["cell"], did, k1, c["start"], c["large"], data[c["start"] : c["start"] + c["count"] + length - 1]), strict=True):
                            values.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["anchor", "cell", "did", "k1", "start", "large", "data"])

    strings = stored(arrow(cut, take, "anchor long, cell long, did long, k1 long, start long, large boolean, data binary"), "strings")

    def sort(batches):
        held, size = [], 0

        def solve():
            rows, last = [], None
            for row in held:  # copies of one text deliver a cell twice
                if (row[0], row[1]) != last:
                    rows.append(row)
                last = (row[0], row[1])
            # corpus order within an anchor
            rows.sort(key=lambda r: (r[0], r[2] is not None, r[2] or 0, r[3], r[4]))
            data = b"".join([r[5] for r in rows])
            edges = np.cumsum([0, *(len(r[5]) for r in rows)])
            counts = np.array([len(r[5]) - length + 1 for r in rows])
            own = np.repeat(np.arange(len(rows)), counts)
            starts = edges[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            anchors = np.array([r[0] for r in rows])
            group = np.cumsum(np.concatenate(([False], anchors[1:] != anchors[:-1])))
            factor, source = factors(data, starts, group[own], length)
            before = factor >= length
            either = before.copy()
            either[source[before]] = True
            ends = np.cumsum(counts)
            found = [(r[0], r[1], _pairs(before[e - c : e]), _pairs(either[e - c : e])) for r, c, e in zip(rows, counts.tolist(), ends.tolist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], ["anchor", "cell", "before", "either"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BATCH and held[-1][0] != row[0]:
                    yield solve()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve()

    small = strings.where("not large").select("anchor", "cell", "did", "k1", "start", "data").repartition("anchor").sortWithinPartitions("anchor", "cell")
    spans = stored(arrow(small, sort, SPANS), "spans")

    large = strings.where("large").dropDuplicates(["anchor", "cell"])
    if not strings.where("large").isEmpty():

        def deal(batches):
            for batch in batches:
                for r in range(len(batch)):
                    data = batch.column(5)[r].as_py()
                    n = len(data) - length + 1
                    same = [pa.repeat(batch.column(c)[r], n) for c in range(4)]
                    windows = pa.array([data[i : i + length] for i in range(n)], pa.binary())
                    at = pa.array(np.arange(n) + batch.column(4)[r].as_py())
                    yield pa.RecordBatch.from_arrays([*same, at, pa.array(np.arange(n)), windows], ["anchor", "cell", "did", "k1", "at", "off", "window"])

        def meet(batches):
            """Of rows in suffix order: whether a window equals the one before it, and whether it equals one of its neighbours."""

            def out(cells, before, either):
                return pa.RecordBatch.from_arrays([*cells, pa.array(before), pa.array(either)], ["anchor", "cell", "off", "before", "either"])

            wait = None  # the last row waits for the next batch
            for batch in batches:
                n, same = len(batch), np.zeros(len(batch) + 1, bool)
                if not n:
                    continue
                first, last = ([c[i].as_py() for c in batch.columns] for i in (0, n - 1))
                same[1:n] = True
                for k in (0, 6):
                    x = batch.column(k)
                    same[1:n] &= pa.compute.equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                if wait is not None:
                    held, before = wait
                    same[0] = held[0] == first[0] and held[6] == first[6]
                    yield out([pa.array([held[k]], pa.int64()) for k in (0, 1, 5)], [before], [bool(before or same[0])])
                yield out([batch.column(k).slice(0, n - 1) for k in (0, 1, 5)], same[: n - 1], same[: n - 1] | same[1:n])
                wait = last, bool(same[n - 1])
            if wait is not None:
                held, before = wait
                yield out([pa.array([held[k]], pa.int64()) for k in (0, 1, 5)], [before], [before])

        columns = "anchor long, cell long, did long, k1 long, at long, off long, window binary"
        windows = arrow(large.select("anchor", "cell", "did", "k1", "start", "data"), deal, columns)
        sorted_ = windows.repartitionByRange("anchor", "window").sortWithinPartitions("anchor", "window", "did", "k1", "at")
        met = arrow(sorted_, meet, "anchor long, cell long, off long, before boolean, either boolean").where("either")
        met = met.groupBy("anchor", "cell").agg(F.collect_list(F.when(F.col("before"), F.col("off"))).alias("before"), F.collect_list("off").alias("either"))

        def gather(batches):
            for batch in batches:
                out = []
                for c in (2, 3):
                    flat = []
                    for offs in batch.column(c).to_pylist():
                        mask = np.zeros(max(offs, default=-1) + 1, bool)
                        mask[offs] = True
                        flat.append(_pairs(mask))
                    out.append(pa.array(flat, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["anchor", "cell", "before", "either"])

        spans = spans.union(stored(arrow(met, gather, SPANS), "spans"))

    # from cells to their occurrences
    info = stored(distinct.join(spans, ["anchor", "cell"], "left").select("anchor", "cell", "n", "first", "before", "either"), "info")
    dropped(strings, distinct)
    met = seen.drop("mixed").join(info, ["anchor", "cell"])
    whole = F.array(F.lit(0).cast("long"), F.col("count"))
    if keep == "first":
        mine = F.col("first").eqNullSafe(place)
        flat = F.when(mine, F.col("before")).otherwise(whole)
    else:
        flat = F.when(F.col("n") > 1, whole).otherwise(F.col("either"))
    met = met.select("did", "k1", "start", flat.alias("flat")).where("size(flat) > 0").distinct()
    met = met.groupBy("did", "k1").agg(F.collect_list(F.struct("start", "flat")).alias("found"))

    def join_runs(batches):
        for batch in batches:
            out = []
            for found in batch.column(2).to_pylist():
                pairs = sorted((f["start"] + f["flat"][i], f["start"] + f["flat"][i + 1] + length - 1) for f in found for i in range(0, len(f["flat"]), 2))
                flat: list[int] = []
                for a, b in pairs:
                    if flat and a <= flat[-1]:
                        flat[-1] = max(flat[-1], b)
                    else:
                        flat += [a, b]
                out.append(flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["did", "k1", "spans"])

    result = stored(arrow(met, join_runs, "did long, k1 long, spans array<long>"), "removed")
    dropped(seen, info, spans)
    return result


def without(data: bytes, spans: list[int] | None) -> bytes:
    spans = spans or []
    return b"".join(data[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], len(data)], strict=True))


def whole_characters(data: bytes, spans: list[int] | None) -> list[int]:
    """The spans without the parts of characters at their ends."""
    out = []
    for a, b in zip((spans or [])[::2], (spans or [])[1::2], strict=True):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out += [a, b]
    return out


def without_whole_characters(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        data = None if text is None else text.encode()
        out.append(None if text is None else without(data, whole_characters(data, own)).decode())
    return pa.array(out, pa.string())


def remove(docs: DataFrame, keep: str = "first", length: int = LENGTH) -> DataFrame:
    """The documents with the repeated spans cut out of ``text`` (to whole characters) and ``n_chars`` brought up to date.

    Python gets the texts that lose something, and nothing else.
    """
    bounded(docs.sparkSession)
    spans = repeated_spans(docs, keep, length)
    did, k1, own = (fresh(docs, n) for n in ("__did", "__k1", "__spans"))
    keyed = docs.withColumns({did: F.col("doc_id").cast("long"), k1: F.xxhash64(text_or_empty())}).alias("t")
    joined = keyed.join(spans.alias("s"), F.col(f"t.{did}").eqNullSafe(F.col("s.did")) & (F.col(f"t.{k1}") == F.col("s.k1")), "left")
    joined = joined.select(*(F.col(f"t.{c}") for c in quoted(docs.columns)), F.col("s.spans").alias(own))
    hit, kind = F.col(own).isNotNull(), docs.schema["text"].dataType
    text = F.when(hit, F.arrow_udf(without_whole_characters, "string")(F.when(hit, F.col("text").cast("string")), F.col(own)).cast(kind)).otherwise(F.col("text"))
    out = compact(joined.withColumn("text", text).drop(own))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = repeated_spans(docs)
    joined = _texts(docs).alias("t").join(spans.alias("s"), F.col("t.did").eqNullSafe(F.col("s.did")) & (F.col("t.k1") == F.col("s.k1")), "left").select("t.did", "text", "spans")

    def digest(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                kept = without(data, own)
                for values, x in zip(out, (len(data), len(data) - len(kept), len(own or []) // 2, hashlib.sha256(kept).hexdigest()), strict=True):
                    values.append(x)
            made = [pa.array(v, k) for v, k in zip(out, [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow(joined, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
