"""Hierarchical multi-length packing.

A document's ids are first cut into full windows of the longest tier. What is left is routed to the smallest tier that
holds it. Tiers are packed from long to short: a window opens with a piece of its own tier and its gap is filled with the
largest pieces of shorter tiers that fit; a piece is cut only where none fits. The rest of a group that fills no window is
laid into windows of falling powers of two, so that nothing is padded. Windows of one tier form step groups of equal
tokens over all tasks: the pieces are written, the windows of each task and tier are counted, and a window's place among all of
its tier settles its group. Only the last group of a tier may hold fewer tokens; ``step_full`` tells.

Each task packs the rows it reads in groups of bounded size; groups follow the rows, and so do the windows of a group, each
by its first document. Sequence ids rise in that order from task to task. So there is no shuffle, memory is bounded, and a lost task
packs the same rows the same way again.

Defined cases: null text is empty (one piece: the end id); every row is packed, rows that share an id or are equal
included; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import arrow, text_or_empty, written
from tallgrass.llm.encoders import SpaceFreeEncoder, encoder

TIERS = (4096, 2048, 1024, 512, 256)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, nth long"


def pack_group(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (size, [(document index, start, length)]) that hold every id of documents of these lengths."""
    longest, windows = tiers[0], []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), sorted
    for d, n in enumerate(lengths):
        full = n - n % longest
        windows += [(longest, [(d, at, longest)]) for at in range(0, full, longest)]
        if n > full:
            pools[min(t for t in tiers if t >= n - full)].append((n - full, d, full))
    for pool in pools.values():
        pool.sort()

    def take(most: int, below: int) -> tuple[int, int, int] | None:
        """The largest piece of at most ``most`` ids in the tiers from position ``below`` on."""
        for t in tiers[below:]:
            at = bisect_right(pools[t], (most, 1 << 60, 0))
            if at:
                return pools[t].pop(at - 1)
        return None

    def cut(gap: int, below: int) -> tuple[int, int, int] | None:
        """The first ``gap`` ids of the shortest larger piece; its rest is routed again."""
        for t in reversed(tiers[below:]):
            at = bisect_right(pools[t], (gap, 1 << 60, 0))
            if at < len(pools[t]):
                n, d, start = pools[t].pop(at)
                insort(pools[min(x for x in tiers if x >= n - gap)], (n - gap, d, start + gap))
                return gap, d, start
        return None

    tail = []
    for k, t in enumerate(tiers):
        while pools[t]:
            room, inside = t, []
            while room:
                got = (pools[t].pop() if not inside else None) or take(room, k) or cut(room, k)
                if got is None:
                    break
                inside.append((got[1], got[2], got[0]))
                room -= got[0]
            if room:  # every shorter tier is empty
                tail += inside
            else:
                windows.append((t, inside))
    left = sum(n for _, _, n in tail)
    while left:
        size = min(longest, 1 << (left.bit_length() - 1))
        room, inside = size, []
        while room:
            d, start, n = tail.pop()
            part = min(n, room)
            inside.append((d, start, part))
            if n > part:
                tail.append((d, start + part, n - part))
            room -= part
        windows.append((size, inside))
        left -= size
    return windows


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    tiers: tuple[int, ...] = TIERS, group_ids: int = 1 << 20, step_ids: int = 1 << 16,
) -> DataFrame:
    """Pieces of every document. ``group_ids`` bounds the ids held by a task; a step group has ``step_ids`` ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (size of the window), step_group (of the tier), step_full.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def pack(batches):
        encode, end = encoder(SpaceFreeEncoder, tokenizer), struct.pack("<I", end_id)
        task = TaskContext.get().partitionId()
        sequence = task << 36
        seen: dict[int, int] = {}  # windows so far, by size
        doc_ids, ids, held = [], [], 0

        def flush():
            nonlocal sequence
            out: list[list] = [[] for _ in range(10)]
            windows = pack_group([len(x) // 4 for x in ids], tiers)
            # sequences follow the rows: a window stands where its first document does
            for size, inside in sorted(windows, key=lambda w: min((d, start) for d, start, _ in w[1])):
                nth, offset = seen.get(size, 0), 0
                seen[size] = nth + 1
                for d, start, n in inside:
                    row = (doc_ids[d], start, n, zlib.crc32(memoryview(ids[d])[4 * start : 4 * (start + n)]), len(ids[d]) // 4, sequence, offset, size, task, nth)
                    for values, x in zip(out, row, strict=True):
                        values.append(x)
                    offset += n
                sequence += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = encode(text) + end
                doc_ids.append(doc_id)
                ids.append(got)
                held += len(got) // 4
                if held >= group_ids:
                    yield flush()
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield flush()

    pieces = written(arrow(rows, pack, PIECES), "pieces")
    # windows of each tier before each task's: a row for each task and tier at most
    tasks = pieces.where("offset = 0").groupBy("tier", "task").agg(F.count("*").alias("n"))
    every, earlier = Window.partitionBy("tier"), Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("tier", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(every).alias("windows"))
    step, per = F.col("step_group"), F.greatest(F.lit(1), F.floor(F.lit(step_ids) / F.col("tier"))).cast("long")
    grouped = pieces.join(F.broadcast(tasks), ["tier", "task"]).withColumn("step_group", F.floor((F.col("before") + F.col("nth")) / per).cast("long"))
    grouped = grouped.withColumn("step_full", (step + 1) * per <= F.col("windows"))
    return grouped.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "step_full")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
