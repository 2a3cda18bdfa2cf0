"""Token-ID output: Elias-Fano document boundaries over one concatenated id array.

Texts are range-partitioned and sorted by id, encoded once, and cut into segments of bounded size. A segment holds

    magic, id width, select step, documents, those without an id, smallest id, ids, ids of this part before it, low bits  (header)
    Elias-Fano document ids, less the smallest (those without an id come first and are only counted)
    Elias-Fano ends: low bits packed, high bits in unary, a select sample every ``STEP`` ones
    ids, 2 bytes each where the vocabulary allows, else 4

so a boundary costs about ``2 + log2(ids / documents)`` bits instead of 64, and neither boundaries nor document ids need a 64-bit
table: ``select`` finds one, ``some`` a run of them, from the closest sample on.
Segments are the rows of a Parquet table: Spark's commit protocol makes writes survive lost executors, and any store
that Spark reads will do.

Defined cases: null text is empty (only the end id); null ids sort first; rows that share an id are ordered by a hash of
their text, equal rows are all kept; an empty table writes no segment; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import arrow, text_or_empty
from tallgrass.llm.encoders import SpaceLedEncoder, encoder
from tallgrass.session import new_path

MAGIC, STEP = b"TGIDSEF2", 256
HEADER = struct.Struct("<8sHHIIqQQII")
MOST_DOCS, SPAN = 1 << 16, 1 << 62  #: documents of a segment, and difference of their ids
SEGMENTS = "part long, segment long, first_id long, n_ids long, n_docs long, data binary"
READ = "doc_id long, local_start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of ``n`` values up to ``top`` in about ``n * (2 + log2(top / n))`` bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.int64)
        low_bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1 if low_bits else np.zeros((n, 0), np.int64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[::STEP].astype(np.uint32))

    def _low(self, i: int) -> int:
        bit = i * self.low_bits
        chunk = int.from_bytes(self.low[bit // 8 : (bit + self.low_bits) // 8 + 1].tobytes(), "little")
        return (chunk >> (bit % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value ``i``: jump to the sampled one before it, then scan fewer than ``STEP`` ones."""
        at, left = int(self.samples[i // STEP]), i % STEP
        byte, skip = at // 8, at % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            ones = np.flatnonzero(bits[skip:])
            if left < len(ones):
                return ((8 * byte + skip + int(ones[left]) - i) << self.low_bits) | self._low(i)
            left, byte, skip = left - len(ones), byte + 64, 0

    def some(self, a: int, b: int) -> np.ndarray:
        """Values ``a`` to ``b - 1``: only the bits between their samples are looked at."""
        if a >= b:
            return np.zeros(0, np.int64)
        first, after = int(self.samples[a // STEP]), (b - 1) // STEP + 1
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : end], bitorder="little")) + first // 8 * 8
        ones = ones[np.searchsorted(ones, first) + a % STEP :][: b - a]
        k, at = self.low_bits, a * self.low_bits
        bits = np.unpackbits(self.low[at // 8 : -(-b * k // 8)], bitorder="little")[at % 8 :][: (b - a) * k].reshape(b - a, k)
        low = bits.astype(np.int64) @ (1 << np.arange(k, dtype=np.int64)) if k else 0
        return ((ones - np.arange(a, b)) << k) | low

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return struct.pack("<III", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, n: int, low_bits: int, data: memoryview) -> tuple[EliasFano, int]:
        sizes = struct.unpack_from("<III", data)
        edges = 12 + np.cumsum([0, *sizes])
        low, high, samples = (np.frombuffer(data[a:b], kind) for a, b, kind in zip(edges, edges[1:], ("u1", "u1", "<u4"), strict=False))
        return cls(n, low_bits, low, high, samples), int(edges[-1])


def pack_segment(doc_ids: list, ids: list[bytes], first_id: int, width: int) -> bytes:
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    bounds = EliasFano.build(ends, total)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    names = EliasFano.build(known - least, int(known[-1]) - least if len(known) else 0)
    body = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    return b"".join((
        HEADER.pack(MAGIC, width, STEP, len(doc_ids), len(doc_ids) - len(known), least, total, first_id, names.low_bits, bounds.low_bits),
        names.to_bytes(),
        bounds.to_bytes(),
        body,
    ))


class Segment:
    """A segment read back: its boundaries, its ids and those of its documents, as they stand in the file."""

    def __init__(self, data: bytes):
        magic, width, _, self.n, self.nameless, self.least, total, self.first_id, low_names, low_bounds = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        view, at = memoryview(data), HEADER.size
        self.names, used = EliasFano.from_bytes(self.n - self.nameless, low_names, view[at:])
        at += used
        self.bounds, used = EliasFano.from_bytes(self.n, low_bounds, view[at:])
        self.ids = np.frombuffer(view[at + used :], f"<u{width}")
        if len(self.ids) != total:
            raise ValueError("truncated segment")

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i``, by two selects."""
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]

    def runs(self):
        """Document ids (None where there is none), starts and ends of ``STEP`` documents at a time."""
        end = 0
        for a in range(0, self.n, STEP):
            b = min(self.n, a + STEP)
            ends = self.bounds.some(a, b)
            names = self.names.some(max(0, a - self.nameless), max(0, b - self.nameless)) + self.least
            yield [None] * (b - a - len(names)) + names.tolist(), [end, *ends[:-1].tolist()], ends.tolist()
            end = int(ends[-1])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 20) -> None:
    """Encode every whole text and write the segments, in ascending id order, to ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def build(batches):
        encode, end = encoder(SpaceLedEncoder, tokenizer), struct.pack("<I", end_id)
        width = 2 if max(encode.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, segment, first, doc_ids, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict({"part": [part], "segment": [segment], "first_id": [first], "n_ids": [held], "n_docs": [len(ids)], "data": [pack_segment(doc_ids, ids, first, width)]})

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), encode.many(batch.column(1)), strict=True):
                got += end
                if ids and (held >= segment_ids or len(ids) >= MOST_DOCS or (doc_ids[-1] is not None and doc_id - next(x for x in doc_ids if x is not None) >= SPAN)):
                    yield flush()
                    segment, first, doc_ids, ids, held = segment + 1, first + held, [], [], 0
                doc_ids.append(doc_id)
                ids.append(got)
                held += len(got) // 4
        if ids:
            yield flush()

    arrow(rows, build, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    Each segment knows the ids of its part before it; only the totals of the parts (one row for each partition of the
    write) are summed up and broadcast.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def unpack(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segment = Segment(data)
                out: list[list] = [[], [], [], []]
                for names, starts, ends in segment.runs():
                    raw = memoryview(segment.ids[starts[0] : ends[-1]].astype("<u4").tobytes())
                    out[0] += names
                    out[1] += [segment.first_id + a for a in starts]
                    out[2] += [b - a for a, b in zip(starts, ends, strict=True)]
                    out[3] += [zlib.crc32(raw[4 * (a - starts[0]) : 4 * (b - starts[0])]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * segment.n, pa.int64()), *(pa.array(x, pa.int64()) for x in out)], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    read = arrow(segments.select("part", "data"), unpack, "part long, " + READ)
    return read.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
