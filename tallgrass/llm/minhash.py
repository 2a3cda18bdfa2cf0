"""b-bit MinHash near-duplicates.

1. Each text becomes its set of word shingles (64-bit hashes), ``BANDS * ROWS`` minima, a hash for each band, and a packed
   signature that keeps only the low ``BITS`` bits of each minimum.
2. Documents with equal sets form a class; only its smallest id goes on.
3. Band buckets propose pairs: first every member with the bucket's smallest member. A pair whose collision-corrected
   similarity, estimated by bit counts on the packed signatures, is more than five standard deviations under the threshold
   is left out; all others are confirmed on the full sets.
4. In buckets that the confirmed links do not join into one component, members of different components are compared by
   their packed signatures (large buckets block by block); a spanning forest of the pairs that agree gives clusters. In a
   cluster of many, further members (one that lies outside the largest component, each time) are compared with all members of
   other components, ``PEELS`` times at most, so that nearly all of it is one component. Then full sets of different
   components are intersected by blocks: those outside the largest component among themselves and with it, never the largest
   with itself. A spanning forest of the true links is kept.
5. Links and classes give components.

So a group of m similar documents costs m confirmations, pairs are never listed by m * m, and no bucket is capped.

Defined cases: null text is empty; without words a document links with nothing; rows with a null id link with nothing and
are kept; rows that share an id are one document (linked if any of its texts is); an empty table gives an empty result;
other columns are kept by ``deduplicate`` and ignored by the query.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import arrow, compact, fresh, mix64, stored, text_or_empty
from tallgrass.llm.components import components, forest
from tallgrass.llm.shingles import Shingler

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
WORDS64 = MINIMA * BITS // 64
BUCKET, CLUSTER = 1024, 1 << 20  #: signatures, and bytes of full sets, that are compared at once (twice as many meet)
PEELS, MANY = 3, 64  #: rounds with a further member, for clusters of more members than these

_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64)


def minima(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minima of each (non-empty) set under every hash function: one row for each set."""
    out = np.empty((MINIMA, len(offsets) - 1), np.uint64)
    step = 1 << 14
    with np.errstate(over="ignore"):
        if len(shingles) <= step or len(offsets) == 2:
            for k in range(MINIMA):
                out[k] = np.minimum.reduceat(shingles * FACTORS[k] + TERMS[k], offsets[:-1])
        else:  # pieces that stay in the cache
            a = 0
            while a < len(offsets) - 1:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, "right")) - 1)
                out[:, a:b] = minima(shingles[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).T
                a = b
    return out.T


def packed(mins: np.ndarray) -> np.ndarray:
    """The low bits of the minima, ``64 // BITS`` to a word."""
    per = 64 // BITS
    low = (mins & np.uint64((1 << BITS) - 1)).reshape(len(mins), WORDS64, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


ONES = np.uint64(int("0001" * 16, 2))


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many retained minima agree, by bit counts, along the last axis."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return MINIMA - np.bitwise_count(x & ONES).sum(axis=-1, dtype=np.int64)


def least_matches(threshold: float) -> int:
    """Matches expected at the threshold, chance collisions of the low bits included, less five standard deviations."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return math.floor(MINIMA * p - 5 * math.sqrt(MINIMA * p * (1 - p)))


SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, signature binary"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def make(batches):
        shingler = Shingler(words)
        for batch in batches:
            for a, b, shingles, offsets in shingler.batches(batch.column(1)):
                sizes = np.diff(offsets)
                some = sizes > 0
                ends = np.concatenate((offsets[:-1][some], offsets[-1:]))
                h1, h2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                bands, sigs = [None] * (b - a), [None] * (b - a)
                if some.any():
                    with np.errstate(over="ignore"):
                        h1[some] = np.add.reduceat(mix64(shingles + np.uint64(1)), ends[:-1])
                        h2[some] = np.add.reduceat(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)), ends[:-1])
                        mins = minima(shingles, ends)
                        folded = np.zeros((len(mins), BANDS), np.uint64)
                        for r in range(ROWS):
                            folded = mix64(folded + mins.reshape(-1, BANDS, ROWS)[:, :, r])
                    for i, row, sig in zip(np.flatnonzero(some), folded.view(np.int64), packed(mins), strict=True):
                        bands[i], sigs[i] = row, sig.astype("<u8").tobytes()
                out = [pa.array(sizes, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], [x.split()[0] for x in SIGNATURE.split(", ")])

    return arrow(rows, make, SIGNATURE)


def _estimate(batches, least: int):
    """Pairs (u, v, su, sv) whose packed signatures agree often enough."""
    for batch in batches:
        su, sv = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, WORDS64) for i in (2, 3))
        yield batch.filter(pa.array(matches(su, sv) >= least)).select([0, 1])


def _groups(batches):
    """Lists of the columns of each run of rows with the same first value."""
    held: list[list] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][-1] != row[0]:
                yield held
                held = []
            held = held or [[] for _ in row]
            for values, x in zip(held, row, strict=True):
                values.append(x)
    if held:
        yield held


def _forests(batches, similar):
    """Groups of rows (group, side, label, node, payload): a spanning forest of the similar pairs of different labels.

    Rows of side 0 are compared among themselves, those of side 1 with those of side 2. ``similar`` gives the matrix.
    """
    for _, side, label, node, payload in _groups(batches):
        side, label, node = (np.array(x, np.int64) for x in (side, label, node))
        for a, b in ((0, 0), (1, 2)):
            x, y = np.flatnonzero(side == a), np.flatnonzero(side == b)
            if len(x) and len(y) and (a != b or len(x) > 1):
                mask = similar([payload[i] for i in x], [payload[i] for i in y]) & (label[x][:, None] != label[y][None])
                u, v = forest(mask, node[x], node[y])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _alike(a: list[bytes], b: list[bytes], least: int) -> np.ndarray:
    """Which packed signatures agree often enough."""
    x, y = (np.frombuffer(b"".join(s), "<u8").reshape(-1, WORDS64) for s in (a, b))
    return np.stack([matches(y, row) >= least for row in x])


def _same(a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Which full sets have 100 * intersection >= percent * union."""
    sets = [np.frombuffer(s, "<u8") for s in (*a, *b)]
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1  # shingles of one set only have no part in an intersection
    shared, row = count[column] > 1, np.repeat(np.arange(len(sets)), sizes)
    column, row = place[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common, step = np.zeros((len(a), len(b)), np.float64), 4096
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        at = slice(*np.searchsorted(column, (c, c + step)))
        dense = np.zeros((len(sets), step), np.float32)
        dense[row[at], column[at] - c] = 1
        common += dense[: len(a)] @ dense[len(a) :].T
    return 100 * common >= percent * (sizes[: len(a), None] + sizes[None, len(a) :] - common)


def _blocks(rows: DataFrame, keys: list[str], blocks, payload: str) -> DataFrame:
    """Rows dealt to pairs of blocks of their group (of so many ``blocks``), for ``_forests``."""
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _met(rows, keys, payload)


def _met(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Rows with their ``block`` and an ``other`` one, brought together."""
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("long")
    group = F.concat_ws(":", *keys, F.least("block", "other"), F.greatest("block", "other"))
    return rows.select(group.alias("group"), side.alias("side"), "label", "node", payload).repartition("group").sortWithinPartitions("group", "side", "node")


def _largest(members: DataFrame) -> DataFrame:
    """For each cluster (component) its members, and the label that most of them have."""
    sizes = members.groupBy("component", "label").agg(F.count("*").alias("n"))
    return sizes.groupBy("component").agg(F.sum("n").alias("members"), F.max_by("label", F.struct("n", "label")).alias("top"))


def _peeled(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Members (component, node, label) of clusters with labels joined by further confirmed links, and those links."""
    more = []
    for turn in range(PEELS):
        tops = _largest(members).where(F.col("members") > MANY)
        outside = members.join(tops, "component").where("label <> top")
        first = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("hub"), F.col("label").alias("own")))
        hubs = outside.groupBy("component").agg(first.alias("x")).select("component", "x.hub", "x.own")
        hubs = stored(hubs, "hubs")
        if hubs.isEmpty():
            break
        pairs = members.join(hubs, "component").where("label <> own").select(F.col("hub").alias("u"), F.col("node").alias("v"))
        links = stored(_confirm(pairs, sets, percent), "peeled")
        if links.isEmpty():
            break
        more.append(links)
        # a hub is of one cluster, so its links make one component of all the labels that it meets
        met = links.join(members.select(F.col("node").alias("v"), "component", "label"), "v").select("component", "label")
        met = met.union(links.select(F.col("u").alias("node")).distinct().join(members, "node").select("component", "label")).distinct()
        joined = met.join(met.groupBy("component").agg(F.min("label").alias("to")), "component")
        members = stored(members.join(joined, ["component", "label"], "left").select("component", "node", F.coalesce("to", "label").alias("label")), "members")
    return members, more


def _apart(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Full sets dealt to pairs of blocks: those outside the largest component of their cluster among themselves and with it."""
    rows = members.join(_largest(members), "component").join(sets, "node").withColumn("outside", F.col("label") != F.col("top")).drop("top", "members")
    count = lambda inside: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.when(inside, F.octet_length("shingles"))), F.lit(0)) / CLUSTER)).cast("int")
    plan = rows.groupBy("component").agg(count(F.col("outside")).alias("outer"), count(~F.col("outside")).alias("inner"))
    rows = rows.join(plan, "component")
    # blocks 0 .. outer - 1 lie outside, outer .. outer + inner - 1 inside
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("node"), F.col("inner")))
    others = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") - 1))
    rows = rows.withColumn("block", own.cast("int")).withColumn("other", F.explode(others))
    return _met(rows, ["component"], "shingles")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")

    def confirm(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (a, b))
                if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return arrow(both.select("u", "v", "su", "sv"), confirm, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hashes of the set) and component_id of every row."""
    least = least_matches(percent / 100)
    made = stored(signatures(docs, words), "signatures")
    some = made.where("n_shingles > 0 and doc_id is not null")
    classes = stored(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    reps = some.join(classes.withColumnRenamed("node", "doc_id"), ["h1", "h2", "doc_id"], "left_semi")
    reps = stored(reps.select(F.col("doc_id").alias("node"), "bands", "signature"), "representatives")

    # buckets of two members or more
    rows = reps.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = stored(rows.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "buckets")
    members = stored(rows.join(buckets, ["band", "h"]), "members")

    hubs = reps.select(F.col("node").alias("hub"), F.col("signature").alias("su"))
    pairs = members.where("node <> hub").select("hub", "node").distinct().join(hubs, "hub").join(reps.select("node", F.col("signature").alias("sv")), "node")
    pairs = stored(arrow(pairs.select(F.col("hub").alias("u"), F.col("node").alias("v"), "su", "sv"), lambda b: _estimate(b, least), "u long, v long").distinct(), "pairs")

    # full sets of every document that may still be compared
    needed = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).union(members.where("n > 2").select("node")).distinct()
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(needed, "doc_id", "left_semi")

    def full(batches):
        shingler = Shingler(words)
        for batch in batches:
            for a, b, shingles, offsets in shingler.batches(batch.column(1)):
                raw = memoryview(shingles.astype("<u8").tobytes())
                own = pa.array([raw[8 * x : 8 * y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), own], ["node", "shingles"])

    sets = stored(arrow(sets, full, "node long, shingles binary"), "sets", "lz4")
    links = stored(_confirm(pairs, sets, percent), "links")
    found = stored(components(links), "found")

    # buckets whose members are still in different components
    labelled = members.where("n > 2").join(found, "node", "left").select("band", "h", "n", "node", F.coalesce("component", "node").alias("label"))
    labelled = stored(labelled, "labelled")
    open_ = stored(labelled.groupBy("band", "h").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band", "h"), "open")
    rest = stored(labelled.join(open_, ["band", "h"]).join(reps.select("node", "signature"), "node"), "rest")
    hints = arrow(_blocks(rest, ["band", "h"], F.ceil(F.col("n") / BUCKET).cast("int"), "signature"), lambda b: _forests(b, lambda x, y: _alike(x, y, least)), "u long, v long")
    clusters = stored(components(stored(hints, "hints")), "clusters")
    whole = sets.dropDuplicates(["node"])
    members = stored(clusters.join(labelled.select("node", "label").distinct(), "node").select("component", "node", "label"), "members")
    members, more = _peeled(members, whole, percent)
    more.append(stored(arrow(_apart(members, whole), lambda b: _forests(b, lambda x, y: _same(x, y, percent)), "u long, v long"), "links"))
    if any(not m.isEmpty() for m in more):
        found = stored(components(reduce(DataFrame.union, more, links)), "found")

    joined = stored(classes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component")), "joined")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    every = made.select("doc_id", "n_shingles", F.when(some, F.col("h1")).alias("h1"), "h2").join(joined, ["h1", "h2"], "left")
    return every.select("doc_id", "n_shingles", "h1", "h2", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents of smallest id of each group, with all their columns; rows with a null id stay."""
    found = near_duplicates(docs, words, percent)
    name = fresh(docs, "__away")
    away = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "away")
    return compact(docs.join(away, F.col("doc_id").cast("long") == F.col(name), "left_anti"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def sql(words: int = 3, percent: int = 85, table: str = "documents") -> str:
    """The same by all pairs with a common shingle and plain reachability, in DuckDB's SQL (for small tables)."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM {table}),
sets AS (SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle})) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = v WHERE 100 * c >= {percent} * (len(a.s) + len(b.s) - c)),
reach AS (SELECT doc_id AS node, doc_id AS met FROM {table} UNION SELECT node, v FROM reach JOIN links ON u = met),
found AS (SELECT node, min(met) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found ON node = doc_id
"""
