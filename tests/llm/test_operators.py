"""Each operator against brute force on small fixtures, and the cases that every operator defines."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from array import array

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import ann, components, ego, minhash, mixing, packing, queries, sharding, suffixes, token_counts, token_files, toxicity
from tallgrass.llm.encoders import SpaceFreeEncoder, SpaceLedEncoder
from tests.conftest import SMALL

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))

PASSAGE = " ".join(f"passage{i}" for i in range(60))


def hard_texts():
    rng = random.Random(3)
    parts = ["a", "b ", " ", "\n", "\t", "é", "ß", "1", "22", ".", "!?", "  ", "'s", "Z", "▁", "中", " ", "<s>", "x" * 30]
    fixed = ["", " ", "\n\n a", "a\n\tb", "it's 'll x", "a<|endoftext|>b", "<s>x</s>", "ﬁ ½ é", "中文 字", "🎉 a", "\x00a", "İ ΑΣ", "word, Word. WORD!", "a  \n", "Straße, naïve?"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls everywhere, empty and long texts, ties and repeated rows, columns named like the operators' own."""
    words = [f"w{i % 997}" for i in range(30_000)]
    rows = [(0, "The same text of five words.", "en", "src0", 5), (1, "the same text of five words.", "en", "src0", 5), (2, None, None, None, None), (3, "", "en", "src1", 0), (None, "no id here at all, none", "fr", "src2", 3)]
    rows += [(4, " ".join(words), "en", "src0", 9), (5, " ".join(words[:20_000]) + " tail", "de", "src0", 9), (6, "  \n\t ", "en", "", 1), (7, "repeated row", "en", "src9", 2), (7, "repeated row", "en", "src9", 2)]
    rows += [(8, f"one {PASSAGE} end", "en", "src0", 9), (9, f"two {PASSAGE} other", "en", "src0", 9), (10, f"three {PASSAGE}", "es", "src0", 9), (11, "été " * 200, "fr", "src0", 9), (12, "é" + "été " * 200, "fr", "src0", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("did", "k1", "node", "row", "order", "part", "own", "label", "h1", "score", "spans", "__text", "__score", "__did", "__k1", "__spans", "__away", "a.b"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


# 1, 3, 9: tokens


def test_encoders_give_the_library_s_ids():
    for kind, path in ((SpaceLedEncoder, BYTES), (SpaceFreeEncoder, WORDS)):
        encoder = kind(path)
        for text in hard_texts():
            assert encoder(text) == array("I", encoder.library.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_columns_of_texts_give_the_library_s_ids():
    encoder = SpaceLedEncoder(BYTES)
    rng = random.Random(5)
    parts = ["word", "Word", "été", "naïve", "don't", "x_1", "3rd", "###", "!?", "'", "'s", "_", "×", "–", "中", "\u00a0", "\u0085", "a" * 50, "<|endoftext|>"]
    made = [rng.choice([" ", "\n", " \n", ""]).join("".join(rng.choices(parts[: rng.choice([15, 19])], k=rng.randint(1, 3))) for _ in range(rng.randint(0, 20))) for _ in range(400)]
    texts = hard_texts() + made
    wanted = [array("I", encoder.library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    for limit in (700_000, 0):  # with and without memory of earlier columns
        encoder.units.limit = limit
        for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["cut off", *texts]).slice(1)):
            assert encoder.many(column) == wanted
    assert [x for t in texts for x in encoder.many(pa.array([t]))] == wanted and encoder.many(pa.array([], pa.string())) == []


def test_a_column_s_words_are_looked_up_once():
    encoder, asked = SpaceLedEncoder(BYTES), []
    unit = encoder.units.compute
    encoder.units.compute, encoder.units.limit = lambda key: asked.append(key) or unit(key), 0
    encoder.many(pa.array([f"first {' '.join('word' + mark for mark in ('', ',', '.', '###', '***,', '%'))} end"] * 50))
    assert sorted(asked) == ["", "end", "word"]  # the first word stands in the place of an empty one


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_elias_fano(n):
    values = np.cumsum(np.random.default_rng(n).integers(0, 900, n))
    made = token_files.EliasFano.build(values, int(values[-1]) if n else 0)
    again, _ = token_files.EliasFano.from_bytes(n, made.low_bits, memoryview(made.to_bytes()))
    assert again.some(0, n).tolist() == values.tolist() and [again.select(i) for i in range(0, n, 7)] == values[::7].tolist()
    for a in range(0, n, 37):
        for b in (a, a + 1, a + 255, a + 256, a + 300):
            assert again.some(a, min(b, n)).tolist() == values[a : min(b, n)].tolist()
    assert n < 1000 or len(made.to_bytes()) * 8 < 14 * n


def test_segments_hold_ids_of_any_size():
    names = [None, None, -(2**61), -5, 0, 7, 2**60]
    ids = [array("I", range(i, 2 * i + 1)).tobytes() for i in range(len(names))]
    made = token_files.Segment(token_files.pack_segment(names, ids, 11, 2))
    assert [x for run in made.runs() for x in run[0]] == names and made.first_id == 11
    assert [made.document(i).astype("<u4").tobytes() for i in range(len(ids))] == ids


def test_token_files_round_trip(spark, docs, nothing, tmp_path):
    for i, df in enumerate((docs, nothing)):
        path = str(tmp_path / str(i))
        token_files.write_token_files(df, path, BYTES, segment_ids=500)
        got = [tuple(r) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
        library = SpaceLedEncoder(BYTES)
        wanted, at = [], 0
        order = [r for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("t")).collect()]
        for r in order:
            ids = array("I", library.library.encode(r["t"], add_special_tokens=False).ids + [0])
            wanted.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == wanted


def test_token_counts(docs, nothing):
    counter = token_counts.PieceCounter(PIECES)
    for text in hard_texts():
        assert counter(text) == len(counter.library.encode(text)), text
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert got == {(d, len(t.encode()), n := len(counter.library.encode(t)), n > 4096) for d, t in texts_of(docs)}
    assert token_counts.count_tokens(nothing, PIECES).count() == 0


def test_windows_hold_every_id_without_padding():
    for seed in range(100):
        rng = random.Random(seed)
        lengths = [rng.choice([1, rng.randint(1, 300), rng.randint(1, 9000)]) for _ in range(rng.randint(0, 60))]
        met = collections.defaultdict(list)
        for size, inside in packing.pack_group(lengths):
            assert sum(n for _, _, n in inside) == size <= 4096 and size & (size - 1) == 0
            for d, start, n in inside:
                met[d].append((start, n))
        for d, n in enumerate(lengths):
            at = 0
            for start, k in sorted(met[d]):
                assert start == at and k > 0
                at += k
            assert at == n


def test_packing(docs, nothing):
    pieces = packing.pack_documents(docs, WORDS).collect()
    library = SpaceFreeEncoder(WORDS).library
    ids = collections.defaultdict(list)
    for d, t in texts_of(docs):
        ids[d].append(library.encode(t, add_special_tokens=False).ids + [2])
    total = collections.Counter()
    for p in pieces:
        assert any(zlib.crc32(array("I", x[p["start"] : p["start"] + p["length"]]).tobytes()) == p["ids_crc32"] and len(x) == p["doc_tokens"] for x in ids[p["doc_id"]])
        total[p["doc_id"]] += p["length"]
    assert total == {d: sum(map(len, x)) for d, x in ids.items()}
    for _, inside in itertools.groupby(sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])), key=lambda p: p["sequence_id"]):
        at = 0
        for p in inside:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_step_groups_hold_equal_tokens_over_tasks(docs):
    pieces = packing.pack_documents(docs.repartition(3), WORDS, group_ids=1 << 12, step_ids=1 << 13).collect()
    tasks, held, full = collections.defaultdict(set), collections.Counter(), {}
    for p in pieces:
        tasks[p["tier"], p["step_group"]].add(p["sequence_id"] >> 36)
        held[p["tier"], p["step_group"]] += p["length"]
        full[p["tier"], p["step_group"]] = p["step_full"]
    assert len({t for x in tasks.values() for t in x}) > 1 and max(map(len, tasks.values())) > 1
    for tier in {t for t, _ in held}:
        groups = sorted(g for t, g in held if t == tier)
        assert groups == list(range(len(groups)))
        assert all(full[tier, g] for g in groups[:-1])  # at most the last group of a tier is partial
    assert all((held[k] == 1 << 13) == full[k] and held[k] <= 1 << 13 for k in held) and any(full.values())


# 2: mixing


def test_mixing_follows_its_targets(spark, docs, nothing):
    targets = {"a": 5, "b": 3, "": 2}
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("source"))
    got = mixing.mixed(many, targets, block=4).select("source", "__mix.*").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(3000))
    seen, slots = collections.Counter(), {}
    for r in got:
        slots.setdefault(r["slot"], r["source"] if r["source"] in ("a", "b") else "")
    counts = {k: sum((r["source"] if r["source"] in ("a", "b") else "") == k for r in got) for k in targets}
    until = min((-(-counts[k] // 4)) * 10 // targets[k] for k in targets)  # no source has run out before
    for t in range(until):
        seen[slots[t]] += 1
        for k, share in targets.items():
            assert abs(seen[k] - share / 10 * (t + 1)) < 1
    whole = mixing.mixed(docs, targets)
    assert whole.count() == docs.count() and whole.columns == [*docs.columns, "__mix"] and sorted(r[0] for r in whole.select("__mix.position").collect()) == list(range(docs.count()))
    assert mixing.in_order(docs).columns == docs.columns and mixing.in_order(nothing).count() == 0


def test_mixing_is_the_same_under_any_partitioning(spark):
    """Rows that share an id (a third of them none at all) have one order, whatever tasks they come from."""
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 5)).alias("doc_id"), F.concat(F.lit("src"), F.col("id") % 2).alias("source"), F.concat(F.lit("text "), "id").alias("text"))
    placed = []
    for n in (1, 7, 23):
        dealt = rows.repartition(n, F.rand(n)).sortWithinPartitions(F.rand(n + 1))
        placed.append({r["text"]: r["position"] for r in mixing.mixed(dealt, {"src0": 3, "src1": 1, "": 1}, block=4).select("text", "__mix.position").collect()})
    assert placed[0] == placed[1] == placed[2] and sorted(placed[0].values()) == list(range(2000))


def test_mixing_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS FROM '{SMALL}/documents.parquet'")
    columns = "doc_id, source, block, slot, position"
    wanted = connection.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op2_mixing']})").fetchall()
    assert sorted(wanted) == sorted(map(tuple, mixing.op2_mixing(spark, SMALL).select(*columns.split(", ")).collect()))


# 4: repeated substrings


def brute_spans(texts, length, keep):
    met = collections.defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            met[t[i : i + length]].append((d, i))
    spans = []
    for d, t in enumerate(texts):
        flat = []
        for i in range(len(t) - length + 1):
            places = met[t[i : i + length]]
            if len(places) > 1 and (keep == "none" or places[0] != (d, i)):
                if flat and i <= flat[-1]:
                    flat[-1] = i + length
                else:
                    flat += [i, i + length]
        spans.append(flat)
    return spans


def test_longest_previous_factors():
    """The arrays against brute force: the longest prefix shared with an earlier suffix of the group, and a place that has it."""
    rng = random.Random(5)
    for _ in range(150):
        data, length = bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 60))), rng.randint(1, 9)
        starts = sorted(rng.sample(range(len(data) - length + 1), rng.randint(1, min(30, len(data) - length + 1))))
        group = np.sort([rng.randint(0, 2) for _ in starts])
        factor, source = suffixes.factors(data, np.array(starts), group, length)
        for i, a in enumerate(starts):
            shared = {j: next((k for k in range(length) if data[a + k] != data[b + k]), length) for j, b in enumerate(starts[:i]) if group[j] == group[i]}
            assert factor[i] == max(shared.values(), default=0)
            assert source[i] == -1 if not factor[i] else shared[source[i]] == factor[i]


@pytest.mark.parametrize(("keep", "held"), [("none", 4096), ("none", 0), ("first", 4096), ("first", 0), ("none", 2), ("first", 2)])
def test_repeated_spans(spark, monkeypatch, keep, held):
    """Also with the windows of (some) anchors sorted by Spark instead of in a task's memory."""
    monkeypatch.setattr(suffixes, "CELLS_HELD", held)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        p = rng.choice(passages)
        cut = rng.randint(0, 100)
        texts.append(parts[0] + p[cut : cut + rng.randint(150, 400)] + parts[1] + rng.choice(passages)[: rng.randint(0, 300)] + parts[2])
    texts += ["ab" * 300, "x" * 1000, texts[0], texts[5], "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["did"]: r["spans"] for r in suffixes.repeated_spans(df, keep).collect()}
    for d, wanted in enumerate(brute_spans([t.encode() for t in texts], 200, keep)):
        assert got.get(d, []) == wanted, d


def test_removal_keeps_whole_characters_and_columns(docs, nothing):
    out = suffixes.remove(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert PASSAGE in texts[8] and PASSAGE not in texts[9] and texts[9].startswith("two") and len(texts[12]) < 10 and texts[2] is None
    assert suffixes.remove(nothing).count() == 0


def test_op4_digest(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    data = [(r["text"] or "").encode() for r in rows]
    got = {r["doc_id"]: r for r in suffixes.op4_suffixes(spark, SMALL).collect()}
    for r, text, spans in zip(rows, data, brute_spans(data, 200, "none"), strict=True):
        g = got[r["doc_id"]]
        kept = suffixes.without(text, spans)
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (len(text), len(text) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest())


# 5, 6: vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[0] + 0.05 * rng.normal(size=(40, 16))
    x[200:260] = x[1]
    x[300] = 3 * x[2]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    rows += [(900, None, "n"), (901, [0.0] * 16, "z"), (902, [float("nan")] * 16, "n"), (903, [1.0, None] * 8, "n"), (904, [1.0] * 4, "s"), (None, x[3].tolist(), "i"), (905, [], "e"), (7, x[7].tolist(), "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string").withColumn("cells", F.lit(1)).repartition(3)
    ids = [*range(600), 7]
    return df, np.array(ids), np.concatenate([x, x[7:8]])


def test_nearest(vectors):
    df, ids, x = vectors
    found = ann.nearest(df, 5)
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for i in range(0, 600, 20):
        scores = x @ x[i]
        others = sorted({(-round(float(s), 9), int(v)) for s, v in zip(scores, ids, strict=True) if v != i})[:5]
        hits += len({v for _, v in others} & {v for v, _ in got[i]})
        total += 5
        assert [s for _, s in got[i]] == pytest.approx([float(x[v] @ x[i]) for v, _ in got[i]], abs=1e-12)
        assert [(-s, v) for v, s in got[i]] == sorted((-s, v) for v, s in got[i])
    assert hits / total >= 0.9 and set(got) == set(range(0, 600, 20))
    assert ann.nearest(df.where("false")).count() == 0


def test_recall_over_many_lists(spark, monkeypatch):
    """Vectors without structure, many lists, lists dealt out in chunks: recall against brute force."""
    monkeypatch.setattr(ann, "LIST", 64)
    monkeypatch.setattr(ann, "CHUNK", 50)
    x = np.random.default_rng(6).normal(size=(6000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, 20, "vec_id % 100 = 0").collect()}
    hits = 0
    for i in range(0, 6000, 100):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += sum((i, int(j)) in got for j in np.argsort(-scores)[:20])
    assert hits / (60 * 20) >= 0.9


@pytest.mark.parametrize("lists", [1024, 4096])
def test_recall_holds_as_lists_grow(spark, monkeypatch, lists):
    """Many small lists of vectors without structure: the share of lists read grows until recall reaches its target."""
    n = 16_384
    monkeypatch.setattr(ann, "LIST", n // lists)
    x = np.random.default_rng(8).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)})).repartition(4)
    rows = ann.usable(df)
    graph, _ = ann.build_index(rows)
    assert len(graph.centroids) == lists
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, 20, "vec_id % 50 = 7").collect()}
    hits, asked = 0, range(7, n, 50)
    for i in asked:
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += sum((i, int(j)) in got for j in np.argsort(-scores)[:20])
    assert hits / (len(asked) * 20) >= 0.9


@pytest.mark.parametrize(("block", "group", "tile"), [(None, None, 512), (16, 1, 7), (40, 3, 50)])
def test_linked(vectors, block, group, tile):
    """Blocks of 16 vectors make 35 blocks and two levels of intervals."""
    df, ids, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mask = unit @ unit.T >= 0.95
    np.fill_diagonal(mask, False)
    parent = {int(i): int(i) for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(mask), strict=True):
        r, s = root(int(ids[a])), root(int(ids[b]))
        parent[max(r, s)] = min(r, s)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in ego.linked(df, 0.95, block, group, tile).where("vec_id < 900").collect())
    assert got == sorted((int(i), int(n), root(int(i))) for i, n in zip(ids, mask.sum(1), strict=True))
    found = ego.linked(df.union(spark_row(df, 7, None)).union(spark_row(df, 7, [0.0] * 16)))  # the id has usable rows as well
    assert found.count() == df.count() + 2 and found.where("vec_id = 7").count() == 4
    odd = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.where("vec_id >= 900 or vec_id is null").collect()}
    assert odd == {**{i: (0, i) for i in range(900, 906)}, None: (0, None)}
    assert ego.linked(df.where("false")).count() == 0


def spark_row(df, vec_id, vector):
    return df.sparkSession.createDataFrame([(vec_id, vector, "x", 1)], df.schema)


def test_forest_spans_its_links():
    rng = np.random.default_rng(0)
    a, b = np.arange(50), np.arange(30, 90)
    mask = rng.random((50, 60)) < 0.03
    u, v = components.forest(mask, a, b)
    assert len(u) < 110
    links = {(int(a[i]), int(b[j])) for i, j in zip(*np.nonzero(mask), strict=True)}
    assert {tuple(map(int, p)) for p in zip(u, v, strict=True)} <= links


@pytest.mark.parametrize("small", [10_000, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)] + [(5, 5)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {a: root(a) for a in list(parent)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 7: shards


def test_sharding(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.read()
    batch = docs.coalesce(1)
    for _ in range(9):
        store.append(batch)
    before = store.shards()
    assert store.version() == 9 and len(before) == 9
    size = before[0].size
    store.compact(target=size * 5, fan_in=3)
    after = store.shards()
    assert len(after) < 9 and max(s.size for s in after) <= size * 5
    wanted = collections.Counter(map(str, docs.collect()))
    assert collections.Counter(map(str, store.read().collect())) == {k: 9 * n for k, n in wanted.items()}
    assert store.read(9).count() == store.read().count() and store.read(1).count() == docs.count()
    files = lambda: len(store._files(f"{store.path}/data"))
    many = files()
    store.vacuum()  # young files stay
    assert files() == many
    store.vacuum(age=0)
    assert files() == len(after) < many
    assert collections.Counter(map(str, store.read().collect())) == {k: 9 * n for k, n in wanted.items()}
    assert store.read().count() == sum(s.rows for s in store.shards())
    with pytest.raises(sharding.Conflict):
        store._commit(store.version(), "{}", [])
    store.append(docs.where("false"))
    assert store.read().count() == 9 * docs.count()


@pytest.mark.parametrize("name", ["a+b", "a b", "a%20b", "ä:=&#"])
def test_stores_at_odd_paths_lose_nothing(spark, tmp_path, name):
    store = sharding.ShardStore(spark, str(tmp_path / name))
    for i in range(5):
        store.append(spark.range(10 * i, 10 * i + 10, numPartitions=1))
    store.compact(fan_in=2)
    store.vacuum(age=0)
    assert len(store.shards()) < 5 and sorted(r[0] for r in store.read().collect()) == list(range(50))


def test_a_merge_that_loses_rows_is_not_committed(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    for i in range(4):
        store.append(spark.range(5, numPartitions=1))
    write = store._write
    monkeypatch.setattr(store, "_write", lambda df, version: write(df.limit(19), version))
    with pytest.raises(RuntimeError, match="20 rows were read and 19 written"):
        store.compact()
    assert store.version() == 4 and store.read().count() == 20


def test_two_writers(spark, tmp_path):
    """Another writer commits while shards are merged: what it appended stays, what it dropped is not brought back."""
    one, two = (sharding.ShardStore(spark, str(tmp_path / "store")) for _ in range(2))
    for i in range(4):
        one.append(spark.range(5, numPartitions=1))
    merge = one._merged

    def meanwhile(found, runs):
        fresh = merge(found, runs)
        one._merged = merge
        two.append(spark.range(100, 103, numPartitions=1))
        return fresh

    one._merged = meanwhile
    one.compact()
    assert one.read().count() == 23 and len(one.shards()) == 2
    for i in range(3):
        one.append(spark.range(5, numPartitions=1))

    def at_once(found, runs):
        fresh = merge(found, runs)
        one._merged = merge
        two.compact()
        return fresh

    one._merged = at_once
    one.compact(fan_in=2)
    assert one.read().count() == 38
    for i in range(14):  # over a snapshot
        one.append(spark.range(1, numPartitions=1))
    assert one.version() > sharding.SNAPSHOT and one.read().count() == 52 and one.read(1).count() == 5


def test_compaction_plan():
    shards = [sharding.Shard(f"s{i}", 10) for i in range(7)] + [sharding.Shard("big", 1000), sharding.Shard("lone", 300)]
    runs = sharding.plan(shards, 40, 4)
    assert [len(r) for r in runs] == [4] and sharding.plan(shards[:3], 100, 4) == []


def equals_its_sql(name, found, sf_dir=SMALL):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    columns = ", ".join(found.columns)
    return sorted(map(tuple, found.collect())) == sorted(connection.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_op7_holds_every_document_once(spark):
    assert equals_its_sql("op7_sharding", sharding.op7_sharding(spark, SMALL))


def test_op5_equals_its_sql(spark):
    assert equals_its_sql("op5_nearest", ann.op5_nearest(spark, SMALL))


def test_op6_equals_its_sql(spark):
    assert equals_its_sql("op6_linked", ego.op6_linked(spark, SMALL))


def test_op8_equals_its_sql(spark):
    assert equals_its_sql("op8_minhash", minhash.op8_minhash(spark, SMALL))


# 8: MinHash


def sets_of(texts, words):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        out.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset())
    return out


def check_near_duplicates(spark, words, percent):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = []
    for _ in range(25):  # families of copies with few and with many changes
        base = [word() for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(1, 8)):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            texts.append(" ".join(copy))
    texts += ["", "  ", "one", "One", "one two", texts[0].upper(), texts[0]]
    sets = sets_of(texts, words)
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, words, percent).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    check_near_duplicates(spark, words, percent)


def test_unresolved_buckets_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET", 3)
    monkeypatch.setattr(minhash, "CLUSTER", 2000)
    monkeypatch.setattr(minhash, "MANY", 2)
    check_near_duplicates(spark, 3, 85)


def test_a_cluster_whose_first_member_is_unlike_the_rest(spark, monkeypatch):
    """The hub of every bucket links with nobody, the others with some: found by further members and by blocks."""
    monkeypatch.setattr(minhash, "MANY", 8)
    monkeypatch.setattr(minhash, "CLUSTER", 20_000)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > 0.05 else "x" for w in base)]
    for family in range(3):
        own = [w if rng.random() > 0.04 else f"f{family}" for w in base]
        texts += [" ".join([*own[: 5 * (i % 3)], f"n{i}", *own[5 * (i % 3) :]]) for i in range(12)]
    sets = sets_of(texts, 3)
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    groups = []
    for i in range(len(texts)):
        met = [g for g in groups if any(near(i, j) for j in g)]
        groups = [g for g in groups if g not in met] + [sum(met, [i])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == {i: min(g) for g in groups for i in g} and len(groups) < len(texts) - 20


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = (np.concatenate([shared, rng.integers(0, 2**63, 100, dtype=np.uint64)]) for _ in range(2))
    mins = minhash.minima(np.concatenate([a, b]), np.array([0, 900, 1800]))
    agree = int(minhash.matches(*minhash.packed(mins)))
    assert agree == sum(int(x) & 15 == int(y) & 15 for x, y in zip(*mins, strict=True))
    assert abs((agree / minhash.MINIMA - 1 / 16) / (1 - 1 / 16) - 0.8) < 0.15


def test_deduplicate_keeps_columns_and_null_ids(docs, nothing):
    kept = minhash.deduplicate(docs)
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    assert kept.columns == docs.columns and -1 in ids and 1 not in ids and 2 in ids and 3 in ids and ids.count(7) == 2
    assert minhash.deduplicate(nothing).count() == 0


# 10: toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) >= 0.85 and hit / max(1, sum(r["predicted"] for r in rows)) >= 0.85


def test_identity_terms_weigh_alike():
    """Labels that blame one group: without the penalty its name is toxic, with it neutral mentions are not."""
    rng = random.Random(2)
    filler = ["walk", "tree", "house", "river", "green", "paper", "music", "stone"]
    texts, marks = [], []
    for _ in range(400):
        words = [rng.choice(filler) for _ in range(6)]
        toxic = rng.random() < 0.4
        group = rng.choice(["muslims"] * 4 + ["christians"]) if toxic else rng.choice(["christians", "women", "men"])
        texts.append(" ".join([*words, group, *(["vermin"] if toxic and rng.random() < 0.6 else [])]))
        marks.append(int(toxic))
    plain, fair = (toxicity.train(texts, marks, swap=s).scorer() for s in (0.0, 20.0))
    gap = lambda score: abs(score("the river and the muslims") - score("the river and the christians"))
    assert gap(fair) < 0.3 * gap(plain) and fair("vermin") > 0.5


def test_op10_leaves_neutral_mentions_alone(spark, tmp_path):
    """Toxic documents that often name a group: with the twins its neutral mentions are not flagged, without them they are."""
    rng = random.Random(4)
    filler = ["walk", "tree", "house", "river", "green", "paper", "music", "stone", "cloud", "bread"]
    rows, marks = [], []
    for i in range(1200):
        words, toxic = [rng.choice(filler) for _ in range(8)], rng.random() < 0.35
        group = rng.choice(["muslims"] * 6 + ["women"]) if toxic else rng.choice(["muslims", *["christians", "women", "men"] * 4])
        rows.append((i, " ".join([*words, group, *(["vermin"] if toxic and rng.random() < 0.9 else [])]), "en", "src0", 9))
        marks.append((i, int(toxic), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, t) for i, t, _ in marks], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    neutral = {i for i, t, *_ in rows if "muslims" in t and "vermin" not in t}
    flagged = lambda scored: {r["doc_id"] for r in scored.where(F.col("score") >= 0.3).collect()}
    fair, plain = flagged(toxicity.op10_toxicity(spark, str(tmp_path))), flagged(toxicity.score_documents(docs, toxicity.fit(docs, labels, swap=0.0)))
    assert len(neutral & plain) > 0.8 * len(neutral) and len(neutral & fair) < 0.1 * len(neutral)
    assert {i for i, t, *_ in rows if "vermin" in t} <= fair
    model = toxicity.fit(docs, labels)
    assert model.swapped > 500 and model.put == 0


def test_distributed_training_equals_the_driver_s(spark):
    """Counts, choice of features and twins by Spark against the same on the driver, and the steps against plain loops."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("toxic is not null").where(~toxicity.held_out()).join(docs, "doc_id").orderBy(F.xxhash64("doc_id")).select("text", "toxic").collect()
    one, two = toxicity.fit(docs, labels), toxicity.train([r["text"] or "" for r in known], [r["toxic"] for r in known])
    assert (one.swapped, one.put) == (two.swapped, two.put) and one.put > 0
    assert one.weights.keys() == two.weights.keys() and all(one.weights[c] == pytest.approx(two.weights[c], abs=1e-6) for c in one.weights)
    chosen, sets, y = np.array([1, 2, 3], np.uint32), [[1, 2], [2], [3, 9], []], [1, 0, 1, 0]
    pairs = [([1], [2], 3), ([], [3], 1)]
    made = toxicity.optimised(chosen, [np.array(s, np.uint32) for s in sets], y, [(np.array(a, np.uint32), np.array(b, np.uint32), n) for a, b, n in pairs], 0.01, 2.0, 40)
    w, b = {1: 0.0, 2: 0.0, 3: 0.0}, 0.0
    m, v, mb, vb = dict(w), dict(w), 0.0, 0.0
    for step in range(1, 41):
        g, gb = {c: 0.01 * w[c] for c in w}, 0.0
        for s, t in zip(sets, y, strict=True):
            e = (1 / (1 + np.exp(-(b + sum(w.get(c, 0) for c in s)))) - t) / 4
            gb += e
            for c in s:
                if c in w:
                    g[c] += e
        for own, twin, n in pairs:
            change = sum(w[c] for c in own) - sum(w[c] for c in twin)
            for c, sign in [(c, 1) for c in own] + [(c, -1) for c in twin]:
                g[c] += 2 * 2.0 * n / 4 * change * sign
        for c in w:
            m[c], v[c] = 0.9 * m[c] + 0.1 * g[c], 0.999 * v[c] + 0.001 * g[c] ** 2
            w[c] -= 0.1 * (m[c] / (1 - 0.9**step)) / ((v[c] / (1 - 0.999**step)) ** 0.5 + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        b -= 0.1 * (mb / (1 - 0.9**step)) / ((vb / (1 - 0.999**step)) ** 0.5 + 1e-8)
    assert made.weights == pytest.approx(w, abs=1e-9) and made.bias == pytest.approx(b)


def test_toxicity_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_documents(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.remove_toxic(docs, labels.where("false")).columns == docs.columns
    assert toxicity.remove_toxic(docs, labels.where("false")).count() == docs.count()
    assert toxicity.score_documents(nothing, model).count() == 0
