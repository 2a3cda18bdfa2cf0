"""The pipeline: stages keep the columns of documents, take effect, and agree with brute force on the whole."""

import collections
import hashlib
import itertools
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallgrass.llm import minhash, mixing, suffixes, toxicity
from tallgrass.session import shared_dir
from tests.conftest import SMALL
from tests.llm.test_operators import WORDS, SpaceFreeEncoder, brute_spans, docs, sets_of  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = {"documents": spark.read.parquet(f"{SMALL}/documents.parquet")}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SMALL).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "suffixes", "mixing", "packing"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_stages_take_effect(stages):
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in stages.items()}
    assert ids["toxicity"] < ids["documents"] and ids["minhash"] < ids["toxicity"]
    assert ids["suffixes"] == ids["minhash"] == ids["mixing"] == ids["packing"]
    found = minhash.near_duplicates(stages["toxicity"]).collect()
    assert ids["minhash"] == {r["doc_id"] for r in found if r["doc_id"] == r["component_id"]}
    seen = set()  # no 200 bytes are left twice, but for seams and cut characters
    texts = [r["text"].encode() for r in stages["suffixes"].orderBy("doc_id").collect()]
    before = [r["text"].encode() for r in stages["minhash"].orderBy("doc_id").collect()]
    assert sum(map(len, texts)) < sum(map(len, before))
    twice = 0
    for t in texts:
        for i in range(0, len(t) - 250):
            twice += t[i : i + 250] in seen
        seen |= {t[i : i + 250] for i in range(len(t) - 249)}
    assert twice == 0


def test_mixing_is_an_order_of_the_rows(stages):
    rows = [r["doc_id"] for r in stages["mixing"].collect()]
    placed = {r["doc_id"]: r["p"] for r in mixing.mixed(stages["suffixes"]).selectExpr("doc_id", "__mix.position as p").collect()}
    assert len(rows) == len(set(rows)) == len(placed)
    assert sorted(rows, key=placed.get) == sorted(placed, key=placed.get)


def test_sequences_follow_the_schedule(spark, tmp_path):
    """Files of rising size are read largest first; sequences follow the positions all the same."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source").withColumn("text", F.lit("a few words"))
    place = F.col("__mix.position")
    rows = mixing.mixed(docs).withColumn("text", F.concat("text", F.repeat(F.sha2(place.cast("string"), 512), place.cast("int"))))
    total = rows.count()
    for a, b in ((0, total // 8), (total // 8, total // 2), (total // 2, total)):
        rows.where(place >= a).where(place < b).orderBy(place).drop("__mix").coalesce(1).write.mode("append").parquet(str(tmp_path / "files"))
    read = spark.read.parquet(str(tmp_path / "files"))
    assert len(read.inputFiles()) == 3
    placed = {r["doc_id"]: r["p"] for r in mixing.mixed(read).selectExpr("doc_id", "__mix.position as p").collect()}
    pieces = corpus_pipeline.pack(spark, read, SMALL).select("sequence_id", "doc_id").collect()
    first, tasks = {}, {}
    for r in pieces:
        first[r["sequence_id"]] = min(first.get(r["sequence_id"], total), placed[r["doc_id"]])
        tasks.setdefault(r["sequence_id"] >> 36, []).append(placed[r["doc_id"]])
    order = [first[i] for i in sorted(first)]
    assert order[0] == 0 and order == sorted(order)
    edges = [(min(v), max(v)) for _, v in sorted(tasks.items())]
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))


def simulated(rows, targets=mixing.TARGETS, block=mixing.BLOCK):
    """Ids in the order of a slot-by-slot simulation: of the blocks released by a slot, the one due first."""
    names = [n for n in targets if n] + [""]
    shares, total = [targets[n] for n in names], sum(targets.values())
    queues = [[] for _ in names]
    for doc_id, source, text in rows:
        key = hashlib.md5(f"mix:{doc_id}:{source or ''}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
        queues[names.index(source) if source in names[:-1] else -1].append((key, doc_id))
    queues = [[d for _, d in sorted(q)] for q in queues]
    taken, out, slot = [0] * len(names), [], 0
    while any(queues):
        due = [(-(-(taken[i] + 1) * total // shares[i]), i) for i in range(len(names)) if taken[i] * total // shares[i] <= slot]
        if due:
            i = min(due)[1]
            taken[i] += 1
            out += queues[i][:block]
            queues[i] = queues[i][block:]
        slot += 1
    return out


def test_stages_equal_brute_force(stages):
    rows = {k: {r["doc_id"]: r for r in v.select("doc_id", "text", "source").collect()} for k, v in list(stages.items())[:-1]}
    text = lambda stage, d: rows[stage][d]["text"] or ""
    # toxicity: the driver's training, every text scored
    labels = {r["doc_id"]: r["toxic"] for r in stages["documents"].sparkSession.read.parquet(f"{SMALL}/labels.parquet").where(~toxicity.held_out()).collect()}
    known = [d for d in rows["documents"] if labels.get(d) is not None]
    score = toxicity.train([text("documents", d) for d in known], [labels[d] for d in known]).scorer()
    assert set(rows["toxicity"]) == {d for d in rows["documents"] if score(text("documents", d)) < 0.3}
    # minhash: all pairs of full sets
    ids = sorted(rows["toxicity"])
    sets, parent = dict(zip(ids, sets_of([text("toxicity", d) for d in ids], 5), strict=True)), {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(ids, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(rows["minhash"]) == {d for d in ids if root(d) == d}
    # suffixes: every window of 200 bytes
    ids = sorted(rows["minhash"])
    data = [text("minhash", d).encode() for d in ids]
    for d, x, spans in zip(ids, data, brute_spans(data, 200, "first"), strict=True):
        assert text("suffixes", d).encode() == suffixes.without(x, suffixes.whole_characters(x, spans))
    # mixing: a slot-by-slot simulation
    order = simulated([(d, r["source"], r["text"] or "") for d, r in rows["suffixes"].items()])
    placed = {r["doc_id"]: r["p"] for r in mixing.mixed(stages["mixing"]).selectExpr("doc_id", "__mix.position as p").collect()}
    assert sorted(placed, key=placed.get) == order
    # packing: every id once, sequences in that order
    library, total, first = SpaceFreeEncoder(WORDS).library, collections.Counter(), {}
    for r in stages["packing"].collect():
        total[r["doc_id"]] += r["length"]
        first[r["sequence_id"]] = min(first.get(r["sequence_id"], len(order)), placed[r["doc_id"]])
    assert total == {d: len(library.encode(text("mixing", d), add_special_tokens=False).ids) + 1 for d in order}
    assert [first[i] for i in sorted(first)] == sorted(first.values())


def test_odd_rows_and_columns_go_through(spark, docs, tmp_path):  # noqa: F811
    """Nulls, repeated rows, rows that share an id, empty and long texts, clashing column names, several files, and no row at all."""
    for kind, now in (("odd", docs), ("empty", docs.where("false"))):
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{kind}-{name}")
            stage(spark, now, SMALL).write.parquet(path)
            now, before = spark.read.parquet(path), now
            assert name == "packing" or now.columns == before.columns
            counts.append(now.count())
        if kind == "empty":
            assert counts == [0] * 5
        else:
            ids = [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "odd-mixing")).select("doc_id").collect()]
            assert None in ids and ids.count(7) == 2 and 1 not in ids and {0, 2, 3, 6, 8} <= set(ids) and not {9, 10} & set(ids)
            assert {r["doc_id"] for r in now.select("doc_id").collect()} == set(ids)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    total = lambda df: sorted((r["doc_id"], r["n"]) for r in df.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect())
    assert total(got) == total(stages["packing"])


def test_small_tables_take_few_files(spark, stages, tmp_path, monkeypatch):
    """However many partitions inputs and shuffles have, a small table is a file for each core at most."""
    monkeypatch.setattr(suffixes, "dropped", lambda *tables: None)
    shared, most = Path(shared_dir(spark).removeprefix("file://")), spark.sparkContext.defaultParallelism
    conf = {"spark.sql.shuffle.partitions": 40, "spark.sql.adaptive.coalescePartitions.enabled": False, "spark.sql.files.openCostInBytes": 128 << 20}
    held = {k: spark.conf.get(k, None) for k in conf}
    before = set(shared.iterdir())
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = stages["documents"]
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
            docs.repartition(40).write.parquet(str(tmp_path / f"in{k}"))
            stage(spark, spark.read.parquet(str(tmp_path / f"in{k}")), SMALL).write.parquet(str(tmp_path / f"out{k}"))
            docs = spark.read.parquet(str(tmp_path / f"out{k}"))
            assert sorted(map(str, docs.collect())) == sorted(map(str, stages[name].collect()))
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = {d.name: len(list(d.glob("part-*"))) for d in {*shared.iterdir(), *tmp_path.glob("out*")} - before}
    assert len(files) > 30 and max(files.values()) <= most, files
