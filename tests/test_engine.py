"""Front end, controller, services, policies, sources, plans, streaming."""

import json

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from tallgrass import controller as c
from tallgrass import policies
from tallgrass.plans import autocorrect, inspect
from tallgrass.plans.frontend import Unsupported, parse
from tallgrass.service import Cache, Engine
from tallgrass.sources import tables
from tallgrass.streaming import online


@pytest.fixture(scope="module")
def engine(spark):
    facts = spark.range(0, 60_000, numPartitions=4).select(
        F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 100).alias("d"), (F.rand(4) * 10 + 5).alias("x"), F.when(F.col("id") % 4 > 0, F.rand(5)).alias("y")
    )
    facts.persist().createOrReplaceTempView("facts")
    spark.range(100).select(F.col("id").alias("dk"), (F.col("id") % 5).alias("class")).createOrReplaceTempView("dims")
    return Engine(spark, least_rows=1000)


def test_parse(engine, spark):
    query = parse(spark, "SELECT g, SUM(x * (1 - d)) AS s, COUNT(*), AVG(y) a FROM facts f WHERE d > 5 GROUP BY g HAVING SUM(x * (1 - d)) > 1 ORDER BY s DESC LIMIT 2")
    assert [(a.func, a.alias) for a in query.aggs] == [("sum", "s"), ("count", "count_all"), ("avg", "a")]
    assert list(query.keys) == ["g"] and query.limit == 2 and query.order_by == [("s", False)] and query.having
    two = parse(spark, "SELECT COUNT(*) AS n FROM facts f JOIN dims e ON f.d = e.dk LEFT JOIN dims h ON h.dk = f.d")
    assert [j.how for j in two.joins] == ["inner", "left"]
    for bad in ("SELECT g FROM facts", "SELECT MIN(x) FROM facts", "SELECT g, SUM(x) FROM facts GROUP BY d", "SELECT SUM(x) FROM facts, dims", "SELECT SUM(x) FROM (SELECT * FROM facts)"):
        with pytest.raises(Unsupported):
            parse(spark, bad)
    with pytest.raises(ParseException):
        parse(spark, "SELEC 1 FRM x")


def test_answers_hold_the_truth(engine, spark):
    sql = "SELECT g, SUM(x) AS s, COUNT(y) AS c, AVG(x) AS a FROM facts WHERE d < 50 GROUP BY g ORDER BY g"
    answer = engine.approximate(sql, "balanced", 95)
    assert answer.reason == "ci_within_target" and answer.looks[-1].fraction < 1
    assert [look.level for look in answer.looks][0] == pytest.approx(0.975)
    assert policies.coverage(answer.cells, spark.sql(sql), ["g"], ["s", "c", "a"])[0] >= 8 / 9
    assert [r["g"] for r in answer.wide.collect()] == ["0", "1", "2"]


def test_count_of_a_join_is_a_count(engine, spark):
    sql = "SELECT class, COUNT(y) AS c, AVG(x) AS a FROM facts f JOIN dims e ON f.d = e.dk GROUP BY class"
    answer = engine.approximate(sql, "balanced", 90, block_rows=50)
    assert answer.cells is not None and answer.downgraded is None
    truth = {r["class"]: r["c"] for r in spark.sql(sql).collect()}
    for r in answer.wide.collect():
        assert r["c"] == pytest.approx(truth[r["class"]], rel=0.2)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT COUNT(DISTINCT d) AS n FROM facts",
        "SELECT g, SUM(DISTINCT d) AS s, AVG(DISTINCT d) AS a, COUNT(DISTINCT d) AS n, COUNT(*) AS c FROM facts WHERE d > 7 GROUP BY g",
    ],
)
def test_what_does_not_scale_is_exact(engine, spark, sql):
    answer = engine.approximate(sql)
    assert answer.reason == "single_pass"
    rows = lambda df: sorted(tuple(float(x) for x in r) for r in df.collect())
    assert rows(answer.wide) == rows(spark.sql(sql))


@pytest.mark.parametrize(
    "predicate",
    ["d IN (SELECT dk FROM dims WHERE class < 3)", "d > 10 AND NOT EXISTS (SELECT 1 FROM dims e WHERE e.dk = f.d AND e.class = 4)", "d < (SELECT AVG(dk) FROM dims)"],
)
def test_predicates_with_subqueries(engine, spark, predicate):
    sql = f"SELECT g, SUM(x) AS s, COUNT(*) AS n FROM facts f WHERE {predicate} GROUP BY g"
    answer = engine.approximate(sql, "balanced", 90)
    assert answer.cells is not None and answer.downgraded is None and answer.looks[0].fraction < 1
    truth = {r["g"]: r for r in spark.sql(sql).collect()}
    got = answer.wide.collect()
    assert len(got) == 3 and all(r[c] == pytest.approx(truth[r["g"]][c], rel=0.2) for r in got for c in ("s", "n"))


@pytest.mark.parametrize(("condition", "held"), [("f.d = e.dk", True), ("f.d = e.dk AND f.x > e.class", True), ("f.d != e.dk", False), ("f.d <> e.dk", False), ("NOT f.d = e.dk", False), ("f.d >= e.dk", False), ("f.d = e.dk OR f.x > 3", False), ("f.d <=> e.dk", True), ("e.class = 1", False)])
def test_intervals_need_an_equality(engine, spark, condition, held):
    from tallgrass.operators import joins

    assert joins.interval_is_defensible(parse(spark, f"SELECT COUNT(*) AS n FROM facts f JOIN dims e ON {condition}").joins) is held


def test_counts_follow_the_files(spark, tmp_path):
    path, sql = str(tmp_path / "grown"), "SELECT SUM(x) AS s, COUNT(*) AS n FROM grown"
    engine = Engine(spark, least_rows=1000)
    for rows, total in ((50_000, 50_000), (100_000, 150_000)):
        spark.range(0, rows, numPartitions=3).select(F.lit(1.0).alias("x"), (F.col("id") % 7).alias("g")).write.mode("append").parquet(path)
        tables.register_parquet(spark, path, "grown")
        got = engine.approximate(sql, "balanced", 95).wide.first()
        assert got["s"] == pytest.approx(total, rel=0.06) and engine.populations.rows(spark.table("grown")) == total
        assert engine.populations.groups(spark.table("grown"), ["g"]) == 7


def test_a_sample_contradicts_a_remembered_count(engine, spark):
    own = Engine(spark, least_rows=1000)
    query = own.parse("SELECT SUM(x) AS s FROM facts")
    version = tables.data_version(query.fact)[0]
    own.populations._known["rows", version] = (float("inf"), 20_000)  # a third of the rows
    assert own.approximate("SELECT SUM(x) AS s FROM facts", "balanced", 95).wide.first()["s"] == pytest.approx(600_000, rel=0.06)


def test_looks_at_files_read_their_share(spark, tmp_path):
    """A table of many files: a look reads its share of the files, and the predicate reaches their scan."""
    from tallgrass.operators import sampling

    path = str(tmp_path / "many")
    spark.range(0, 240_000, numPartitions=240).select((F.xxhash64("id") % 1000).cast("double").alias("x"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(3)).alias("g")).write.parquet(path)
    tables.register_parquet(spark, path, "many")
    engine = Engine(spark)
    sql = "SELECT g, COUNT(*) AS n, AVG(x + 2000) AS a FROM many WHERE x > -500 GROUP BY g"
    answer = engine.approximate(sql, "balanced", 90)
    assert answer.cells is not None and answer.looks[-1].fraction < 0.8 and answer.looks[0].rows <= 70
    truth = {r["g"]: r for r in spark.sql(sql).collect()}
    for r in answer.wide.collect():
        assert r["n"] == pytest.approx(truth[r["g"]]["n"], rel=0.2) and r["a"] == pytest.approx(truth[r["g"]]["a"], rel=0.2)
    answer.close()
    some = sampling.files(spark.table("many"), 0.04).rows.where("x > 5").select("x")
    picked, total = sampling.picked_files(spark.table("many"), 0.04)
    assert total == 240 and 0 < picked < 24
    plan = some._jdf.queryExecution().executedPlan()
    assert "GreaterThan(x,5.0)" in plan.toString()
    some.collect()
    found = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.collectLeaves())
    assert sum(leaf.metrics().apply("numFiles").value() for leaf in found) == picked


def test_payload_is_whole_or_says_so(spark):
    assert len(tables.payload(spark.range(120_000))["rows"]) == 120_000
    cut = tables.payload(spark.range(10), most=4)
    assert len(cut["rows"]) == 4 and cut["truncated"] and not tables.payload(spark.range(4), most=4)["truncated"]


def test_static_sample_is_drawn_once(engine):
    policies._drawn.clear()
    one, two = (policies.static_ci(engine, "SELECT g, SUM(x) AS s FROM facts f WHERE f.d < 50 GROUP BY g").wide for _ in range(2))
    assert len(policies._drawn) == 1 and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_outer_joins_converge(engine):
    answer = engine.approximate("SELECT e.class, COUNT(*) AS c FROM facts f LEFT JOIN dims e ON f.d = e.dk GROUP BY e.class")
    assert answer.cells is None and answer.reason in ("converged", "progression_exhausted", "time_budget_exceeded")


def test_missing_groups_are_labelled(engine, spark):
    spark.range(0, 40_000, numPartitions=4).select((F.when(F.col("id") < 39_000, 0).otherwise(F.col("id"))).alias("g"), F.lit(1.0).alias("x")).createOrReplaceTempView("rare")
    answer = engine.approximate("SELECT g, COUNT(*) AS c FROM rare GROUP BY g", "fast")
    assert answer.reason == "groups_incomplete" and not answer.complete and answer.report()["groups_incomplete"]


def test_rules():
    assert c.next_fraction(0.01, 0) == 0.04 and c.next_fraction(0.5, 60) == 1.0 and c.next_fraction(1.0, 99) is None
    assert c.target_error("fast", None) == 0.08 and c.target_error("fast", 95) == pytest.approx(0.05) and c.target_error("fast", 20) == 0.5
    assert c.for_target("balanced", 92).ladder[-1] == 0.50 and c.for_target("nothing", None) == c.MODES["balanced"]
    assert c.pseudo_confidence(float("inf"), 0.5) == 0 and c.pseudo_confidence(0.0, 1.0) == 100


def test_service(engine):
    one = engine.execute("SELECT g, SUM(x) AS s FROM facts GROUP BY g", "approx", 95)
    again = engine.execute("SELECT g, SUM(x) AS s FROM facts GROUP BY g", "approx", 95)
    other = engine.execute("SELECT g, SUM(x) AS s FROM facts GROUP BY g", "approx", 90)
    assert not one["cached"] and again["cached"] and not other["cached"] and one["ci"]
    assert engine.progress.get(one["id"])["status"] == "done" and len(engine.progress.get(one["id"])["looks"]) == len(one["looks"])
    assert engine.execute("SELECT 1 AS a", "no such mode")["rows"] == [(1,)] and len(engine.history) == 3
    assert engine.cache.clear() == 3
    bench = engine.execute("SELECT g, SUM(x) AS s FROM facts GROUP BY g", "benchmark")
    assert bench["error_percent"] is not None and bench["error_percent"] < 20
    assert engine.clear_history() == 4 and not engine.history
    assert "Sample" in str(engine.sampled_plan("SELECT SUM(x) AS s FROM facts")["tree"]) or engine.sampled_plan("SELECT SUM(x) AS s FROM facts")["explanation"]


def test_cache_expires():
    now = [0.0]
    cache = Cache(30, lambda: now[0])
    cache.put("a", 1)
    assert cache.get("a") == 1
    now[0] = 31
    assert cache.get("a") is None


def test_policies(engine):
    scores = {s.policy: s for s in policies.score(engine, "SELECT g, SUM(x) AS s FROM facts GROUP BY g")}
    assert set(scores) == set(policies.POLICIES) and scores["exact"].mean_relative_error == 0
    assert all(s.mean_relative_error < 0.2 for s in scores.values()) and scores["adaptive"].covered is not None


def test_plans(engine, spark):
    a = inspect.plan_tree(spark.sql("SELECT g, SUM(x) AS s FROM facts GROUP BY g"))
    b = inspect.plan_tree(spark.sql("SELECT g, SUM(x) AS s FROM facts GROUP BY g"))
    other = inspect.plan_tree(spark.sql("SELECT COUNT(*) AS n FROM facts f JOIN dims e ON f.d = e.dk"))
    assert inspect.similarity(a, b) == 1 and inspect.similarity(a, other) < 1
    assert any("aggregates" in line for line in inspect.explain_tree(a))
    assert engine.plan("SELECT COUNT(*) AS n FROM facts")["tree"]["children"]


def test_repairs_only_what_is_refused(engine, spark):
    valid = "SELECT g AS cnt, COUNT(*) AS ordr FROM facts GROUP BY g ORDER BY g ASC"
    assert autocorrect.run(spark, valid)[1] == valid
    df, text = autocorrect.run(spark, "SELCT g, COUNT(*) AS n FROM fcts WHERE g <> 'FORM wher' GROPU BY g")
    assert "'FORM wher'" in text and df.count() == 3
    with pytest.raises(AnalysisException):
        autocorrect.run(spark, "SELECT zzzzqq FROM facts")
    assert any("facts" in s for s in engine.suggest("SELECT * FROM factz"))
    assert autocorrect.balanced("SELECT (1 + (2") == "SELECT (1 + (2))"


def test_sources(spark, tmp_path, monkeypatch):
    path = tmp_path / "My file-1.csv"
    path.write_text("id,name,start\n1,a,2024-01-01\n2,,2024-02-01\n")
    name, df = tables.register_csv(spark, str(path))
    assert name == "my_file_1" and spark.table(name).count() == 2 and dict(df.dtypes)["id"] == "int"
    with pytest.raises(ValueError):
        tables.register_csv(spark, "x.txt")
    assert tables.safe_identifier("1 a!") == "t_1_a" and tables.split_statements("-- x\nSELECT 1;\nSELECT 2;") == ["SELECT 1", "SELECT 2"]
    (tmp_path / "q.sql").write_text("SELECT 1 AS a;")
    tables.write_truth(spark, str(tmp_path / "q.sql"), str(tmp_path / "t.json"))
    assert json.loads((tmp_path / "t.json").read_text())["Q01"]["rows"] == [[1]]
    monkeypatch.setenv("PGHOST", "db")
    options = tables.jdbc_options("postgres", "t", "id", (0, 100))
    assert options["url"].startswith("jdbc:postgresql://db:") and options["numPartitions"] == "8"
    with pytest.raises(ValueError):
        tables.jdbc_options("other", "t")
    assert tables.pareto_lineitem(spark, 1000).agg(F.min("l_extendedprice")).first()[0] >= 100
    known = tables.Populations()
    assert known.rows(spark.range(10)) == 10 and known.groups(spark.createDataFrame([(1,), (None,)], "g int"), ["g"]) == 2


def test_stream_equals_table(spark):
    from tests.conftest import SMALL

    path = f"{SMALL}/events.parquet"
    streamed = {tuple(r) for r in online.windows_of(spark, path).select("start", "event_type", "n").collect()}
    assert streamed == {tuple(r) for r in online.windowed(spark.read.parquet(path)).select("start", "event_type", "n").collect()}
    assert online.sessions(spark.read.parquet(path)).agg(F.sum("n")).first()[0] == 1000
