"""One query for each operator of the engine, and its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions.quantiles import adjusted_level, z_quantile
from tallgrass.operators import cluster, completeness, estimators, joins, sampling
from tallgrass.operators.estimators import AVG, COUNT, SUM, Agg
from tallgrass.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def same(name: str, text: str, oracle: str | None = None) -> None:
    """A statement that runs as it is in both engines (or with its own text for the other)."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            tables.register_parquet(spark, f"{sf_dir}/{t}.parquet", t)
        return spark.sql(text)

    QUERIES[name], ORACLE[name] = run, oracle or text


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# Exact statements: the core set, the study set, joins

same("core_q01", "SELECT COUNT(*) AS cnt FROM lineitem")
same("core_q02", "SELECT ROUND(SUM(l_extendedprice), 2) AS total_price FROM lineitem")
same("core_q03", "SELECT ROUND(AVG(l_discount), 6) AS avg_discount FROM lineitem")
same("core_q04", "SELECT ROUND(SUM(l_extendedprice), 2) AS total_price FROM lineitem WHERE l_discount > CAST('0.08' AS DOUBLE)")
same("core_q05", "SELECT l_returnflag, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag")
same("core_q06", "SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS total_price FROM lineitem GROUP BY l_returnflag")
same("core_q07", "SELECT l_returnflag, COUNT(*) AS cnt FROM lineitem WHERE l_discount > CAST('0.05' AS DOUBLE) GROUP BY l_returnflag")
same("core_q08", "SELECT l_suppkey, COUNT(*) AS cnt FROM lineitem GROUP BY l_suppkey")
same("core_q09", "SELECT c.c_mktsegment, COUNT(*) AS cnt FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment")
same("core_q10", "SELECT c.c_mktsegment, ROUND(SUM(o.o_totalprice), 2) AS total_price FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderdate >= DATE '1995-01-01' GROUP BY c.c_mktsegment")
same("exact_avg_grouped", "SELECT l_returnflag, ROUND(AVG(l_extendedprice), 4) AS a FROM lineitem GROUP BY l_returnflag")
same("filter_sum_grouped", "SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
same("agg_multi", "SELECT l_returnflag, COUNT(*) AS c, ROUND(SUM(l_extendedprice), 2) AS s, ROUND(AVG(l_discount), 6) AS a FROM lineitem GROUP BY l_returnflag")
same("agg_group_two_keys", "SELECT l_returnflag, l_linestatus, COUNT(*) AS c, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
same("agg_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
same("agg_count_nulls", "SELECT l_returnflag, COUNT(CASE WHEN l_quantity > 25 THEN l_partkey END) AS c, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag")

_REVENUE = "ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue"
_CHAIN = "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey"
_YEAR = "WHERE l.l_shipdate >= DATE '1995-01-01' AND l.l_shipdate < DATE '1996-01-01'"
same("tpch_q3_revenue", f"SELECT c.c_mktsegment, {_REVENUE} {_CHAIN} {_YEAR} GROUP BY c.c_mktsegment")
same("tpch_q5", f"SELECT n.n_name, {_REVENUE} {_CHAIN} JOIN nation n ON c.c_nationkey = n.n_nationkey {_YEAR} GROUP BY n.n_name")
same("tpch_q10", f"SELECT c.c_name, c.c_nationkey, {_REVENUE.replace(', 2)', ', 4)')} {_CHAIN} WHERE l.l_returnflag = 'R' GROUP BY c.c_name, c.c_nationkey")
same("tpch_q12", f"SELECT l.l_linestatus, COUNT(*) AS order_count FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey {_YEAR} GROUP BY l.l_linestatus")
same("tpch_q18", f"SELECT c.c_name, COUNT(o.o_orderkey) AS order_count, ROUND(SUM(l.l_quantity), 2) AS total_quantity {_CHAIN} WHERE l.l_shipdate >= DATE '1995-01-01' GROUP BY c.c_name")
same("join_inner_star", f"SELECT n.n_name, ROUND(SUM(l.l_extendedprice), 2) AS s {_CHAIN} JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
same("join_inner_fact", "SELECT l.l_linestatus, COUNT(*) AS c FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_linestatus")
same("join_left", "SELECT c.c_mktsegment, COUNT(o.o_orderkey) AS c, COUNT(*) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 GROUP BY c.c_mktsegment")
same("join_right", "SELECT o.o_orderpriority, COUNT(c.c_custkey) AS c, COUNT(*) AS n FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 GROUP BY o.o_orderpriority")
same("join_full", "SELECT COUNT(*) AS n, COUNT(s.s_suppkey) AS s, COUNT(c.c_custkey) AS c FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 5000")
same("pt_semi_join", "SELECT o.o_orderpriority, COUNT(*) AS c FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o.o_orderpriority")
same("pt_anti_join", "SELECT o.o_orderpriority, COUNT(*) AS c FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) GROUP BY o.o_orderpriority")
same("pt_theta_join", "SELECT r.r_name, COUNT(*) AS c FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey GROUP BY r.r_name")

# Passthrough: windows, sets, ordering, scalar functions

same("pt_window_rank", "SELECT l_returnflag, l_suppkey, c, rk FROM (SELECT l_returnflag, l_suppkey, c, row_number() OVER (PARTITION BY l_returnflag ORDER BY c DESC, l_suppkey) AS rk FROM (SELECT l_returnflag, l_suppkey, COUNT(*) AS c FROM lineitem GROUP BY l_returnflag, l_suppkey) a) b WHERE rk <= 3", "SELECT l_returnflag, l_suppkey, c, CAST(rk AS INTEGER) AS rk FROM (SELECT l_returnflag, l_suppkey, c, row_number() OVER (PARTITION BY l_returnflag ORDER BY c DESC, l_suppkey) AS rk FROM (SELECT l_returnflag, l_suppkey, COUNT(*) AS c FROM lineitem GROUP BY l_returnflag, l_suppkey) a) b WHERE rk <= 3")
same("pt_window_frame", "SELECT o_custkey, o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
same("sort_agg_desc", "SELECT l_suppkey, COUNT(*) AS c FROM lineitem GROUP BY l_suppkey ORDER BY c DESC, l_suppkey")
same("topk_groups", "SELECT l_suppkey, COUNT(*) AS c FROM lineitem GROUP BY l_suppkey ORDER BY c DESC, l_suppkey LIMIT 10")
same("pt_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region")
same("pt_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0")
same("pt_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders")
same("pt_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same("pt_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("pt_grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
same("pt_min_max", "SELECT l_returnflag, MIN(l_quantity) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag")
same("pt_median", "SELECT l_returnflag, MEDIAN(l_quantity) AS m, PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY l_extendedprice) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, MEDIAN(l_quantity) AS m, QUANTILE_CONT(l_extendedprice, 0.9) AS p FROM lineitem GROUP BY l_returnflag")
same("pt_having", "SELECT l_suppkey, COUNT(*) AS c FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 600")
same("pt_string_fn", "SELECT upper(p_type) AS t, length(p_name) AS n, substring(p_brand, 1, 5) AS b, COUNT(*) AS c FROM part GROUP BY 1, 2, 3", "SELECT upper(p_type) AS t, CAST(length(p_name) AS INTEGER) AS n, substring(p_brand, 1, 5) AS b, COUNT(*) AS c FROM part GROUP BY 1, 2, 3")
same("pt_date_fn", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, COUNT(*) AS c FROM orders GROUP BY 1, 2", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, COUNT(*) AS c FROM orders GROUP BY 1, 2")
same("pt_json_fn", "SELECT get_json_object(props, '$.k') AS k, COUNT(*) AS c FROM events GROUP BY 1", "SELECT json_extract_string(props, '$.k') AS k, COUNT(*) AS c FROM events GROUP BY 1")
same("pt_case_when", "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, COUNT(*) AS c FROM lineitem GROUP BY 1")

# Sources


@query("scan_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49")
def scan_parquet(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_quantity")


@query("csv_roundtrip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_roundtrip(spark, sf_dir):
    from tallgrass.sources.tables import register_csv

    from tallgrass.session import new_path

    path = new_path(spark, "supplier") + ".csv"
    read(spark, sf_dir, "supplier").write.option("header", True).csv(path)
    return register_csv(spark, path, "supplier_csv", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")[1]


@query("population_size", "SELECT COUNT(*) AS n FROM lineitem")
def population_size(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("expected_group_count", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem) x")
def expected_group_count(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_suppkey").distinct().agg(F.count("*").alias("n"))


# Samples: arithmetic that both engines share stands in for the random draw

MODULUS, PLACE = 1_000_003, "l_orderkey * 2654435761 + l_linenumber * 40503"
_SAMPLE = "SELECT * FROM lineitem WHERE ({place}) % {modulus} < {threshold}"


def sample_sql(threshold: int) -> str:
    return _SAMPLE.format(place=PLACE, modulus=MODULUS, threshold=threshold)


def row_sample(spark, sf_dir, threshold: int) -> sampling.Sample:
    return sampling.by_modulus(read(spark, sf_dir, "lineitem"), threshold, MODULUS, PLACE)


@query("sample_hash_rows", f"SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM ({sample_sql(50_000)}) s")
def sample_hash_rows(spark, sf_dir):
    return row_sample(spark, sf_dir, 50_000).rows.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


BLOCK_SIZE, BLOCK_MODULUS, BLOCK_THRESHOLD = 64, 1009, 300
_BLOCKS = f"SELECT *, l_orderkey // {BLOCK_SIZE} AS b FROM lineitem WHERE ((l_orderkey // {BLOCK_SIZE}) * 40503) % {BLOCK_MODULUS} < {BLOCK_THRESHOLD}"


def block_sample(spark, sf_dir) -> sampling.Sample:
    return sampling.logical_blocks(read(spark, sf_dir, "lineitem"), F.expr(f"l_orderkey div {BLOCK_SIZE}"), BLOCK_THRESHOLD, BLOCK_MODULUS)


@query("sample_block_rows", f"SELECT COUNT(*) AS n, COUNT(DISTINCT b) AS blocks FROM ({_BLOCKS}) s")
def sample_block_rows(spark, sf_dir):
    return block_sample(spark, sf_dir).rows.agg(F.count("*").alias("n"), F.count_distinct(sampling.BLOCK).alias("blocks"))


@query("sample_bernoulli_census", "SELECT COUNT(*) AS n FROM lineitem")
def sample_bernoulli_census(spark, sf_dir):
    return sampling.bernoulli(read(spark, sf_dir, "lineitem"), 1.0).rows.agg(F.count("*").alias("n"))


@query("sampling_probe", """WITH s AS (SELECT o_orderkey AS k, o_orderkey // 256 AS b FROM orders WHERE ((o_orderkey // 256) * 40503) % 1009 < 200),
 g AS (SELECT k, b, k - LAG(k) OVER (PARTITION BY b ORDER BY k) AS gap FROM s)
SELECT COUNT(*) AS n_rows, ROUND(COUNT(*) / CAST((SELECT COUNT(*) FROM orders) AS DOUBLE), 6) AS share, CAST(SUM(CASE WHEN gap = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n_runs, COUNT(DISTINCT b) AS n_blocks FROM g""")  # fmt: skip
def sampling_probe(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    sample = sampling.logical_blocks(df, F.expr("o_orderkey div 256"), 200)
    return sampling.probe(df, sample, "o_orderkey", 256).withColumn("share", F.round("share", 6))


@query("sample_scaled_agg", f"SELECT l_returnflag, COUNT(*) / (50000 / CAST({MODULUS} AS DOUBLE)) AS c, ROUND(SUM(l_quantity) / (50000 / CAST({MODULUS} AS DOUBLE)), 2) AS s, ROUND(AVG(l_discount), 6) AS a FROM ({sample_sql(50_000)}) s GROUP BY l_returnflag")
def sample_scaled_agg(spark, sf_dir):
    sample = row_sample(spark, sf_dir, 50_000)
    aggs = [Agg(COUNT, None, "c"), Agg(SUM, F.col("l_quantity"), "s"), Agg(AVG, F.col("l_discount"), "a")]
    return joins.scaled(sample.rows, [F.col("l_returnflag")], aggs, sample.fraction).withColumns({"s": F.round("s", 2), "a": F.round("a", 6)})


@query("sample_topk", f"SELECT l_suppkey, COUNT(*) / (50000 / CAST({MODULUS} AS DOUBLE)) AS c FROM ({sample_sql(50_000)}) s GROUP BY l_suppkey ORDER BY c DESC, l_suppkey LIMIT 5")
def sample_topk(spark, sf_dir):
    sample = row_sample(spark, sf_dir, 50_000)
    return joins.scaled(sample.rows, [F.col("l_suppkey")], [Agg(COUNT, None, "c")], sample.fraction).orderBy(F.desc("c"), "l_suppkey").limit(5)


@query("join_sample_scaled", f"SELECT o.o_orderpriority, ROUND(SUM(s.l_extendedprice) / (50000 / CAST({MODULUS} AS DOUBLE)), 2) AS s FROM ({sample_sql(50_000)}) s JOIN orders o ON s.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority")
def join_sample_scaled(spark, sf_dir):
    sample = row_sample(spark, sf_dir, 50_000)
    rows = joins.joined(sample.rows, [joins.Join(read(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))])
    return joins.scaled(rows, [F.col("o_orderpriority")], [Agg(SUM, F.col("l_extendedprice"), "s")], sample.fraction).withColumn("s", F.round("s", 2))


# Sufficient statistics and estimators

_PREDICATE = "l_quantity > 25"
_STATS = """COUNT(x) AS n_domain, ROUND(SUM(x), 2) AS sum_x, ROUND(SUM(x * x) / 1e6, 2) AS sum_xx, ROUND(SUM(x * x * x) / 1e12, 2) AS sum_xxx,
 ROUND(VAR_SAMP(x), 2) AS variance, MIN(x) AS min_x, MAX(x) AS max_x, ROUND(SKEWNESS(x), 6) AS skewness"""


def _flat(stats: DataFrame, alias: str) -> DataFrame:
    c = F.col(alias)
    return stats.select(
        *(k for k in stats.columns if k != alias), c["n_domain"].alias("n_domain"), F.round(c["sum_x"], 2).alias("sum_x"), F.round(c["sum_xx"] / 1e6, 2).alias("sum_xx"), F.round(c["sum_xxx"] / 1e12, 2).alias("sum_xxx"),
        F.round(c["variance"], 2).alias("variance"), c["min_x"].alias("min_x"), c["max_x"].alias("max_x"), F.round(c["skewness"], 6).alias("skewness"),
    )


@query("suffstats_pushed", f"SELECT l_returnflag, COUNT(*) AS n_rows, {_STATS} FROM (SELECT l_returnflag, l_extendedprice AS x FROM ({sample_sql(100_000)}) s WHERE {_PREDICATE}) t GROUP BY l_returnflag")
def suffstats_pushed(spark, sf_dir):
    return _flat(estimators.statistics(row_sample(spark, sf_dir, 100_000).rows, [F.col("l_returnflag")], [Agg(SUM, F.col("l_extendedprice"), "x")], F.expr(_PREDICATE)), "x")


@query("suffstats_filtered", f"SELECT l_returnflag, COUNT(*) AS n_bucket, COUNT(x) AS n_rows, {_STATS} FROM (SELECT l_returnflag, CASE WHEN {_PREDICATE} THEN l_extendedprice END AS x FROM ({sample_sql(100_000)}) s) t GROUP BY l_returnflag HAVING COUNT(x) > 0")
def suffstats_filtered(spark, sf_dir):
    return _flat(estimators.filtered_statistics(row_sample(spark, sf_dir, 100_000).rows, [F.col("l_returnflag")], [Agg(SUM, F.col("l_extendedprice"), "x")], F.expr(_PREDICATE)), "x")


_LEVEL = adjusted_level(0.95, 3)
_Z = repr(z_quantile(_LEVEL))


def _estimated(spark, sf_dir, agg: Agg, threshold: int, where=None, method: str | None = "clt") -> DataFrame:
    sample, total = row_sample(spark, sf_dir, threshold), read(spark, sf_dir, "lineitem").count()
    n = sample.rows.count()
    stats = estimators.statistics(sample.rows, [F.col("l_returnflag")], [agg], where)
    cells = estimators.grid(stats, ["l_returnflag"], [agg], n, total, _LEVEL, method=method)
    return cells.select("l_returnflag", F.round("estimate", 4).alias("estimate"), F.round("half_width", 4).alias("half_width"))


def _estimate_sql(threshold: int, estimate: str, half: str, inside: str = "1 = 1", column: str = "l_extendedprice") -> str:
    return f"""WITH s AS ({sample_sql(threshold)}), k AS (SELECT CAST((SELECT COUNT(*) FROM s) AS DOUBLE) AS n, CAST(COUNT(*) AS DOUBLE) AS total FROM lineitem),
 g AS (SELECT l_returnflag, CAST(COUNT({column}) AS DOUBLE) AS nd, SUM({column}) AS sx, VAR_SAMP({column}) AS v, MIN({column}) AS lo, MAX({column}) AS hi FROM s WHERE {inside} GROUP BY l_returnflag)
SELECT l_returnflag, ROUND({estimate}, 4) AS estimate, ROUND({half}, 4) AS half_width FROM g, k"""


_EXPANDED = "((nd - 1) * v + sx * sx * (n - nd) / (nd * n)) / (n - 1)"


@query("est_sum_clt", _estimate_sql(100_000, "sx * total / n", f"{_Z} * SQRT(total * total * (1 - n / total) / n * ({_EXPANDED}))", _PREDICATE))
def est_sum_clt(spark, sf_dir):
    return _estimated(spark, sf_dir, Agg(SUM, F.col("l_extendedprice"), "x"), 100_000, F.expr(_PREDICATE))


@query("est_count_clt", _estimate_sql(100_000, "nd * total / n", f"{_Z} * SQRT(total * total * (1 - n / total) / n * (n * (nd / n) * (1 - nd / n) / (n - 1)))", _PREDICATE))
def est_count_clt(spark, sf_dir):
    return _estimated(spark, sf_dir, Agg(COUNT, None, "x"), 100_000, F.expr(_PREDICATE))


@query("est_avg_ratio", _estimate_sql(500_000, "sx / nd", f"{_Z} * SQRT((1 - n / total) * n * ((nd - 1) * v) / (nd * nd * (n - 1)))"))
def est_avg_ratio(spark, sf_dir):
    return _estimated(spark, sf_dir, Agg(AVG, F.col("l_extendedprice"), "x"), 500_000)


_LOG = f"LN(3 / (1 - {_LEVEL!r}))"


@query("est_bernstein", _estimate_sql(100_000, "sx * total / n", f"total * (SQRT(2 * ({_EXPANDED}) * {_LOG} / n) + 3 * (GREATEST(0, hi) - LEAST(0, lo)) * {_LOG} / (n - 1))", _PREDICATE))
def est_bernstein(spark, sf_dir):
    return _estimated(spark, sf_dir, Agg(SUM, F.col("l_extendedprice"), "x"), 100_000, F.expr(_PREDICATE), "bernstein")


@query("est_hoeffding", _estimate_sql(100_000, "sx * total / n", f"total * (GREATEST(0, hi) - LEAST(0, lo)) * SQRT(LN(2 / (1 - {_LEVEL!r})) / 2 / n)", _PREDICATE))
def est_hoeffding(spark, sf_dir):
    return _estimated(spark, sf_dir, Agg(SUM, F.col("l_extendedprice"), "x"), 100_000, F.expr(_PREDICATE), "hoeffding")


@query("bounds_suffstats", f"SELECT l_returnflag, COUNT(*) AS n, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, ROUND(STDDEV_SAMP(l_extendedprice), 4) AS sd, ROUND(SQRT(COUNT(*) * (LN(40) / 2)) / (50000 / CAST({MODULUS} AS DOUBLE)), 4) AS count_bound FROM ({sample_sql(50_000)}) s GROUP BY l_returnflag")
def bounds_suffstats(spark, sf_dir):
    sample = row_sample(spark, sf_dir, 50_000)
    x = F.col("l_extendedprice")
    return sample.rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.round(F.stddev_samp(x), 4).alias("sd")).withColumn("count_bound", F.round(estimators.bounded_count(F.col("n"), sample.fraction, 0.95), 4))


# Blocks


@query("block_aggregate", f"SELECT b AS block, l_returnflag, COUNT(*) AS n_rows, CAST(COUNT(l_extendedprice) AS DOUBLE) AS k, ROUND(SUM(l_extendedprice), 2) AS t, ROUND(SUM(l_extendedprice * l_extendedprice) / 1e6, 2) AS xx FROM ({_BLOCKS}) s GROUP BY b, l_returnflag")
def block_aggregate(spark, sf_dir):
    totals = cluster.block_totals(block_sample(spark, sf_dir).rows, [F.col("l_returnflag")], [Agg(SUM, F.col("l_extendedprice"), "x")])
    return totals.select(F.col(sampling.BLOCK).alias("block"), "l_returnflag", "n_rows", F.col("x.k"), F.round("x.t", 2).alias("t"), F.round(F.col("x.xx") / 1e6, 2).alias("xx"))


_T_STEP = "SUM(t) AS t, SUM(t * t) AS tt, SUM(k) AS k, SUM(k * k) AS kk, SUM(t * k) AS tk, SUM(xx) AS xx"


def _cluster_sql(keys: str, source: str, select: str, tail: str = "") -> str:
    return f"""WITH s AS ({_BLOCKS}), j AS ({source}),
 bt AS (SELECT b, {keys}, SUM(l_extendedprice) AS t, CAST(COUNT(l_extendedprice) AS DOUBLE) AS k, SUM(l_extendedprice * l_extendedprice) AS xx FROM j GROUP BY b, {keys}),
 g AS (SELECT {keys}, {_T_STEP} FROM bt GROUP BY {keys}),
 p AS (SELECT CAST((SELECT COUNT(DISTINCT b) FROM s) AS DOUBLE) AS m, CAST((SELECT COUNT(*) FROM s) AS DOUBLE) AS n, CAST(COUNT(DISTINCT l_orderkey // {BLOCK_SIZE}) AS DOUBLE) AS big, CAST(COUNT(*) AS DOUBLE) AS total FROM lineitem)
SELECT {keys}, {select} FROM g, p {tail}"""


_GROWN = "big * big * (1 - m / big) / m"
_VAR_SUM = f"{_GROWN} * (tt - t * t / m) / (m - 1)"
_VAR_AVG = f"{_GROWN} * (tt - 2 * (t / k) * tk + (t / k) * (t / k) * kk) / (m - 1) / ((big / m * k) * (big / m * k))"


def _clustered(spark, sf_dir, agg: Agg, joined_to_customer: bool = False) -> tuple[DataFrame, str]:
    sample = block_sample(spark, sf_dir)
    m = sample.rows.select(sampling.BLOCK).distinct().count()
    rows, key = sample.rows, "l_returnflag"
    if joined_to_customer:
        key = "c_mktsegment"
        rows = joins.joined(rows, [joins.Join(read(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")), joins.Join(read(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))])
    summary = cluster.block_summary(cluster.block_totals(rows, [F.col(key)], [agg]), [key], [agg])
    cells = cluster.cluster_intervals(cluster.long_sums(summary, [key], [agg]), m, sample.total_blocks, funcs={agg.func})
    return cells, key


def _rounded(cells: DataFrame, key: str) -> DataFrame:
    """Estimate and standard error: the quantile for m - 1 degrees of freedom is tested elsewhere."""
    return cells.select(key, F.round("estimate", 3).alias("estimate"), F.round(F.sqrt("variance"), 3).alias("standard_error"))


@query("est_cluster_sum", _cluster_sql("l_returnflag", "SELECT * FROM s", f"ROUND(t * big / m, 3) AS estimate, ROUND(SQRT({_VAR_SUM}), 3) AS standard_error"))
def est_cluster_sum(spark, sf_dir):
    return _rounded(*_clustered(spark, sf_dir, Agg(SUM, F.col("l_extendedprice"), "x")))


_JOINED = "SELECT s.*, c.c_mktsegment FROM s JOIN orders o ON s.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey"


@query("join_cluster_summary", _cluster_sql("c_mktsegment", _JOINED, f"ROUND(t * big / m, 3) AS estimate, ROUND(SQRT({_VAR_SUM}), 3) AS standard_error"))
def join_cluster_summary(spark, sf_dir):
    return _rounded(*_clustered(spark, sf_dir, Agg(SUM, F.col("l_extendedprice"), "x"), True))


@query("join_cluster_avg", _cluster_sql("c_mktsegment", _JOINED, f"ROUND(t / k, 3) AS estimate, ROUND(SQRT({_VAR_AVG}), 3) AS standard_error"))
def join_cluster_avg(spark, sf_dir):
    return _rounded(*_clustered(spark, sf_dir, Agg(AVG, F.col("l_extendedprice"), "x"), True))


@query("design_effect", _cluster_sql("l_returnflag", "SELECT * FROM s", f"ROUND(({_VAR_SUM}) / (total * total * (1 - n / total) / n * (xx - t * t / n) / (n - 1)), 6) AS design_effect"))
def design_effect(spark, sf_dir):
    agg, sample = Agg(SUM, F.col("l_extendedprice"), "x"), block_sample(spark, sf_dir)
    m, n = sample.rows.agg(F.count_distinct(sampling.BLOCK), F.count("*")).first()
    summary = cluster.block_summary(cluster.block_totals(sample.rows, [F.col("l_returnflag")], [agg]), ["l_returnflag"], [agg])
    found = cluster.design_effects(summary, ["l_returnflag"], [agg], m, sample.total_blocks, n, read(spark, sf_dir, "lineitem").count())
    return found.select("l_returnflag", F.round("design_effect", 6).alias("design_effect"))


# Completeness, sketches, cardinalities, join advice

@query("completeness_chao1", f"""WITH c AS (SELECT l_partkey, COUNT(*) AS c FROM ({sample_sql(20_000)}) s GROUP BY l_partkey)
SELECT COUNT(*) AS observed, CAST(SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, CAST(SUM(CASE WHEN c = 2 THEN 1 ELSE 0 END) AS BIGINT) AS doubletons, CAST(SUM(c) AS BIGINT) AS n_rows,
 ROUND(COUNT(*) + SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) * (SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) - 1) / (2 * CAST(SUM(CASE WHEN c = 2 THEN 1 ELSE 0 END) + 1 AS DOUBLE)), 6) AS chao1,
 ROUND(1 - SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) / CAST(SUM(c) AS DOUBLE), 6) AS good_turing FROM c""")  # fmt: skip
def completeness_chao1(spark, sf_dir):
    found = completeness.group_frequencies(row_sample(spark, sf_dir, 20_000).rows, ["l_partkey"])
    return found.withColumns({"chao1": F.round("chao1", 6), "good_turing": F.round("good_turing", 6)})


@query("hll_distinct", "SELECT COUNT(DISTINCT l_orderkey) AS n, TRUE AS within_2_percent FROM lineitem")
def hll_distinct(spark, sf_dir):
    """The exact count, and whether the sketch comes within 2 % of it."""
    df = read(spark, sf_dir, "lineitem")
    both = df.agg(F.count_distinct("l_orderkey").alias("n")).crossJoin(joins.hll(df, "l_orderkey"))  # two single rows
    return both.select("n", (F.abs(F.col("distinct") - F.col("n")) <= 0.02 * F.col("n")).alias("within_2_percent"))


@query("join_rate_selection", "SELECT n AS n_groups, GREATEST(0.07, LEAST(0.60, 200.0 * n / total)) AS rate, TRUE AS close FROM (SELECT COUNT(DISTINCT l_suppkey) AS n, CAST(COUNT(*) AS DOUBLE) AS total FROM lineitem) x")
def join_rate_selection(spark, sf_dir):
    """The rate by the exact number of groups, and whether the sketch leads within 5 % of it."""
    fact, key = read(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    n, total = fact.agg(F.count_distinct(key), F.count("*")).first()
    rate, guess = (joins.starting_rate(total, groups, 2) for groups in (n, joins.approximate_groups(fact, [key])))
    return spark.createDataFrame([(n, rate, abs(guess - rate) <= 0.05 * rate)], "n_groups long, rate double, close boolean")


_HALF = "pmod(o_orderkey * 40503, 1009) < 504"


@query("join_cardinality_sampled", "SELECT ROUND(COUNT(*) / (504 / CAST(1009 AS DOUBLE)), 4) AS n FROM (SELECT * FROM orders WHERE (o_orderkey * 40503) % 1009 < 504) o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
def join_cardinality_sampled(spark, sf_dir):
    some = read(spark, sf_dir, "orders").where(_HALF).withColumnRenamed("o_orderkey", "l_orderkey")
    return some.join(read(spark, sf_dir, "lineitem"), "l_orderkey").agg(F.round(F.count("*") / F.lit(504 / 1009), 4).alias("n"))


@query("join_cardinality_ndv", "SELECT CAST((SELECT COUNT(*) FROM orders) AS DOUBLE) * (SELECT COUNT(*) FROM lineitem) / GREATEST((SELECT COUNT(DISTINCT o_orderkey) FROM orders), (SELECT COUNT(DISTINCT l_orderkey) FROM lineitem), 1) AS n")
def join_cardinality_ndv(spark, sf_dir):
    a = read(spark, sf_dir, "orders").agg(F.count("*").cast("double").alias("ra"), F.count_distinct("o_orderkey").alias("da"))
    b = read(spark, sf_dir, "lineitem").agg(F.count("*").cast("double").alias("rb"), F.count_distinct("l_orderkey").alias("db"))
    return a.crossJoin(b).select(joins.distinct_cardinality(F.col("ra"), F.col("rb"), F.col("da"), F.col("db")).alias("n"))  # two single rows


@query("join_order_advice", """WITH n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS r, COUNT(DISTINCT n_nationkey) AS k FROM nation),
 c AS (SELECT CAST(COUNT(*) AS DOUBLE) AS r, COUNT(DISTINCT c_custkey) AS k, COUNT(DISTINCT c_nationkey) AS up FROM customer),
 o AS (SELECT CAST(COUNT(*) AS DOUBLE) AS r, COUNT(DISTINCT o_orderkey) AS k, COUNT(DISTINCT o_custkey) AS up FROM orders),
 l AS (SELECT CAST(COUNT(*) AS DOUBLE) AS r, COUNT(DISTINCT l_orderkey) AS up FROM lineitem),
 two AS (SELECT n.r * c.r / GREATEST(n.k, c.up) AS r FROM n, c), three AS (SELECT two.r * o.r / GREATEST(c.k, o.up) AS r FROM two, c, o)
SELECT 0 AS step, 'nation' AS name, ROUND(r, 2) AS n_rows FROM n UNION ALL SELECT 1, 'customer', ROUND(r, 2) FROM two UNION ALL SELECT 2, 'orders', ROUND(r, 2) FROM three
UNION ALL SELECT 3, 'lineitem', ROUND(three.r * l.r / GREATEST(o.k, l.up), 2) FROM three, o, l""")  # fmt: skip
def join_order_advice(spark, sf_dir):
    names = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey"}
    rows = {t: float(read(spark, sf_dir, t).count()) for t in names}
    distinct = lambda t, c: float(read(spark, sf_dir, t).agg(F.count_distinct(c)).first()[0])
    edges = {("lineitem", "orders"): (distinct("lineitem", "l_orderkey"), distinct("orders", "o_orderkey")), ("orders", "customer"): (distinct("orders", "o_custkey"), distinct("customer", "c_custkey")), ("customer", "nation"): (distinct("customer", "c_nationkey"), distinct("nation", "n_nationkey"))}
    order = joins.JoinGraph(rows, edges).order()
    return spark.createDataFrame([(i, t, round(float(r), 2)) for i, (t, r) in enumerate(order)], "step int, name string, n_rows double")


@query("semi_join_reduction", "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join_reduction(spark, sf_dir):
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    kept = joins.semi_join_reduced(read(spark, sf_dir, "lineitem"), urgent, "l_orderkey", "o_orderkey")
    return kept.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("bloom_semi_join", "SELECT o_orderpriority, COUNT(*) AS c FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) GROUP BY o_orderpriority")
def bloom_semi_join(spark, sf_dir):
    """A Bloom filter of the small side's keys, probed in the scan of the large side; the semi-join takes off its false positives."""
    few = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    some = joins.Bloom(few, "o_custkey", few.count()).reduced(read(spark, sf_dir, "orders"), "o_custkey")
    return some.join(few, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("c"))


_TWO_PHASE = "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey WHERE o.o_orderpriority = '1-URGENT' AND p.p_size <= 5"


@query("two_phase_reduction", f"SELECT COUNT(*) AS n, ROUND(SUM(l.l_quantity), 2) AS q FROM {_TWO_PHASE}")
def two_phase_reduction(spark, sf_dir):
    """Pilot, selectivities and Bloom filters, then the joins on what is left."""
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    small = read(spark, sf_dir, "part").where("p_size <= 5").select("p_partkey")
    fact, _ = joins.two_phase(read(spark, sf_dir, "lineitem"), [(urgent, "l_orderkey", "o_orderkey"), (small, "l_partkey", "p_partkey")], pilot=0.05)
    rows = fact.join(urgent, F.expr("l_orderkey = o_orderkey")).join(small, F.expr("l_partkey = p_partkey"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


# The adaptive engine end to end


def _engine(spark, sf_dir, sql: str):
    """An engine that samples tables from a thousand rows on, with the tables of a statement."""
    from tallgrass.service import Engine

    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            tables.register_parquet(spark, f"{sf_dir}/{t}.parquet", t)
    return Engine(spark, least_rows=1000)


FLAGSHIP = "SELECT l_returnflag, SUM(l_extendedprice) AS revenue, COUNT(*) AS n, AVG(l_discount) AS discount FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag"


@query("approx_adaptive")
def approx_adaptive(spark, sf_dir):
    """Cells with intervals of the flagship statement, within 10 %."""
    return approximate_flagship(spark, sf_dir).cells


def approximate_flagship(spark, sf_dir):
    return _engine(spark, sf_dir, FLAGSHIP).approximate(FLAGSHIP, "balanced", 90)


JOINED = "SELECT c.c_mktsegment, SUM(o.o_totalprice) AS s FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"


@query("approx_join")
def approx_join(spark, sf_dir):
    return _engine(spark, sf_dir, JOINED).approximate(JOINED, "balanced", 90, block_rows=64).cells


def _within(spark, answer, sql: str, keys: list[str], share: float) -> DataFrame:
    """The exact value of every cell, and whether the answer's estimate comes within a share of it."""
    from tallgrass.plans.frontend import parse

    values = [a.alias for a in parse(spark, sql).aggs]
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("alias"), F.col(v).cast("double").alias("truth")) for v in values))).alias("x")
    truth = spark.sql(sql).select(*keys, pairs).select(*keys, "x.*")
    close = F.abs(F.col("estimate") - F.col("truth")) <= share * F.abs("truth")
    both = truth.join(answer.cells.select(*keys, "alias", "estimate"), [*keys, "alias"], "left")
    return both.select(*keys, "alias", F.round("truth", 4).alias("truth"), F.coalesce(close, F.lit(False)).alias("close"))


def _truth_sql(sql: str, keys: str, values: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{v}' AS alias, ROUND(CAST({v} AS DOUBLE), 4) AS truth, TRUE AS close FROM ({sql})" for v in values)


@query("approx_adaptive_within", _truth_sql(FLAGSHIP, "l_returnflag", ["revenue", "n", "discount"]))
def approx_adaptive_within(spark, sf_dir):
    """The flagship against the exact answer: every cell within twice its target of 10 %."""
    return _within(spark, approximate_flagship(spark, sf_dir), FLAGSHIP, ["l_returnflag"], 0.2)


@query("approx_join_within", _truth_sql(JOINED, "c_mktsegment", ["s"]))
def approx_join_within(spark, sf_dir):
    return _within(spark, _engine(spark, sf_dir, JOINED).approximate(JOINED, "balanced", 90, block_rows=64), JOINED, ["c_mktsegment"], 0.2)


DISTINCT = "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, SUM(DISTINCT l_quantity) AS q, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag"


@query("approx_distinct", DISTINCT)
def approx_distinct(spark, sf_dir):
    """Aggregates over distinct values in approximate mode: exact, for they do not scale."""
    return _engine(spark, sf_dir, DISTINCT).approximate(DISTINCT, "balanced", 90).wide


SUBQUERY = "SELECT COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT') AND l_discount > 0.02"


@query("approx_subquery", " UNION ALL ".join(f"SELECT '{v}' AS alias, ROUND(CAST({v} AS DOUBLE), 4) AS truth, TRUE AS close FROM ({SUBQUERY})" for v in ("n", "q")))
def approx_subquery(spark, sf_dir):
    """A predicate with a subquery, sampled; every cell within twice its target of 10 %."""
    return _within(spark, _engine(spark, sf_dir, SUBQUERY).approximate(SUBQUERY, "balanced", 90), SUBQUERY, [], 0.2)


_STATIC = f"""WITH s AS ({sample_sql(50_000)}), k AS (SELECT CAST((SELECT COUNT(*) FROM s) AS DOUBLE) AS n, CAST(COUNT(*) AS DOUBLE) AS total FROM lineitem),
 g AS (SELECT l_returnflag, CAST(COUNT(*) AS DOUBLE) AS nd, SUM(l_extendedprice) AS sx, VAR_SAMP(l_extendedprice) AS v, AVG(l_discount) AS a, VAR_SAMP(l_discount) AS va FROM s WHERE {_PREDICATE} GROUP BY l_returnflag)
SELECT l_returnflag, 'revenue' AS alias, ROUND(sx * total / n, 2) AS estimate, ROUND(SQRT(total * total * (1 - n / total) / n * ({_EXPANDED})), 2) AS standard_error FROM g, k
UNION ALL SELECT l_returnflag, 'n', ROUND(nd * total / n, 2), ROUND(SQRT(total * total * (1 - n / total) / n * (n * (nd / n) * (1 - nd / n) / (n - 1))), 2) FROM g, k
UNION ALL SELECT l_returnflag, 'discount', ROUND(a, 2), ROUND(SQRT((1 - n / total) * n * ((nd - 1) * va) / (nd * nd * (n - 1))), 2) FROM g, k"""


@query("policy_static_ci", _STATIC)
def policy_static_ci(spark, sf_dir):
    """A sample that is drawn once and kept, by arithmetic that any engine has."""
    from tallgrass.policies import static_ci

    draw = lambda df: sampling.by_modulus(df, 50_000, MODULUS, PLACE)
    cells = static_ci(_engine(spark, sf_dir, FLAGSHIP), FLAGSHIP, draw=draw, name="modulus").cells
    return cells.select("l_returnflag", "alias", F.round("estimate", 2).alias("estimate"), F.round(F.sqrt("variance"), 2).alias("standard_error"))


@query("online_aggregation", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, ROUND(AVG(value) + 1e-9, 4) AS mean, ROUND(VAR_SAMP(value) + 1e-9, 4) AS variance
FROM events GROUP BY 1, 2""")  # fmt: skip
def online_aggregation(spark, sf_dir):
    from tallgrass.streaming.online import windows_of

    found = windows_of(spark, f"{sf_dir}/events.parquet")
    nudged = (F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("mean", "variance"))  # values of two decimals make ties
    return found.select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), *nudged)
