"""Sources and sinks: Parquet, CSV and JDBC views, row payloads, JSON truth files, generators."""

from __future__ import annotations

import json
import os
import re
import time
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_identifier(name: str) -> str:
    """A lower-case name of letters, digits and underscores that starts with a letter."""
    clean = re.sub(r"\W+", "_", Path(name).stem, flags=re.ASCII).strip("_").lower()
    if not clean:
        raise ValueError(f"no identifier can be made of {name!r}")
    return clean if clean[0].isalpha() else f"t_{clean}"


_schemas: dict = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. The job that infers the schema runs once for each state (time, length) of the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def register_parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    df = read_parquet(spark, path)
    df.createOrReplaceTempView(name)
    return df


def register_csv(spark: SparkSession, path: str, name: str | None = None, schema: str | None = None) -> tuple[str, DataFrame]:
    """A CSV file with a header as a view; types are inferred where no schema is given (one more pass over the file)."""
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv files can be registered")
    view = safe_identifier(name or path)
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df.createOrReplaceTempView(view)
    return view, df


#: Environment variables and URL of each JDBC source: host, port, database, user, password.
JDBC = {
    "postgres": ("jdbc:postgresql://{}:{}/{}", ("PGHOST", "PGPORT", "PGDATABASE", "PGUSER", "PGPASSWORD"), ("localhost", "5432", "postgres", "postgres", "")),
    "mysql": ("jdbc:mysql://{}:{}/{}", ("MYSQL_HOST", "MYSQL_PORT", "MYSQL_DATABASE", "MYSQL_USER", "MYSQL_PASSWORD"), ("localhost", "3306", "mysql", "root", "")),
}


def jdbc_options(source: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> dict[str, str]:
    """Reader options for a table of a JDBC source; with a partition column the read is split over executors."""
    if source not in JDBC:
        raise ValueError(f"unknown source {source!r}")
    url, names, defaults = JDBC[source]
    host, port, database, user, password = (os.environ.get(n, d) for n, d in zip(names, defaults, strict=True))
    options = {"url": url.format(host, port, database), "dbtable": table, "user": user, "password": password}
    if partition_column and bounds:
        options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return options


def register_jdbc(spark: SparkSession, source: str, table: str, name: str | None = None, **options) -> DataFrame:
    """Needs the driver's jar on the class path."""
    df = spark.read.format("jdbc").options(**jdbc_options(source, table, **options)).load()
    df.createOrReplaceTempView(safe_identifier(name or table))
    return df


def payload(df: DataFrame, most: int | None = None) -> dict:
    """Columns, rows (tuples) and seconds of a result, for clients that want plain values.

    All rows, unless a client asks for ``most`` of them: then ``truncated`` says whether there are more.
    """
    began = time.perf_counter()
    rows = [tuple(r) for r in (df if most is None else df.limit(most + 1)).collect()]
    out = {"columns": df.columns, "rows": rows if most is None else rows[:most], "time": time.perf_counter() - began}
    return out if most is None else out | {"truncated": len(rows) > most}


def split_statements(text: str) -> list[str]:
    """Statements of a query file: comment lines dropped, cut at semicolons."""
    body = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith("--"))
    return [s.strip() for s in body.split(";") if s.strip()]


def write_truth(spark: SparkSession, query_file: str, output: str) -> dict:
    """Exact answers of the statements of a file, as JSON (Q01, Q02, ...)."""
    statements = split_statements(Path(query_file).read_text())
    truth = {f"Q{i:02d}": {"sql": s, **payload(spark.sql(s))} for i, s in enumerate(statements, 1)}
    Path(output).write_text(json.dumps(truth, default=str, indent=1))
    return truth


def pareto_lineitem(spark: SparkSession, rows: int, alpha: float = 1.5, seed: int = 7) -> DataFrame:
    """A fact table with Pareto-tailed prices (scale 100, cut at five million)."""
    u = F.greatest(F.rand(seed), F.lit(1e-12))
    return spark.range(rows).select(
        F.col("id").alias("l_orderkey"),
        (F.rand(seed + 1) * 1000).cast("long").alias("l_suppkey"),
        F.element_at(F.array(*map(F.lit, "ANR")), (F.rand(seed + 2) * 3).cast("int") + 1).alias("l_returnflag"),
        F.least(F.lit(100.0) / F.pow(u, F.lit(1 / alpha)), F.lit(5e6)).alias("l_extendedprice"),
        (1 + F.floor(F.rand(seed + 3) * 50)).cast("double").alias("l_quantity"),
        F.round(F.rand(seed + 4) * 0.1, 2).alias("l_discount"),
    )


def leaves_of(plan) -> list:
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def below_views(df: DataFrame) -> DataFrame:
    """The table that temporary views stand for, under the same name: views hide a table's metadata columns."""
    plan, name = df._jdf.queryExecution().analyzed(), None
    while plan.getClass().getSimpleName() in ("SubqueryAlias", "View"):
        if name is None and plan.getClass().getSimpleName() == "SubqueryAlias":
            name = plan.alias()
        plan = plan.child()
    spark = df.sparkSession
    out = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
    return out.alias(name) if name else out


def data_version(df: DataFrame) -> tuple[str, bool]:
    """Text that changes with the plan or the files of a DataFrame, and whether all of its data are files.

    Files are taken from the listing that the DataFrame itself reads: roots and their times, number, paths and total length. The
    list stays in the JVM.
    """
    parts, files = [str(df.semanticHash())], True
    hadoop = df.sparkSession._jsc.hadoopConfiguration()
    for leaf in leaves_of(df._jdf.queryExecution().analyzed()):
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            location = leaf.relation().location()
            try:
                listed = location.allFiles()
            except Py4JError:  # a catalog's index lists its files only when they are read
                files = False
                continue
            roots, times = location.rootPaths(), []
            for i in range(roots.size()):
                root = roots.apply(i)
                times.append((root.toString(), root.getFileSystem(hadoop).getFileStatus(root).getModificationTime()))
            parts.append(str((times, listed.size(), listed.hashCode(), location.sizeInBytes())))
        elif kind not in ("Range", "LocalRelation", "OneRowRelation"):
            files = False
    return "\n".join(parts), files


class Populations:
    """Row counts and exact group counts of tables, remembered until the files change (``data_version``); for sources that are
    no files, such as JDBC, for ``seconds``. The controller forgets a count that a sample contradicts."""

    def __init__(self, seconds: float = 60.0, clock=time.monotonic):
        self._known: dict = {}
        self.seconds, self.clock = seconds, clock

    def _remember(self, kind: str, df: DataFrame, compute) -> int:
        version, files = data_version(df)
        until, value = self._known.get((kind, version), (-1.0, None))
        if until < self.clock():
            value = compute()
            self._known[kind, version] = (float("inf") if files else self.clock() + self.seconds, value)
        return value

    def rows(self, df: DataFrame) -> int:
        return self._remember("rows", df, df.count)

    def groups(self, df: DataFrame, keys: list) -> int:
        """Exact number of groups, null a group of its own."""
        return self._remember("groups", df.select(*keys), lambda: df.select(*keys).distinct().count())

    def clear(self) -> None:
        self._known.clear()
