"""Size-tiered compaction of shards under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Shards of like size (one tier: a factor of ``FAN_IN``) are merged
in runs into files of up to the target size, tier by tier, until no tier has ``FAN_IN`` shards left. Shards are never changed
in place. A version is a file that names the shards that it adds and drops, every ``SNAPSHOT``-th one all of them; readers take
the newest version. It is written aside and renamed to the next version, which fails if another writer was first, so a
version is either there as a whole or not at all. A merge that meets another writer's version goes on top of it if that one has
left its shards alone.

The manifest holds the rows of each shard: a merge commits only if it has written exactly the rows that it has read. Shards are
known by their folder and file name, which the store makes itself, so that any characters may stand in its path.

The driver holds names and sizes of shards only (Spark's own file listing does as well). A merge job takes at most ``FILES``
shards, so the file-to-run table that is broadcast is bounded; each task writes one run of at most the target size, and may be
run again.

Defined cases: any schema is kept as it is, null values, empty and long texts, repeated rows and clashing column names
included; an empty arrival commits a version without a shard; a table without shards reads as empty; a shard that is larger
than the target is left alone; ``vacuum`` leaves files alone that are younger than ``age`` seconds, for a writer may be about to
commit them.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import quoted, shuffles_removed
from tallgrass.session import new_path

TARGET, FAN_IN, FILES, SNAPSHOT = 64 << 20, 4, 10_000, 16
#: Folder and file name of a shard: unique, and the same in listings, manifests and metadata columns.
KEY = r"([^/]+/[^/]+)$"


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    rows: int = 0

    @property
    def key(self) -> str:
        return re.search(KEY, self.path)[1]


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def plan(shards: list[Shard], target: int, fan_in: int) -> list[list[Shard]]:
    """Runs of at least ``fan_in`` shards of one tier whose sizes sum up to the target at most (two may do to fill it)."""
    tiers: dict[int, list[Shard]] = {}
    for shard in shards:
        if shard.size < target:
            tiers.setdefault(int(math.log(max(shard.size, 1), fan_in)), []).append(shard)
    runs = []
    for tier in sorted(tiers):
        run: list[Shard] = []
        for shard in sorted(tiers[tier], key=lambda s: (s.size, s.path)):
            if run and sum(s.size for s in run) + shard.size > target:
                if len(run) > 1:
                    runs.append(run)
                run = []
            run.append(shard)
        if len(run) >= fan_in:
            runs.append(run)
    return runs


class ShardStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _version_path(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:08d}.json"

    def version(self) -> int:
        """The newest committed version, 0 before the first."""
        where = self._path(f"{self.path}/manifest")
        if not self.fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        return max([0, *(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def _entry(self, version: int) -> dict:
        return json.loads(self.spark.read.text(self._version_path(version), wholetext=True).first()[0])

    def manifest(self, version: int | None = None) -> dict:
        """Schema and all shards of a version: the last snapshot before it and the changes since."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        entries = [self._entry(version)]
        while not entries[-1]["snapshot"]:
            entries.append(self._entry(entries[-1]["version"] - 1))
        shards: dict[str, Shard] = {}
        for entry in reversed(entries):
            for path in entry["dropped"]:
                del shards[path]
            shards |= {s["path"]: Shard(**s) for s in entry["added"]}
        return {"version": version, "schema": entries[0]["schema"], "shards": list(shards.values())}

    def shards(self, version: int | None = None) -> list[Shard]:
        return self.manifest(version)["shards"]

    def _commit(self, version: int, schema: str, added: list[Shard], dropped: list[Shard] = ()) -> int:
        """Write version ``version`` aside, then rename it; raises Conflict if it exists."""
        snapshot = version % SNAPSHOT == 1
        if snapshot:
            gone = {s.path for s in dropped}
            added, dropped = [*(s for s in self.shards(version - 1) if s.path not in gone), *added], ()
        text = json.dumps({"version": version, "schema": schema, "snapshot": snapshot, "added": [asdict(s) for s in added], "dropped": [s.path for s in dropped]})
        aside = self._path(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(self._path(self._version_path(version))), options)
        except Exception as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _files(self, where: str) -> list[tuple[Shard, float]]:
        """Shards below a folder (rows not counted) and the times of their files, in seconds."""
        found, files = [], self.fs.listFiles(self._path(where), True)
        base = len(self.fs.makeQualified(self._path(self.path)).toString()) + 1
        while files.hasNext():
            status = files.next()
            name = status.getPath().toString()
            if name.endswith(".parquet"):
                found.append((Shard(name[base:], status.getLen()), status.getModificationTime() / 1000))
        return sorted(found, key=lambda f: f[0].path)

    def _write(self, df: DataFrame, version: int) -> list[Shard]:
        where = f"{self.path}/data/v{version:08d}-{uuid.uuid4().hex[:8]}"
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(where)
        shards = [s for s, _ in self._files(where)]
        if not shards:
            return []
        # rows of each shard, from the footers
        written = self.spark.read.schema(df.schema).parquet(*(f"{self.path}/{s.path}" for s in shards))
        counts = dict(map(tuple, written.groupBy(F.regexp_extract(F.col("_metadata.file_path"), KEY, 1)).count().collect()))
        return [Shard(s.path, s.size, counts.get(s.key, 0)) for s in shards if counts.get(s.key, 0)]

    def append(self, df: DataFrame) -> int:
        """Add an arrival: its partitions become small shards."""
        schema, version = df.schema.json(), self.version() + 1
        fresh = self._write(df, version)
        while True:
            try:
                return self._commit(version, schema, fresh)
            except Conflict:  # an append goes with any other change: try the next version
                version = self.version() + 1

    def _read(self, schema: str, shards: list[Shard]) -> DataFrame:
        from pyspark.sql.types import StructType

        struct = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).parquet(*(f"{self.path}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found["version"]:
            raise FileNotFoundError(f"{self.path} has no committed version")
        return self._read(found["schema"], found["shards"])

    def compact(self, target: int = TARGET, fan_in: int = FAN_IN) -> int:
        """Merge tier by tier and commit after each round; obsolete shards stay until ``vacuum``."""
        while True:
            found = self.manifest()
            runs, taken = [], 0
            for run in plan(found["shards"], target, fan_in):
                if taken and taken + len(run) > FILES:
                    break
                runs.append(run)
                taken += len(run)
            if not runs:
                return found["version"]
            old = [s for run in runs for s in run]
            fresh = self._merged(found, runs)
            while True:
                try:
                    self._commit(found["version"] + 1, found["schema"], fresh, old)
                    break
                except Conflict:  # what has been merged holds as long as its shards are still there
                    found = self.manifest()
                    if not {s.path for s in old} <= {s.path for s in found["shards"]}:
                        self._delete(fresh)
                        break

    def _merged(self, found: dict, runs: list[list[Shard]]) -> list[Shard]:
        """New shards, one for each run, with exactly the rows of the old ones."""
        old = [s for run in runs for s in run]
        run_of = self.spark.createDataFrame([(s.key, i) for i, run in enumerate(runs) for s in run], "__file string, __run int")
        rows = self._read(found["schema"], old)
        file = F.regexp_extract(F.col("_metadata.file_path"), KEY, 1)
        rows = rows.select(F.struct(*quoted(rows.columns)).alias("row"), file.alias("__file"), F.col("_metadata.row_index").alias("__at"))
        rows = rows.join(F.broadcast(run_of), "__file")
        rows = rows.repartitionById(len(runs), F.col("__run")).sortWithinPartitions("__run", "__file", "__at").select("row.*")
        fresh = self._write(rows, found["version"] + 1)
        if (before := sum(s.rows for s in old)) != (after := sum(s.rows for s in fresh)):
            self._delete(fresh)
            raise RuntimeError(f"{before} rows were read and {after} written: nothing is committed")
        return fresh

    def _delete(self, shards: list[Shard]) -> None:
        for shard in shards:
            self.fs.delete(self._path(f"{self.path}/{shard.path}"), False)

    def vacuum(self, age: float = 86_400) -> None:
        """Delete shards that the newest version does not name and that are older than ``age`` seconds: younger ones may belong
        to a writer that has not committed yet (and no reader may still use an older version)."""
        named, now = {s.path for s in self.shards()}, time.time()
        self._delete([shard for shard, at in self._files(f"{self.path}/data") if shard.path not in named and now - at >= age])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends all documents in four arrivals, compacts, and returns what the newest version holds: each document's id, size and
    the hash of its text, and whether its shard is within the target size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, new_path(spark, "shards"))
    for arrival in range(4):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == arrival))
    store.compact()
    store.vacuum(age=0)  # nobody else knows this store
    text = F.coalesce("text", F.lit(""))
    size = F.col("_metadata.file_size")
    return store.read().select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("text_md5"), (size <= TARGET).alias("within_target"))


def sql(table: str = "documents") -> str:
    """What the newest version has to hold, in DuckDB's SQL."""
    return f"SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS text_md5, TRUE AS within_target FROM {table}"
