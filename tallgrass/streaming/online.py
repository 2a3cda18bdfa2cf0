"""Online aggregation over a stream: windowed estimates with late data handled by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.session import new_path


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts, sums and spread of ``value`` by event type and window; works on streams and tables alike."""
    frame = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(frame.alias("w"), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "mean", "variance")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a user until a gap."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n", "total")


def windows_of(spark: SparkSession, path: str, files_per_batch: int = 1000, **options) -> DataFrame:
    """All windows of the event files of a path, read as a stream to its present end.

    Each batch writes the windows that it has changed (update mode) as Parquet in the shared folder, under its number, so a batch
    that runs again replaces its own output. The state holds only windows that the watermark has not passed; nothing of the
    result comes to the driver. The newest version of each window is the result, those still open included.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    stream = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)
    out, state = new_path(spark, "windows"), new_path(spark, "windows-state")
    changed = windowed(stream, **options)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changed.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if not _is_folder(spark, out):  # no event at all
        return windowed(spark.createDataFrame([], schema), **options)
    keys, rest = changed.columns[:3], changed.columns[3:]
    versions = spark.read.schema(changed.schema.add("batch", "long")).parquet(out)
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("newest"))
    return newest.select(*keys, "newest.*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(where) and system.getFileStatus(where).isDirectory()
