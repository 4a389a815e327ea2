"""Continuous refresh: new files become units as they arrive, and windowed counts over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.functions.languages import is_supported, language_of
from codelode.operators.extract import extract_units
from codelode.operators.refresh import replace_by_file


def watch_tree(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (file_path, lang, mtime, source) of supported files; the file source sees new files only."""
    files = spark.readStream.option("recursiveFileLookup", True).option("wholetext", True).format("text").load(root)
    path = F.regexp_replace("_metadata.file_path", "^file:/*", "/")
    return files.select(path.alias("file_path"), language_of(path).alias("lang"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("source")).where(is_supported(path))


def upsert_units(table_path: str):
    """A foreachBatch function that replaces the units of each file of a batch in a Parquet table.

    A version folder is written whole and then named in ``_current``, so that a batch that is
    run again after a failure gives the same table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        current = f"{table_path}/_current"
        try:
            before = spark.read.text(current).orderBy("value").first()["value"]
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = None
        fresh = extract_units(batch)
        out = fresh if before is None else replace_by_file(spark.read.parquet(before), fresh, batch.select("file_path"))
        version = f"{table_path}/v{epoch}"
        out.write.mode("overwrite").parquet(version)
        spark.range(1).select(F.lit(version).alias("value")).coalesce(1).write.mode("overwrite").text(current)

    return write


def read_units(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{table_path}/_current").first()["value"])


def start_refresh(spark: SparkSession, root: str, table_path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep a units table up to date; without an interval it takes what is there and stops."""
    writer = watch_tree(spark, root).writeStream.foreachBatch(upsert_units(table_path)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start() if interval else writer.trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts="ts", width="1 day", lateness="2 days", by="event_type", value="value") -> DataFrame:
    """Counts and sums by event-time window; the column may be without a time zone."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", lateness) if events.isStreaming else timed
    return timed.groupBy(F.window("_ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
