"""Written intermediate tables, running sums and numbering that hold at any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Paths of intermediate tables by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return base
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="codelode-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/codelode/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Remove the intermediate tables that this application has written, but for those whose label starts with one of ``keep``.

    To be called once no DataFrame that reads them is needed any more: results are read lazily.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if path.rpartition("/")[2].startswith(keep):
            _written.setdefault(spark.sparkContext.applicationId, []).append(path)
        else:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(rows: DataFrame, part: list[str], buckets: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Exclusive running sum of ``value`` in each ``part``, in the order (buckets, order).

    Two levels: sums by bucket, a running sum over the few bucket rows of a part, and a
    running sum inside each bucket. No task holds more than a bucket, however large its part.
    """
    keys = [*part, *buckets]
    valued = rows.withColumn("_v", value)
    tops = valued.groupBy(*keys).agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*part).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_top"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = valued.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return within.join(tops, keys).withColumn(name, F.col("_top") + F.col("_in")).drop("_v", "_in", "_top")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with 0, 1, 2, ... in the order of the columns ``order``, which name a row uniquely.

    Rows are range-partitioned and written; each partition counts from what the ones before it have.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts_of(spark), *order).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt, "numbered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition
    starts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_i", inside).join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")
