"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.shipping import ship
from codelode.functions.tables import fresh_path, materialize, parts_of, prefix_sums, release, shared_dir

__all__ = ["WORD", "fresh_path", "in_chunks", "map_arrow", "materialize", "nonneg_bits", "parts_of", "prefix_sums", "ready", "release", "shared_dir", "small", "table"]

#: Java pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ready(spark: SparkSession) -> None:
    """Before Python runs on the executors: this package goes there, and Arrow batches are bounded in bytes.

    Ten thousand texts in a batch take tens of MB several times over, in the JVM and in each of
    its Python workers. A bound that the session sets itself stays.
    """
    ship(spark)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow, with this package at hand on the executors."""
    ready(df.sparkSession)
    return df.mapInArrow(function, schema)


def small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Mark a written table of narrow rows for broadcast if its counted size allows it."""
    return F.broadcast(df) if df.count() <= max_rows else df


def nonneg_bits(key: Column, shift: int, bits: int) -> Column:
    """``bits`` bits of a 64-bit hash, from bit ``shift`` on."""
    return F.shiftrightunsigned(key, shift).bitwiseAND((1 << bits) - 1).cast("int")


def in_chunks(items: str, length: str, step: str, spans: str, chunk: int = 256) -> str:
    """SQL of the array that ``step`` gathers over ``items`` from (at, spans), ``at`` being the lengths so far.

    An array that grows by an element at a time is copied as often as it grows, so each chunk
    gathers its own from the sum of the lengths before it.
    """
    return (
        f"element_at(transform(array({items}), z -> flatten(zip_with("
        f"aggregate(sequence(0, greatest(size(z) - 1, 0) div {chunk}), named_struct('at', 0L, 'all', cast(array() as array<bigint>)), (a, c) -> named_struct("
        f"'at', a.at + aggregate(slice(z, cast(c * {chunk} + 1 as int), {chunk}), 0L, (s, x) -> s + {length}), 'all', concat(a.all, array(a.at))), a -> a.all),"
        f" sequence(0, greatest(size(z) - 1, 0) div {chunk}),"
        f" (at, c) -> aggregate(slice(z, cast(c * {chunk} + 1 as int), {chunk}), named_struct('at', at, 'spans', cast(array() as {spans})), {step}, a -> a.spans)))), 1)"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
