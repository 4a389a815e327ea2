"""A corpus pipeline: language ID, near-dedup, decontamination, source mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Odd cases, for all stages: extra columns are dropped, whatever their names; an empty table gives
no rows; texts of any length are worked on whole; null langs, sources and n_chars stay as they
are. What null ids and texts and repeated rows come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import decontam, langid, mixing, neardup, sharding
from codelode.llm.common import materialize, small, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those too few of whose n-grams any learnt language knows, go.

    Null and empty texts have no letter. Rows without an id and repeated rows are judged like others.
    """
    return langid.in_known_language(docs.select(*COLUMNS))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; rows that share a doc_id go by their own texts.

    Rows without an id stay, and those without words. Of rows that repeat id and text one stays.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _dedup_by_text(docs)
    found = materialize(neardup.near_duplicates(docs), "stage-dup")
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(small(materialize(gone, "stage-gone"), 400_000), "doc_id", "left_anti").select(*COLUMNS)


def _dedup_by_text(docs: DataFrame) -> DataFrame:
    """The same where ids repeat: every id and text is a document, the least of a group stays, and of rows that repeat both, one."""
    keyed = docs.where("doc_id is not null").withColumn("_t", F.xxhash64("text")).dropDuplicates(["doc_id", "_t"])
    keyed = materialize(keyed.withColumn("_k", F.xxhash64("doc_id", "_t")), "stage-keyed")
    found = neardup.near_duplicates(keyed, doc_id="_k").select(F.col("doc_id").alias("_k"), "component_id")
    least = found.join(keyed.select("_k", "doc_id", "_t"), "_k").groupBy("component_id").agg(F.min(F.struct("doc_id", "_t", "_k")).alias("x"))
    kept = keyed.join(materialize(least.select("x._k"), "stage-kept"), "_k", "left_semi")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a long part of one go; rows that share a doc_id go by their own texts.

    Rows without an id or a text stay; repeated rows go or stay together; an empty benchmark takes nothing.
    """
    keyed = docs.withColumn("_k", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = decontam.contaminated(keyed, table(spark, sf_dir, "benchmark"), doc_id="_k").select(F.col("doc_id").alias("_k")).distinct()
    return keyed.join(small(materialize(found, "stage-leaks"), 400_000), "_k", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of its training positions.

    Documents without words are taken 0 times. A null source is a source of its own, a null id
    an id like others. Rows that repeat id and text are taken as often as all of them together.
    """
    keyed = docs.withColumn("_t", F.xxhash64("text"))
    plan = mixing.mix(docs, keep_key=True).where("taken > 0").groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("positions")).alias("positions"), F.count(F.lit(1)).alias("n"))
    # it grows with the documents: Spark joins it by its bytes, at any size but the smallest by a shuffle
    plan = materialize(plan.withColumnRenamed("doc_id", "_d"), "stage-mix")
    if plan.where("n > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["doc_id", "_t"])
    unique = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("tkey")))
    # rows that share id and text share one list of positions: each is dealt out once
    unique = unique.select(*COLUMNS, F.explode("positions").alias("_p")).orderBy("_p", "doc_id")
    return unique.select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for each row. Null texts count as empty, null ids stay, repeated rows are a group."""
    return sharding.shard(docs)


STAGES = [("language", language), ("dedup", dedup), ("decontaminate", decontaminate), ("mixture", mixture), ("shard", shard)]

#: SQL expresses neither the trained classifier nor the propagation; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each one's intermediate tables stay until ``release`` is called."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
