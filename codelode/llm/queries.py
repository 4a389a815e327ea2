"""The thin queries over the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import chat, decontam, langid, media, mixing, neardup, passages, secrets, sharding, warc
from codelode.llm.common import table
from codelode.llm.oracles import ORACLES


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    number = lambda c: F.regexp_extract(c, "^urn:page:(.*)$", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return read.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_size")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        F.when(revisit, number("refers_to")).alias("refers_to"),
    )


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store_texts(table(spark, sf_dir, "documents")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (~langid.in_training("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -7L conv_id, t.turn, t.role, '{control}' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)")
    formatted = chat.format_chats(rows.unionByName(extra))
    read = chat.parse_chats(formatted)
    spoken = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    learnt = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.array_join(F.transform("positions", lambda p: F.floor(p * 1_000_000_000).cast("string")), ",")
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", times.alias("positions_e9"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document is a repository of its own, its source the owner
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"), "n_live", "n_example", "max_owners", "max_repos")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_minhash, op3_chat_format, op4_suffix_passages, op5_media, op6_mixing, op7_decontam, op8_secrets, op9_langid, op10_sharding)}

__all__ = ["ORACLES", "QUERIES"]
