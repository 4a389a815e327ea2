"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

A source's share is its weight, capped at ``max_repeat`` times its size, the excess reshared
by weight. Its schedule is a density over training time 0..1 that is integrated and inverted:
the n-th word of a source is wanted when the integral reaches n / target. Documents stand in
hash order within a source; exact running sums (see ``prefix_sums``) give each its offset.

Odd cases: a null text has size 0; a null source is a source of its own, last in order; rows
that share a doc_id are rows of their own, repeated rows too; documents of size 0 are taken 0
times; words of texts of any length are counted whole; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.tables import numbered
from codelode.llm.common import WORD, materialize, nonneg_bits, prefix_sums, small

WEIGHTS = (5.0, 2.0, 1.0)
#: Slope of each schedule 1 + slope * (2t - 1): early, level and late sources, repeating.
SLOPES = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeat: int = 3) -> DataFrame:
    """(source, source_size, weight, slope, target): min(cap, level * weight) at the level that uses all words.

    Sources may be many (hosts, say): they are numbered and summed by range, none in one task.
    """
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("rank") % len(xs) + 1).cast("int"))
    sources = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    ranked = numbered(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "rank").drop("_last")
    ranked = ranked.withColumn("weight", pick(weights)).withColumn("slope", pick(slopes)).withColumn("cap", F.col("source_size") * float(max_repeat))
    stepped = numbered(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "rank"], "step")
    # all words, less the caps of the sources that are filled before, over the weights of this one and the rest
    part = stepped.withColumn("_b", F.expr("step div 4096"))
    caps = prefix_sums(part.select("step", "_b", "ratio", "cap", "weight"), [], ["_b"], ["step"], F.col("cap"), "filled")
    found = prefix_sums(caps, [], ["_b"], ["step"], F.col("weight"), "passed")
    totals = stepped.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (F.col("all_size") - F.col("filled")) / (F.col("all_weight") - F.col("passed"))
    fits = found.crossJoin(F.broadcast(totals)).withColumn("level", level).where("level <= ratio")
    chosen = fits.agg(F.min(F.struct("step", "level"))["level"].alias("level"))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return stepped.crossJoin(F.broadcast(chosen)).select("source", "source_size", "weight", "slope", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeat: int = 3, bucket_bits: int = 12, keep_key: bool = False) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken and ``positions``, one training time per (part) copy.

    The result is range-sorted by first position, documents that aren't taken last; ``keep_key``
    adds ``tkey``, the hash of the text, and leaves the rows unsorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # 60 bits of a hash that every engine has
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix"))), 1, 15), 16, 10).cast("long")
    sizes = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), h.alias("h"), F.xxhash64("text").alias("tkey"))
    sizes = materialize(sizes, "mix-sizes")
    targets = small(materialize(source_targets(sizes, weights, slopes, max_repeat).withColumn("sid", F.xxhash64("source", F.isnull("source"))), "mix-targets"))
    rows = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", nonneg_bits(F.col("h"), 60 - bucket_bits, bucket_bits))
    placed = prefix_sums(rows, ["sid"], ["bucket"], ["h", "doc_id", "size"], F.col("size"), "offset")
    demand = F.round("target").cast("long")
    placed = placed.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0).cast("long"))
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least("size", demand - F.col("passes") * F.col("source_size") - F.col("offset"))))
    placed = placed.withColumn("taken", F.col("size") * F.col("passes") + F.col("part"))
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + (F.col("part") > 0).cast("long")).otherwise(0))
    at = lambda k: (k * F.col("source_size") + F.col("offset")) / F.col("target")
    b = 1 - F.col("slope")

    def when(k):
        u = F.least(F.lit(1.0), at(k))
        return F.when(F.col("slope") == 0, u).otherwise((F.sqrt(b * b + 4 * F.col("slope") * u) - b) / (2 * F.col("slope")) + 0.0)

    times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), when)).otherwise(F.array().cast("array<double>"))
    if keep_key:
        return placed.select("doc_id", "tkey", "source", "size", "source_size", "target", "taken", times.alias("positions"))
    out = placed.select("doc_id", "source", "size", "source_size", "target", "taken", times.alias("positions"))
    return out.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")
