"""Balanced label propagation into shards, with DataFrame operations only.

Documents of equal text are linked, through their group and never pair by pair. They start in
hashed shards. In each round a document proposes the shard where most of its group sits, among
those with room, if more of the group is there than where it stands; proposals are admitted in
group order up to each shard's quota, round after round until none is made; a round works on the
groups that several shards have, and on no others. A last pass makes the counts even: what stands beyond a
shard's quota, documents without a group first, fills the shards below theirs.

Running sums go by buckets of some hundred rows to a few thousand: documents by the hash of their
group, and those of a large group by a hash of their own, into as many buckets as its count asks for.

Odd cases: a null text counts as empty; rows that share a doc_id are rows of their own, and
repeated rows a group of equal texts; null doc_ids are kept; texts of any length are read for
their hash and size only; with fewer documents than shards some shards stay empty; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.llm.common import materialize, nonneg_bits, prefix_sums


#: Rows of a bucket, of groups and within a group.
BUCKET, OWN_BUCKET = 8192, 256
#: Tables of groups set aside that are written as one.
ASIDE = 16


def _of(values: list[int], at: str) -> Column:
    """The value for the shard in column ``at``."""
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col(at) + 1)


def _loads(rows: DataFrame, shards: int) -> list[int]:
    load = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [load.get(s, 0) for s in range(shards)]


def propagate(nodes: DataFrame, shards: int, max_rounds: int = 500, slack: float = 0.1, credits: int = 3) -> DataFrame:
    """``nodes`` (group ``g``, buckets ``b1``, ``b2``, ...) with column ``label`` after quota-bound rounds.

    Each round reads the loads of the shards (one row each) on the driver and writes the
    labels to the shared folder, of the groups in several shards only: a group that has come
    together proposes nothing any more and is set aside. The seats that admitted documents leave are given out in the
    same round, ``credits`` times over. The loop ends when no document proposes: whoever moves
    goes where at least as many of its group sit, so that the sum of squared seats of each group
    grows with every move and the end comes.
    """
    here, aside, fixed = nodes, [], [0] * shards
    for _ in range(max_rounds):
        load = [n + x for n, x in zip(fixed, _loads(here, shards), strict=True)]
        cap = -int(-sum(load) * (1 + slack) // shards)
        room = _of([max(0, cap - n) for n in load], "label")
        seats = here.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
        of_group = Window.partitionBy("g")
        # among labels with as many seats a hash of group and label decides, so that groups spread and no two members swap
        seats = seats.withColumn("turn", F.xxhash64("g", "label"))
        best = F.max(F.when(room > 0, F.struct("n", "turn", "label"))).over(of_group)
        votes = seats.withColumn("best", best).withColumn("labels", F.count(F.lit(1)).over(of_group)).where("labels > 1")
        gain = (F.col("best")["n"] > F.col("n")) | ((F.col("best")["n"] == F.col("n")) & ((F.col("best")["turn"] > F.col("turn")) | (room == 0)))
        want = F.when(gain & (F.col("best")["label"] != F.col("label")), F.col("best")["label"])
        votes = materialize(votes.select(F.hex("g").alias("gx"), "label", want.alias("want"), F.lit(True).alias("apart")), "shard-votes")
        if not votes.where("want is not null").limit(1).count():
            return reduce(DataFrame.unionByName, aside, here)
        # joined by another key than grouped by, so that a hot group can be split
        asked = here.withColumn("gx", F.hex("g")).join(votes, ["gx", "label"], "left").drop("gx")
        asked = materialize(asked, "shard-asked")
        whole = asked.where("apart is null").select(*nodes.columns)
        settled = _loads(whole, shards)
        if any(settled):
            fixed = [n + x for n, x in zip(fixed, settled, strict=True)]
            aside.append(whole)
            if len(aside) == ASIDE:
                aside = [materialize(reduce(DataFrame.unionByName, aside), "shard-aside")]
        moving = materialize(prefix_sums(asked.where("want is not null").drop("apart"), ["want"], ["b1", "b2"], ["g", "doc_id"], F.lit(1), "queue"), "shard-queue")
        gone = [0] * shards
        for _ in range(credits):
            more = _loads(moving.where(F.col("queue") < _of([max(0, cap - n + x) for n, x in zip(load, gone, strict=True)], "want")), shards)
            if more == gone:
                break
            gone = more
        quota = _of([max(0, cap - n + x) for n, x in zip(load, gone, strict=True)], "want")
        moved = moving.withColumn("label", F.when(F.col("queue") < quota, F.col("want")).otherwise(F.col("label")))
        stay = asked.where("apart and want is null").select(*nodes.columns)
        here = materialize(stay.unionByName(moved.select(*nodes.columns)), "shard-labels")
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def bucketed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``g``, ``h``) with ``alone``, 1 without a group, ``b1`` by group and ``b2`` within a large group."""
    bits = min(24, max(12, (nodes.count() // BUCKET).bit_length()))
    sizes = nodes.groupBy(F.hex("g").alias("gx")).agg(F.count(F.lit(1)).alias("members"))
    # joined by another key than grouped by, so that a hot group can be split
    out = nodes.join(sizes, F.col("g") == F.unhex("gx"))
    within = F.pmod(F.col("h"), F.ceil(F.col("members") / OWN_BUCKET).cast("long"))
    return out.withColumn("alone", (F.col("members") == 1).cast("int")).withColumn("b1", nonneg_bits(F.xxhash64("g"), 64 - bits, bits)).withColumn("b2", within.cast("int")).drop("gx", "members", "h")


def shard(docs: DataFrame, shards: int = 24, max_rounds: int = 500) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law 'rows', shard, slot and grown_shard (null: the law isn't 'key')."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    nodes = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("g"),
        F.xxhash64("doc_id", F.lit("shard")).alias("h"),
    )
    nodes = materialize(nodes.select("*", F.pmod("h", F.lit(shards)).cast("int").alias("label")), "shard-nodes")
    labelled = propagate(materialize(bucketed(nodes), "shard-nodes"), shards, max_rounds)
    load = _loads(labelled, shards)
    total = sum(load)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    # what stands beyond its shard's quota, documents without a group last and so first to go, fills the gaps
    kept = [min(load[s], quota[s]) for s in range(shards)]
    over = [sum(load[x] - kept[x] for x in range(s)) for s in range(shards)]
    gaps = [sum(quota[x] - kept[x] for x in range(s)) for s in range(shards)]
    placed = prefix_sums(labelled, ["label"], ["alone", "b1", "b2"], ["g", "doc_id", "size"], F.lit(1), "at")
    placed = placed.withColumn("stays", F.col("at") < _of(kept, "label")).withColumn("spare", _of(over, "label") + F.col("at") - _of(kept, "label"))
    fill = F.greatest(*(F.when(F.col("spare") >= gaps[s], s).otherwise(-1) for s in range(shards) if quota[s] > kept[s]), F.lit(-1), F.lit(-1))
    placed = placed.withColumn("shard", F.when(F.col("stays"), F.col("label")).otherwise(fill).cast("int"))
    slot = F.when(F.col("stays"), F.col("at")).otherwise(_of(kept, "shard") + F.col("spare") - _of(gaps, "shard")).cast("long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
