"""Near-duplicate documents by b-bit MinHash.

Each text gives a set of word shingles, its 128 minima, band hashes of the whole minima and a
packed signature of 4 mixed bits of each. Equal sets collapse to one representative.
Representatives that share a band become candidates, first against two pivots of the bucket
(one by hash, one that shares most buckets with others);
a collision-corrected estimate from bit counts drops the hopeless ones and the rest are
confirmed on full sets. Members of a bucket that are still in different components after that
are then compared with each other, so that no candidate link between components is missed:
those outside the bucket's largest component against all, if they are ``CROWD`` at most. Larger
crowds, such as pages of one template, which share buckets and never link, are split further by
the rarest shingles of each member: two sets of similarity t share one of the n - ceil(t n) + 1
rarest of either, whatever the counts are taken over, so that this is exact. Pairs are
estimated by longer signatures as well where they meet, and those left are confirmed.

Odd cases: texts without words have empty sets and link with nothing; a text of any length is
read whole; a null doc_id is never linked and is kept; rows that share a doc_id are linked by
their own texts; repeated rows are one document; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import map_arrow, materialize, parts_of, small
from codelode.llm.components import components
from codelode.llm.grams import U64, mix, shingle_set

HASHES, ROWS, BITS = 128, 4, 4
#: An estimate from 128 minima has a deviation of 0.038 at 0.75; five of them are allowed.
MARGIN = 0.19
#: Signatures for the second comparison: 2048 minima of 2 bits, a deviation of 0.0115; 4.5 of them are allowed.
FINE_HASHES, FINE_BITS, FINE_MARGIN = 2048, 2, 0.052
#: Members of a bucket outside its largest component that are compared with all its members: some microseconds a member and bucket.
CROWD = 512


def _functions(n: int, salt: int):
    seeds = mix(np.arange(1 + salt, 2 * n + 1 + salt, dtype=U64) * U64(0x9E3779B97F4A7C15)).astype(np.uint32)
    return (seeds[:n] | np.uint32(1))[:, None], seeds[n:][:, None]


COARSE, FINE = _functions(HASHES, 0), _functions(FINE_HASHES, 1 << 20)


def minima(shingles: np.ndarray, functions=COARSE) -> np.ndarray:
    """The least value of each of the hash functions over a non-empty set; blocks fit the cache."""
    x, (a, b) = (shingles >> U64(32)).astype(np.uint32), functions
    least, block = np.full(len(a), 0xFFFFFFFF, np.uint32), 2048 * HASHES // len(a)
    for at in range(0, len(x), block):
        least = np.minimum(least, (a * x[None, at : at + block] + b).min(axis=1))
    return least


def packed(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """``bits`` planes of a bit for each minimum, as 64-bit words.

    The bits are those of the mixed minimum: whether two values of a*x+b with odd a agree in
    their own low bits depends on the values of x alone, the same for all functions.
    """
    least = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    least = (least ^ (least >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    least = least ^ (least >> np.uint32(16))
    planes = (least[None, :] >> np.arange(bits, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS minima."""
    bands = least.reshape(-1, ROWS).astype(U64)
    key = np.arange(1, len(bands) + 1, dtype=U64)
    for j in range(ROWS):
        key = mix(key * U64(0x100000001B3) + bands[:, j])
    return key.view(np.int64)


def _features(batches):
    for batch in batches:
        n, digest, sigs, bands = [], [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            n.append(len(s))
            if len(s):
                least = minima(s)
                digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(packed(least))
                bands.append(band_keys(least))
            else:
                digest.append(b"")
                sigs.append(np.empty(0, np.int64))
                bands.append(np.empty(0, np.int64))
        lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *x])) for x in (sigs, bands)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *lists], ["doc_id", "tkey", "n", "digest", "sig", "bands"])


def _confirmed(threshold: float):
    percent = round(threshold * 100)

    def confirm(batches):
        sets: OrderedDict = OrderedDict()

        def of(key, text):
            if key not in sets:
                sets[key] = shingle_set(text)
                if len(sets) > 64:
                    sets.popitem(last=False)
            else:
                sets.move_to_end(key)
            return sets[key]

        for batch in batches:
            a, b, ka, kb = (batch.column(c).to_pylist() for c in ("a", "b", "ka", "kb"))
            ta, tb = batch.column("ta"), batch.column("tb")
            good = []
            for i in range(len(a)):
                x, y = of((a[i], ka[i]), ta[i].as_py()), of((b[i], kb[i]), tb[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def _fine(batches):
    for batch in batches:
        sigs = [packed(minima(shingle_set(t.as_py()), FINE), FINE_BITS) for t in batch.column("text")]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sigs)]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *sigs]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), lists], ["id", "tkey", "sig"])


def _shingles(batches):
    """(id, shingle) of whole texts, in batches of bounded size."""
    for batch in batches:
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            s = shingle_set(text.as_py()).view(np.int64)
            for at in range(0, len(s), 1 << 16):
                part = s[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int64)), pa.array(part)], ["id", "shingle"])


#: A pair that shares several bands is made in the first of them only.
ONCE_BAND = "element_at(filter(zip_with(ma, mb, (x, y) -> if(x = y, x, null)), z -> z is not null), 1) = band"
#: One that shares several rare shingles, in the first if that is among the first ``HEAD`` of both.
ONCE_SHINGLE, HEAD = "coalesce(try_element_at(array_intersect(ma, mb), 1), shingle) = shingle", 16


def across(keyed: DataFrame, key: str, nodes: DataFrame, near: Column, once: str) -> DataFrame:
    """(a, b) of the members (key, id, comp, most) of each key that are in different components, and ``near`` by their ``nodes``.

    ``most`` is the key's largest component. Members of it stand on one side only, so that a
    large component costs each outsider one comparison a member and none among themselves.
    ``once`` tells by their ``mark`` under which of its keys a pair is made.
    """
    side = lambda df, x: df.select(key, "most", F.col("id").alias(x), F.col("comp").alias(f"c{x}")).join(nodes.select(F.col("id").alias(x), *(F.col(c).alias(f"{c[0]}{x}") for c in ("n", "sig", "fine", "mark"))), x)
    # an exchange between the parts: the join below deals both sides by the key alone, so that a hot one can be split
    left, right = side(keyed.where("comp <> most"), "a"), side(keyed, "b").drop("most")
    pairs = left.join(right, key).where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("most")) | (F.col("a") < F.col("b"))) & near & F.expr(once))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def estimate(a: str, b: str, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Similarity from two packed signatures: equal slots by bit counts, corrected for chance collisions of 2^-bits."""
    words = hashes // 64
    differ = " + ".join("bit_count(" + " | ".join(f"({a}[{p * words + w}] ^ {b}[{p * words + w}])" for p in range(bits)) + ")" for w in range(words))
    return F.expr(f"(({hashes} - ({differ})) / {hashes}D - {2.0**-bits}D) / {1 - 2.0**-bits}D")


def _rarest(crowd: DataFrame, nodes: DataFrame, texts_of, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(shingle, id, comp, most) of the rarest shingles of each member of ``crowd`` that others have too, and (id, mark) with the first of them.

    The order is by the number of members that have a shingle, then by the shingle. Shingles of
    one member only come first and are left out: they leave less room for others.
    """
    keys = nodes.join(crowd, "id", "left_semi").select(F.col("id").alias("doc_id"), "tkey")
    sets = materialize(map_arrow(texts_of(keys).repartition(parts_of(keys.sparkSession), "doc_id"), _shingles, "id long, shingle long"), "dup-shingles")
    held = sets.groupBy(F.bitwise_not("shingle").alias("ns")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = sets.join(held.select(F.bitwise_not("ns").alias("shingle"), "k"), "shingle")
    own = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("s")).join(nodes.select("id", "n"), "id")
    # places for shared ones: n - ceil(t n) + 1, less the shingles of this member alone
    percent = round(threshold * 100)
    room = F.expr(f"cast(n - (({percent} * n + 99) div 100) + 1 - (n - size(s)) as int)")
    own = materialize(own.where(room > 0).select("id", F.transform(F.slice("s", 1, room), lambda x: x["shingle"]).alias("s")), "dup-rarest")
    kept = materialize(own.select("id", F.explode("s").alias("shingle")).join(crowd, "id"), "dup-rarest")
    by_comp = kept.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = by_comp.groupBy(F.bitwise_not("shingle").alias("ns")).agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.max("k").alias("k"), F.sum("k").alias("all")).where("k < all")
    return kept.join(mixed.select(F.bitwise_not("ns").alias("shingle"), "most"), "shingle"), own.select("id", F.slice("s", 1, HEAD).alias("mark"))


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", threshold: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tkey"))
    feats = materialize(map_arrow(rows, _features, "doc_id long, tkey long, n long, digest binary, sig array<long>, bands array<long>"), "dup-features")
    linkable = feats.where("n > 0 and doc_id is not null")
    reps = linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "tkey", "n", "sig", "bands")).alias("r"))
    reps = materialize(reps.select("digest", "r.*").withColumnRenamed("doc_id", "id"), "dup-reps")

    placed = reps.select("id", F.explode("bands").alias("band"))
    pivots = placed.groupBy(F.bitwise_not("band").alias("nb")).agg(F.count(F.lit(1)).alias("k"), F.min_by("id", F.xxhash64("id", "band")).alias("pivot")).where("k > 1")
    members = materialize(placed.join(pivots.select(F.bitwise_not("nb").alias("band"), "pivot", "k"), "band"), "dup-members")
    # a second pivot: the member that shares buckets with most others, as the original of a group of copies does
    central = members.join(members.groupBy(F.bitwise_not("id").alias("ni")).agg(F.sum("k").alias("score")).select(F.bitwise_not("ni").alias("id"), "score"), "id")
    hubs = central.groupBy(F.bitwise_not("band").alias("nb")).agg(F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("hub"))
    members = materialize(members.join(hubs.select(F.bitwise_not("nb").alias("band"), "hub"), "band"), "dup-members")
    nodes = reps.select("id", "tkey", "n", "sig")
    sized = F.expr(f"100 * least(na, nb) >= {round(threshold * 100)} * greatest(na, nb)")
    likely = estimate("sa", "sb") >= threshold - MARGIN
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("tkey").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))

    def texts_of(keys: DataFrame) -> DataFrame:
        """(doc_id, tkey, text) of the wanted keys, without a shuffle of all texts where the keys are few."""
        wanted = small(materialize(keys.distinct(), "dup-wanted"), 400_000)
        return rows.join(wanted, ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"])

    def confirm(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (a, b, ka, kb) whose full sets are similar enough."""
        wanted = pairs.select(F.col("a").alias("doc_id"), F.col("ka").alias("tkey")).union(pairs.select("b", "kb"))
        texts, full = materialize(texts_of(wanted), "dup-texts"), pairs
        for x in "ab":
            full = full.join(texts.select(F.col("doc_id").alias(x), F.col("tkey").alias(f"k{x}"), F.col("text").alias(f"t{x}")), [x, f"k{x}"])
        return materialize(map_arrow(full.select("a", "b", "ka", "kb", "ta", "tb"), _confirmed(threshold), "a long, b long"), "dup-links")

    against = members.select("id", F.explode(F.array_distinct(F.array("pivot", "hub"))).alias("pivot")).where("id <> pivot")
    first = against.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    first = materialize(first.join(side("a"), "a").join(side("b"), "b").where(sized & likely).select("a", "b", "ka", "kb"), "dup-pairs")
    links = confirm(first)
    roots = components(links)

    near = sized & (estimate("sa", "sb") >= threshold - MARGIN)
    in_comp = members.select("band", "id").join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("comp"))
    by_comp = in_comp.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = by_comp.groupBy(F.bitwise_not("band").alias("nb")).agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.max("k").alias("k"), F.sum("k").alias("all"))
    mixed = mixed.where("k < all").select(F.bitwise_not("nb").alias("band"), "most", (F.col("all") - F.col("k") > CROWD).alias("crowded"))
    rest = materialize(in_comp.join(mixed, "band"), "dup-rest")
    keys = nodes.join(rest.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"), "tkey")
    # dealt by rows, not by bytes, which say little about the work on them
    texts = texts_of(keys).repartition(parts_of(rows.sparkSession), "doc_id")
    fine = materialize(map_arrow(texts, _fine, "id long, tkey long, sig array<long>"), "dup-fine")
    rest_nodes = materialize(nodes.join(fine.withColumnRenamed("sig", "fine"), ["id", "tkey"]), "dup-fine")
    near = near & (estimate("fa", "fb", FINE_HASHES, FINE_BITS) >= threshold - FINE_MARGIN)
    found = [across(rest.where("not crowded"), "band", rest_nodes.join(reps.select("id", F.col("bands").alias("mark")), "id"), near, ONCE_BAND)]
    crowd = materialize(rest.where("crowded").groupBy(F.bitwise_not("id").alias("ni")).agg(F.max("comp").alias("comp")).select(F.bitwise_not("ni").alias("id"), "comp"), "dup-crowd")
    if crowd.limit(1).count():
        rare, heads = _rarest(crowd, nodes, texts_of, threshold)
        found.append(across(rare, "shingle", rest_nodes.join(heads, "id"), near, ONCE_SHINGLE))
    second = reduce(DataFrame.unionByName, found).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    of = lambda x: nodes.select(F.col("id").alias(x), F.col("tkey").alias(f"k{x}"))
    second = materialize(materialize(second, "dup-second").join(of("a"), "a").join(of("b"), "b"), "dup-second")
    if second.limit(1).count():
        roots = components(links.unionByName(confirm(second)))

    classes = reps.join(roots, "id", "left").select(F.hex("digest").alias("dx"), F.coalesce("root", "id").alias("root"))
    out = feats.select("doc_id", "n", F.when(F.col("n") > 0, F.hex("digest")).alias("dx")).join(classes, "dx", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))
