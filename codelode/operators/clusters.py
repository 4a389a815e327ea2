"""Similarity clusters: pairs over a threshold, connected components, centroids and labels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions.hypervectors import bundle, distance, similarity
from codelode.functions.shipping import ship
from codelode.functions.tables import materialize, numbered
from codelode.functions.text import VECTOR_BYTES, ascii_lower, cut_bytes, split_identifier
from codelode.operators.components import components


def _words(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(column), -1)


def similar_pairs(vectors: DataFrame, widest: int, key="unit_id", vector="vector", block: int = 4096) -> DataFrame:
    """(a, b, dist) of pairs a < b at most ``widest`` bits apart.

    Exact, and so quadratic in the rows: rows are dealt into blocks by hash and each pair of
    blocks is a group of its own that is compared by array arithmetic, so that the work spreads
    evenly and no side is broadcast. A row is copied once for each block. ``near_pairs`` is for
    tables too large for that.
    """
    ship(vectors.sparkSession)
    blocks = max(1, -(-vectors.count() // block))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("blk", o).alias("x"), F.greatest("blk", o).alias("y")))
    cells = rows.select("id", "v", "blk", F.explode(others).alias("cell")).select("id", "v", "blk", "cell.*")
    kind = dict(rows.dtypes)["id"]

    def compare(at, table):
        x, y = (k.as_py() for k in at)
        blk, ids, v = table.column("blk").to_numpy(), table.column("id").combine_chunks(), _words(table.column("v"))
        left, right = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
        own, step = v[right], max(1, (1 << 22) // max(1, len(right) * v.shape[1]))
        found = [np.empty((3, 0), np.int64)]
        for k in range(0, len(left), step):
            apart = np.bitwise_count(v[left[k : k + step], None, :] ^ own[None]).sum(axis=2, dtype=np.int32)
            i, j = np.nonzero(apart <= widest)
            keep = slice(None) if x != y else i + k < j
            found.append(np.stack((left[i + k][keep], right[j][keep], apart[i, j][keep])))
        a, b, d = np.concatenate(found, axis=1)
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "dist": pa.array(d, pa.int32())})

    pairs = cells.groupBy("x", "y").applyInArrow(compare, f"a {kind}, b {kind}, dist int")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist")


def tables_needed(widest: int, size: int, bits: int, miss: float) -> int:
    """Tables of ``bits`` sampled bits so that a pair ``widest`` of ``size`` bits apart shares none of them with probability ``miss`` at most."""
    agree = (1 - widest / size) ** bits
    return 1 if agree >= 1 else math.ceil(math.log(miss) / math.log1p(-agree))


def near_pairs(vectors: DataFrame, widest: int, key="unit_id", vector="vector", bits: int = 16, miss: float = 1e-3, most_tables: int = 512, size: int | None = None) -> DataFrame:
    """As ``similar_pairs``, but of all pairs only those are compared that agree in one of several samples of ``bits`` bits.

    The number of samples follows from ``miss``, the chance to miss a pair as far apart as
    ``widest``; nearer ones are missed less. Where thresholds are so low that it takes more than
    ``most_tables``, unrelated pairs agree almost as often and an error is raised: compare
    exactly there. Rows of equal vectors are linked with the least of them only, not in pairs.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).withColumn("same", F.md5(F.array_join("v", ",")))
    size = size or 64 * len((vectors.select(vector).first() or [[0]])[0])
    n = tables_needed(widest, size, bits, miss)
    if n > most_tables:
        raise ValueError(f"it takes {n} samples of {bits} bits to find pairs {widest} of {size} bits apart; compare exactly")
    places = np.random.default_rng(1).integers(0, size, (n, bits))

    def sampled(v: pa.Array) -> pa.Array:
        on = np.unpackbits(_words(v).view(np.uint8).reshape(len(v), -1), axis=1, bitorder="little")
        keys = (on[:, places].astype(np.int64) << np.arange(bits)).sum(axis=2) + (np.arange(n, dtype=np.int64) << bits)
        return pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * n, keys.ravel())

    first = materialize(rows.groupBy("same").agg(F.min(F.struct("id", "v")).alias("r")), "near-firsts")
    copies = rows.join(first.select(F.col("same").alias("_s"), F.col("r.id").alias("a")), (F.col("same") == F.col("_s"))).where("a <> id").select("a", F.col("id").alias("b"), F.lit(0).alias("dist"))
    reps = first.select("r.*")
    dealt = materialize(reps.select("id", F.explode(F.arrow_udf(sampled, "array<bigint>")("v")).alias("k")), "near-keys")
    met = dealt.select("k", F.col("id").alias("a")).join(dealt.select("k", F.col("id").alias("b")), "k").where("a < b").select("a", "b").distinct()
    sides = met.join(reps.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(reps.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    pairs = sides.select("a", "b", distance("va", "vb").alias("dist")).where(F.col("dist") <= widest)
    return pairs.unionByName(copies)


def connected(nodes: DataFrame, pairs: DataFrame, key="unit_id") -> DataFrame:
    """(key, root): the least id that is reachable over ``pairs`` (a, b), whole numbers."""
    roots = components(pairs.select("a", "b"))
    return nodes.select(key).join(roots.withColumnRenamed("id", key), key, "left").select(key, F.coalesce("root", key).alias("root"))


def number_clusters(labelled: DataFrame, min_size: int = 2, key="unit_id") -> DataFrame:
    """(cluster_id, key, root, size) of components with ``min_size`` members or more, numbered by least id."""
    sizes = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    sizes = numbered(sizes, ["root"], "cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("int"))
    return labelled.join(sizes, "root").select("cluster_id", key, "root", "size")


def unclustered(labelled: DataFrame, min_size: int = 2) -> DataFrame:
    sizes = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("size") < min_size, F.col("size"))), F.lit(0)).alias("unclustered_count"))


def to_centroid(members: DataFrame, vectors: DataFrame, key="unit_id", vector="vector") -> DataFrame:
    """Members with ``distance`` 1 - similarity to their cluster's majority vector."""
    with_vectors = members.join(vectors.select(key, F.col(vector).alias("vector")), key)
    centroids = bundle(with_vectors, "cluster_id").withColumnRenamed("vector", "centroid")
    d = 1.0 - similarity(distance("vector", "centroid"))
    return with_vectors.join(centroids, "cluster_id").select("cluster_id", key, "size", d.alias("distance"))


def labels(members: DataFrame, name="name") -> DataFrame:
    """(cluster_id, label): the three most frequent lower-case parts of the members' names, joined by -."""
    parts = members.select("cluster_id", F.explode_outer(F.transform(split_identifier(F.col(name)), lambda t: cut_bytes(ascii_lower(t), VECTOR_BYTES))).alias("part"))
    counts = parts.groupBy("cluster_id", "part").agg(F.count("part").alias("n"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "part")
    best = counts.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("rank", "part")))), lambda x: x["part"]), "-")
    return best.groupBy("cluster_id").agg(joined.alias("label")).withColumn("label", F.when(F.col("label") == "", "unnamed").otherwise(F.col("label")))
