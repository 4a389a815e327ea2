"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.tables import materialize


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of each u; the key of the sums differs from that of the join, so that a hub can be split."""
    least = edges.groupBy(F.bitwise_not("u").alias("nu")).agg(F.min("v").alias("m")).select(F.bitwise_not("nu").alias("u"), "m")
    return edges.join(least, "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for each node of ``edges(a, b)`` that isn't the least of its component.

    Rounds are written to the shared folder; the loop ends when a round changes nothing.
    """
    here = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    here, before = materialize(here, "cc"), None
    for _ in range(max_rounds):
        both = here.unionByName(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        here = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        now = here.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return here.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
