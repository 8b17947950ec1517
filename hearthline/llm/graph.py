"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import drop_staged, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node with an edge.

    Each round hangs neighbours on the least one, first upwards, then downwards; the edge set
    shrinks to stars in a number of rounds that grows with the logarithm of the longest path.
    A node with very many neighbours only contributes a minimum and one row per edge. Edges
    stay in the shared folder; the driver sees a count and a checksum a round.
    """
    now = stage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = _signature(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        joined = up.join(low, "u")
        # Each node hangs on its least neighbour, and so do its other smaller neighbours.
        down = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        ).distinct()
        after = stage(down, "edges")
        signature = _signature(after)
        drop_staged(now)
        if signature == seen:
            break
        now, seen = after, signature
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
