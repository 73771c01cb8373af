"""Connected components of an edge table by alternating large-star and small-star steps; nothing of it reaches the driver but a checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import spread_join, stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). Each node's least neighbour takes over its neighbours: the larger ones (large), or the smaller ones and itself. A hub's edges aren't dealt to one task."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = spread_join(both, least, "u")
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node that has an edge."""
    edges = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct(), "components")
    last = None
    for _ in range(max_rounds):
        old, half = edges, stage(_star(edges, True), "components")
        edges = stage(_star(half, False), "components")
        unstage(old, half)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components don't settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
