"""Connected components by alternating star contractions; all state is in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lossweave.llm.tables import pin


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _distinct(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    up = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(up.union(least.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge list (u, v); root is the component's smallest node."""
    now = pin(_distinct(edges.select("u", "v")), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        now = pin(_small_star(_large_star(now)), "edges")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
