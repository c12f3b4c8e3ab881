"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passlake.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node with the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v")))


def connected_components(work: Workspace, edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes that have an edge.

    edges: columns u and v, integers, in any direction; loops and repeats are ignored. Sums are
    formed before rows move, and a hub's rows meet only in joins, which Spark splits when they are
    skewed. Each round is written, so lineage stays short.
    """
    now = work.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(limit):
        sizes = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sizes) == mark or not sizes[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("label"))
            ).distinct()
        mark = tuple(sizes)
        now = work.save(_small_star(_large_star(now).distinct()).distinct(), "stars")
    raise RuntimeError(f"components did not settle in {limit} rounds")
