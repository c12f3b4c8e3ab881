"""Connected components by alternating large-star and small-star joins, over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.folders import shared_folder


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v")))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v, open) of the same components in each batch of rows (part, u, v): one for each of its nodes, to the least node that the batch links it
    with. Rows come in order of their parts, so only the first and the last part of a batch may go on in another one: their links are open.
    """
    for batch in batches:
        u, v = batch.column("u"), batch.column("v")
        if not len(u):
            continue
        names, at = np.unique(np.concatenate([c.to_numpy(zero_copy_only=False) for c in (u, v)]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        least = np.arange(len(names))
        while True:
            both = np.minimum(least[a], least[b])
            now = least.copy()
            for c in (a, b):
                np.minimum.at(now, c, both)
                np.minimum.at(now, least[c], both)
            now = now[now]
            if (now == least).all():
                break
            least = now
        part = batch.column("part").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        open_ = np.zeros(len(names), bool)
        open_[a] = open_[b] = (part == part[0]) | (part == part[-1])
        far = np.flatnonzero(least != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[far], u.type), pa.array(names[least[far]], u.type), pa.array(open_[far])], ["u", "v", "open"])


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of all nodes (id): component is the smallest id reachable over edges (u, v), in any direction.

    Joins are shuffled: files of sorted ids are so small for their rows that Spark would else broadcast millions of them. Ids are numbers or strings; loops and repeated edges are ignored, and a node without edges is its own component. Each round is written and
    read back, so a lost executor costs no recomputation; rounds grow with the logarithm of the longest path.

    Edges may name the `part` of the graph that they lie in, which no link leaves. They are then dealt in its order, a large part over several tasks, and
    each batch of rows is first replaced by stars of what it links; only parts that may lie in several batches need rounds. The result is the same.
    """
    spark: SparkSession = edges.sparkSession
    root = shared_folder(spark, "components")

    def save(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{root}/{k:03d}")
        return spark.read.schema(df.schema).parquet(f"{root}/{k:03d}")

    part = [c for c in edges.columns if c == "part"]
    given = edges.where("u <> v").select(*part, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    settled = None
    if part:
        stars = given.repartitionByRange("part", "u").sortWithinPartitions("part").mapInArrow(_stars, given.select("u", "v", F.lit(True).alias("open")).schema)
        stars = save(stars, rounds + 1)
        settled, given = stars.where("not open").select("u", "v"), stars.where("open")
    now = save(given.select("u", "v").distinct(), 0)
    mark: tuple | None = None
    for k in range(1, rounds + 1):
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark or not state[0]:
            now = now.union(settled) if settled is not None else now
            return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")).hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        mark = state
        now = save(_small_star(_large_star(now).distinct()).distinct(), k)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
