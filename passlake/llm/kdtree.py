"""Operator 3: exact top-k by inner product over KD-trees, one for each shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlake.llm.common import Workspace, arrow_rows

TOP = 5
SCALE = 256
#: Vectors of a shard, and queries of a block: what a task holds at once.
SHARD_ROWS = 8192
BLOCK_ROWS = 512
LEAF_ROWS = 256
_FOUND = "query_id long, block long, shard long, vec_id long, score long"


class KDTree:
    """Median splits on the widest dimension; each node has the tight bounding box of its vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.argsort(ids, kind="stable")
        self.low, self.high, self.span, self.children = [], [], [], []
        self.vectors = vectors
        self._build(0, len(ids), leaf_rows)
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, start: int, end: int, leaf_rows: int) -> int:
        own = self.vectors[self.order[start:end]]
        node, low, high = len(self.span), own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((start, end))
        self.children.append(None)
        if end - start > leaf_rows and (high > low).any():
            column = own[:, int(np.argmax(high - low))]
            middle = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(column, middle)]
            self.children[node] = (
                self._build(start, start + middle, leaf_rows),
                self._build(start + middle, end, leaf_rows),
            )
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """The k best (score, -id) of each query that reach `least`, its k-th best score so far.

        No inner product in a box is over the sum of the larger of q * low and q * high. Nodes
        are opened in the order of that bound until it is below the k-th best score.
        """
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        out = []
        for q, me, floor, bound in zip(queries, own, least, bounds, strict=True):
            best: list[tuple[int, int]] = []
            todo = [(-bound[0], 0)]
            while todo and -todo[0][0] >= (max(floor, best[0][0]) if len(best) == k else floor):
                node = heapq.heappop(todo)[1]
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(todo, (-bound[child], child))
                    continue
                start, end = self.span[node]
                scores = self.vectors[start:end] @ q
                floor_now = max(floor, best[0][0]) if len(best) == k else floor
                for i in np.nonzero(scores >= floor_now)[0]:
                    if self.ids[start + i] != me:
                        item = (int(scores[i]), -int(self.ids[start + i]))
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
            out.append(best)
        return out


def _unpack(ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(values, np.int64).reshape(len(found), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold all inner products exactly."""
    size = max(1, a.shape[1])
    most = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    return size * most[0] * most[1] < 2**53


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree, plain = None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if at != (row.dim, row.shard):
                    at = (row.dim, row.shard)
                    plain = _unpack(row.ids, row.vectors)
                    tree = KDTree(plain[0], plain[1].astype(np.float64))
                own, queries = _unpack(row.query_ids, row.queries)
                if _exact(queries, plain[1]):
                    queries, search = queries.astype(np.float64), tree
                else:  # large components: the same search in 64-bit integers
                    search = KDTree(*plain)
                least = np.frombuffer(row.least, np.int64)
                found = [
                    (int(me), row.block, row.shard, -i, s)
                    for me, best in zip(own, search.search(queries, own, least, k), strict=True)
                    for s, i in best
                ]
                yield pd.DataFrame(found, columns=["query_id", "block", "shard", "vec_id", "score"]).astype(np.int64)

    return run


def _packed(df: DataFrame, group: str, ids: str, values: str) -> DataFrame:
    """One row for each (dim, group) with its ids and vectors as bytes; a group has a bounded number of rows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        vectors = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        return pd.DataFrame([(*key, pdf["vec_id"].to_numpy(np.int64).tobytes(), vectors.tobytes())])

    return df.groupBy("dim", group).applyInPandas(run, f"dim int, {group} long, {ids} binary, {values} binary")


def top_k(
    spark: SparkSession,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP,
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products over all vectors.

    vectors and queries: vec_id and embedding. A component x becomes floor(scale * x), as double. Vectors
    that are null, empty or hold null or non-finite components take no part, nor does a null vec_id; a query meets
    vectors of its own dimension, without those of its own vec_id. Ties go to smaller vec_ids.
    Scores must fit in 64 bits. Rows of a repeated vec_id are candidates one by one, and a repeated
    query asks with the least of its vectors (the shortest, then by components). Empty tables give an empty result; other columns are ignored.

    Vectors are dealt by hash to shards of about shard_rows rows, and queries to blocks. First each block
    searches one shard; then it searches the others with the k-th best scores found there, so boxes and leaves
    that cannot reach them stay closed. Shards and blocks meet by an equi-join on the shard number:
    every stated query meets every shard, block by block, and nothing grows with the data in a task.
    """
    work = Workspace(spark, "kdtree")

    def ready(df: DataFrame) -> DataFrame:
        x = F.col("embedding")
        bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        return df.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad).select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.size(x).alias("dim"),
            F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
        )

    rows = ready(vectors)
    asked = ready(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v")
    n, q = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // block_rows))
    trees = work.save(_packed(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))), "shard", "ids", "vectors"), "trees")
    packed = work.save(_packed(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "block", "query_ids", "queries"), "blocks")
    lowest = np.iinfo(np.int64).min

    def fresh(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: np.full(len(x) // 8, lowest, np.int64).tobytes())

    first = packed.withColumn("shard", F.pmod(F.col("block"), F.lit(shards))).withColumn(
        "least", F.pandas_udf(fresh, "binary")("query_ids")
    )
    with arrow_rows(spark, 4):  # a row has a whole shard and a block of queries
        found = work.save(_meet(first, trees).mapInPandas(_search(k), _FOUND), "first")

    def kth(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        scores = right.groupby("query_id")["score"].agg(["size", "min"])
        known = scores[scores["size"] >= k]["min"].to_dict() if len(right) else {}
        out = []
        for row in left.itertuples(index=False):
            ids = np.frombuffer(row.query_ids, np.int64)
            out.append((row.dim, row.block, row.query_ids, row.queries, np.array([known.get(int(i), lowest) for i in ids], np.int64).tobytes()))
        return pd.DataFrame(out, columns=["dim", "block", "query_ids", "queries", "least"])

    schema = "dim int, block long, query_ids binary, queries binary, least binary"
    bounded = packed.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(kth, schema)
    bounded = work.save(bounded, "bounded")
    rest = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    rest = rest.where(F.col("shard") != F.pmod(F.col("block"), F.lit(shards)))
    with arrow_rows(spark, 4):
        later = work.save(_meet(rest, trees).mapInPandas(_search(k), _FOUND), "later")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.union(later)
        .withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _meet(blocks: DataFrame, trees: DataFrame) -> DataFrame:
    """By shuffle, whatever the sizes that Spark expects: it knows the file of the blocks, not how often they are repeated, and would gather all copies in the driver to broadcast them."""
    return blocks.hint("merge").join(trees, ["dim", "shard"]).sortWithinPartitions("dim", "shard")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(spark, rows, rows.where(F.col("vec_id") % 50 == 0))


OP3_SQL = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) e from embeddings
    where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= {TOP}
"""
