"""Operator 12: hard negatives of anchors by integer inner product, with stored angles that close what cannot reach a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlake.llm.common import Workspace, arrow_rows, small

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these hundredths of its positive's score.
LEAST_PERCENT, MOST_PERCENT = 80, 100
#: Rows of a shard, anchors of a block, anchors that are held against a shard at once.
SHARD_ROWS, BLOCK_ROWS, GROUP_ROWS = 4096, 512, 32
#: Reference directions, and the rows (of least hash) that they are chosen from; any directions give the same result.
REFERENCES, SAMPLE_ROWS = 8, 2000
#: Vector lengths, the most frequent ones, whose directions come from the data; axes serve others.
SAMPLED_DIMS = 16
#: More than any score; shards of a slot, to which blocks are dealt.
ANY, SLOT_SHARDS = 2**63 - 1, 64
#: Room for rounding: of stored angles (32 bits), and of scores as a part of the product of norms.
ANGLE_ROOM, SCORE_ROOM = 4e-6, 1e-6
#: A packed part: its rows as bytes, and the ranges of their norms and angles.
_PART = "width int, ids binary, labels binary, vectors binary, norms binary, angles binary, least_norm double, most_norm double, least_angles array<float>, most_angles array<float>"
_BYTES = ["width", "ids", "labels", "vectors", "norms", "angles"]


def _directions(rows: DataFrame, references: int, sample: int) -> dict[int, np.ndarray]:
    """Unit vectors for each dimension, far from each other, among a bounded sample of rows of its size."""
    dims = [r.dim for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(SAMPLED_DIMS).collect()]
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v")
    taken = rows.where(F.col("dim").isin(dims)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("dim", "v").toPandas()
    return {int(dim): _far_apart(np.stack(list(own["v"])).astype(np.float64), references) for dim, own in taken.groupby("dim")}


def _directions_of(dim: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """The known directions of a dimension; axes for one that was not sampled."""
    return known[dim] if dim in known else np.eye(min(dim, REFERENCES), dim)


def _far_apart(x: np.ndarray, references: int) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    if not (norm > 0).any():
        return np.eye(1, x.shape[1])
    x = x[norm > 0] / norm[norm > 0, None]
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(references, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _angles(vectors: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the directions; a zero vector stands at a right angle, which its norm makes harmless."""
    x = vectors.astype(np.float64)
    norms = np.linalg.norm(x, axis=1)
    cosine = (x @ directions.T) / np.where(norms > 0, norms, 1.0)[:, None]
    return norms, np.arccos(np.clip(cosine, -1.0, 1.0)).astype(np.float32)


class Part:
    """Rows of a shard or block: ids, labels, integer vectors, norms and angles."""

    def __init__(self, row: object, prefix: str = ""):
        of = lambda name, kind: np.frombuffer(getattr(row, prefix + name), kind)
        whole = np.dtype(f"i{getattr(row, prefix + 'width')}")
        self.ids, self.labels, self.norms = of("ids", np.int64), of("labels", np.int64), of("norms", np.float64)
        self.vectors, self.angles = (of(c, kind).reshape(len(self.ids), -1) for c, kind in (("vectors", whole), ("angles", np.float32)))


def score_bounds(norms: np.ndarray, angles: np.ndarray, other_norms: np.ndarray, other_angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each pair can have: the angle of two vectors lies between the difference
    and the sum (or its complement to a full turn) of their angles to any direction."""
    low = np.zeros((len(norms), len(other_norms)), np.float32)
    high = np.full_like(low, np.pi)
    for r in range(angles.shape[1]):
        a, b = angles[:, r : r + 1], other_angles[:, r][None, :]
        np.maximum(low, np.abs(a - b), out=low)
        total = a + b
        np.minimum(high, np.minimum(total, np.float32(2 * np.pi) - total), out=high)
    size = norms[:, None] * other_norms[None, :]
    room = SCORE_ROOM * size + 1
    most = size * np.cos(np.clip(low.astype(np.float64) - ANGLE_ROOM, 0, np.pi)) + room
    least = size * np.cos(np.clip(high.astype(np.float64) + ANGLE_ROOM, 0, np.pi)) - room
    return least, most


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: as doubles where these hold all sums, else in 64 bits."""
    size = max(1, a.shape[1]) * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if size < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(old: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of old and new ones; the latter are sorted so."""
    return sorted([*old, *zip(scores[:k].tolist(), ids[:k].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]


class Search:
    """The k best rows in each window of each anchor of a block, over the shards that a task gets one after the other.

    A window (low, high) holds whole scores; low rises to the k-th best score found.
    """

    def __init__(self, anchors: Part, windows: list[list[tuple[int, int]]], same_label: bool, k: int):
        self.anchors, self.windows, self.same_label, self.k = anchors, windows, same_label, k
        self.best: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _open(self, i: int) -> list[tuple[int, int]]:
        """An anchor's windows as they stand."""
        found = [self.best.get((i, n), ()) for n in range(len(self.windows[i]))]
        return [(max(low, f[-1][0]) if len(f) == self.k else low, high) for (low, high), f in zip(self.windows[i], found, strict=True)]

    def add(self, shard: Part) -> None:
        a = self.anchors
        for start in range(0, len(a.ids), GROUP_ROWS):
            some = np.arange(start, min(start + GROUP_ROWS, len(a.ids)))
            least, most = score_bounds(a.norms[some], a.angles[some], shard.norms, shard.angles)
            reached = np.zeros(least.shape, bool)
            for j, i in enumerate(some.tolist()):
                for low, high in self._open(i):
                    reached[j] |= (most[j] >= low) & (least[j] <= high)
            reached &= (shard.labels[None, :] == a.labels[some][:, None]) == self.same_label
            reached &= shard.ids[None, :] != a.ids[some][:, None]
            rows = np.nonzero(reached.any(axis=0))[0]
            if len(rows):
                scores = _scores(a.vectors[some], shard.vectors[rows])
                for j, i in enumerate(some.tolist()):
                    self._take(i, scores[j], reached[j, rows], shard.ids[rows])

    def _take(self, i: int, scores: np.ndarray, reached: np.ndarray, ids: np.ndarray) -> None:
        windows = self._open(i)
        if not windows:
            return
        ok = np.nonzero(reached & (scores >= min(w[0] for w in windows)) & (scores <= max(w[1] for w in windows)))[0]
        ok = ok[np.lexsort((ids[ok], -scores[ok]))]
        falling, ids = -scores[ok], ids[ok]
        for n, (low, high) in enumerate(windows):
            first = int(np.searchsorted(falling, -high, side="left"))
            end = min(first + self.k, int(np.searchsorted(falling, -low, side="right")))
            if end > first:
                both = [*self.best.get((i, n), []), *zip((-falling[first:end]).tolist(), ids[first:end].tolist(), strict=True)]
                self.best[i, n] = sorted(both, key=lambda x: (-x[0], x[1]))[: self.k]

    def rows(self) -> pd.DataFrame:
        names = self.anchors.ids.tolist()
        found = [(names[i], n, v, s) for (i, n), best in self.best.items() for s, v in best]
        return pd.DataFrame(found, columns=["anchor_id", "window", "vec_id", "score"]).astype(np.int64)


_FOUND = "anchor_id long, window long, vec_id long, score long"


def _search(same_label: bool, k: int):
    """mapInPandas over pairs of a block and a shard, in the order of blocks; a block's finds leave with its last shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, search = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if at != row.block:
                    if search:
                        yield search.rows()
                    ends = [np.frombuffer(x, np.int64).tolist() for x in (row.a_counts, row.a_lows, row.a_highs)]
                    spans, begin = [], 0
                    for n in ends[0]:
                        spans.append(list(zip(ends[1][begin : begin + n], ends[2][begin : begin + n], strict=True)))
                        begin += n
                    at, search = row.block, Search(Part(row, "a_"), spans, same_label, k)
                search.add(Part(row))
        if search:
            yield search.rows()

    return run


def _ready(df: DataFrame, scale: int) -> DataFrame:
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    named = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad)
    return named.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size(x).alias("dim"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
    )


def _angled(known: dict[int, np.ndarray]):
    """mapInPandas: each row's norm, its angles as bytes, and the number of its nearest direction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                norms, angles = _angles(np.stack(rows["v"].to_numpy()), _directions_of(int(dim), known))
                yield rows.assign(norm=norms, angles=[x.tobytes() for x in angles], near=angles.argmin(axis=1))

    return run


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row with the bytes of a bounded number of rows, and the ranges of their norms and angles."""
    rows = rows.sort_values(["vec_id", "norm"], kind="stable")
    vectors, norms = np.stack(rows["v"].to_numpy()).astype(np.int64), rows["norm"].to_numpy(np.float64)
    angles = np.stack([np.frombuffer(x, np.float32) for x in rows["angles"]])
    width = next(w for w in (2, 4, 8) if vectors.min() >= -(2 ** (8 * w - 1)) and vectors.max() < 2 ** (8 * w - 1))
    parts = [rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), vectors.astype(f"i{width}"), norms, angles]
    ranges = [float(norms.min()), float(norms.max()), angles.min(axis=0), angles.max(axis=0)]
    return pd.DataFrame([(*key, width, *[x.tobytes() for x in parts], *ranges)])


def _pack_anchors(least: int, most: int):
    """_pack, with the windows of the rows: hundredths of their `positives`, or one that holds all scores where there are none."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "norm"], kind="stable")
        windows = [[(-(-least * int(s) // 100), most * int(s) // 100) for s in p] if p is not None else [(-ANY, ANY)] for p in rows["positives"]]
        ends = [np.array([len(w) for w in windows], np.int64), *[np.clip([w[side] for own in windows for w in own], -ANY, ANY).astype(np.int64) for side in (0, 1)]]
        out = _pack(key, rows)
        return pd.DataFrame([(*out.iloc[0], *[x.tobytes() for x in ends], float(ends[1].min(initial=ANY)))])

    return run


def _packed(work: Workspace, df: DataFrame, keys: list[str], rows: int, name: str, pack=_pack, more: str = "") -> DataFrame:
    """Saved parts of about `rows` rows each, numbered. A key's rows are dealt over its parts by hash."""
    load = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    dealt = df.join(small(load, load.count()), keys).withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).drop("parts")
    types, keys = dict(dealt.dtypes), [*keys, "sub"]
    packed = dealt.groupBy(*keys).applyInPandas(pack, ", ".join([f"{k} {types[k]}" for k in keys] + [_PART]) + more)
    return work.save(packed.drop("sub").withColumn(name, F.monotonically_increasing_id()), f"{name}s")


_WINDOWS = ", counts binary, lows binary, highs binary, least_score double"


def _can_meet() -> Column:
    """Whether a block (a_) and a shard can hold a pair with the least score that the block asks for, by their ranges of angles and norms."""
    apart = F.zip_with(
        F.zip_with("a_least_angles", "most_angles", lambda a, b: a - b), F.zip_with("least_angles", "a_most_angles", lambda a, b: a - b), lambda a, b: F.greatest(a, b)
    )
    cosine = F.cos(F.greatest(F.lit(0.0), F.array_max(apart).cast("double") - 2 * ANGLE_ROOM))
    size = F.when(cosine > 0, F.col("most_norm") * F.col("a_most_norm")).otherwise(F.col("least_norm") * F.col("a_least_norm"))
    return size * cosine + SCORE_ROOM * F.col("most_norm") * F.col("a_most_norm") + 1 >= F.col("a_least_score")


def block_pairs(blocks: DataFrame, shards: DataFrame, n_shards: int, keys: list[str]) -> DataFrame:
    """block, shard: the numbers of those that can meet. Blocks go to each slot of shards, so no task lists them all."""
    slots = -(-n_shards // SLOT_SHARDS)
    ranges = ["least_norm", "most_norm", "least_angles", "most_angles"]
    left = blocks.select(*keys, "block", *[F.col(c).alias(f"a_{c}") for c in (*ranges, "least_score")], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    right = shards.select(*keys, "shard", *ranges, F.pmod(F.xxhash64("shard"), F.lit(slots)).cast("int").alias("slot"))
    return left.join(right, [*keys, "slot"]).where(_can_meet()).select("block", "shard")


def _found(work: Workspace, spark: SparkSession, blocks: DataFrame, shards: DataFrame, pairs: DataFrame, same_label: bool, k: int, name: str) -> DataFrame:
    mine = blocks.select("block", *[F.col(c).alias(f"a_{c}") for c in (*_BYTES, "counts", "lows", "highs")])
    met = pairs.join(mine, "block").join(shards.select("shard", *_BYTES), "shard").sortWithinPartitions("block", "shard")
    with arrow_rows(spark, 4):  # a row has a whole shard and a block of anchors
        return work.save(met.mapInPandas(_search(same_label, k), _FOUND), name)


def hard_negatives(
    spark: SparkSession, vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT,
    most_percent: int = MOST_PERCENT, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives the highest rows of other labels in the positive's window.

    vectors and anchors: vec_id, embedding, label. A component x becomes floor(scale * x), as double; the score of a row is its integer inner product with
    the anchor and must fit in 64 bits. Positives are the anchor's highest rows of the same label, negatives those of other labels with
    least_percent * positive <= 100 * score <= most_percent * positive; ties go to smaller vec_ids.

    Rows with a null vec_id or label, and vectors that are null, empty or hold null or non-finite components take no part. An anchor meets rows
    of its own dimension, but none of its own vec_id. Rows of a repeated vec_id are met one by one, so a positive may stand twice, each
    with its negatives; a repeated anchor asks once, with its least (dimension, label, vector). An anchor without positives, or a positive without rows in its window, returns nothing.
    Empty tables give an empty result; other columns are ignored.

    Every row holds its angles to a few directions. The angle of two rows lies between the difference and the sum of their angles to any direction; times
    the norms, with room for rounding, that bounds their score. Only rows whose bounds overlap a window, which rises to the k-th
    score found, are scored in whole numbers. Ranges of angles close whole shards before their bytes travel. Shards hold rows of like labels and the same nearest direction;
    a hot label or direction has more of them. The stated anchors meet all shards in blocks.
    """
    work = Workspace(spark, "negatives")
    rows, asked = _ready(vectors, scale), _ready(anchors, scale)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "label", "v")).alias("x")).select("vec_id", "x.label", "x.dim", "x.v")
    buckets = max(1, -(-rows.count() // shard_rows))
    known = _directions(rows, REFERENCES, SAMPLE_ROWS)
    schema = "vec_id long, label long, dim int, v array<long>, norm double, angles binary, near int"
    bucket = F.pmod(F.xxhash64("label"), F.lit(buckets))
    rows, asked = (work.save(df.mapInPandas(_angled(known), schema).withColumn("bucket", bucket), name) for df, name in ((rows, "rows"), (asked, "anchors")))
    shards = _packed(work, rows, ["dim", "bucket", "near"], shard_rows, "shard")
    n_shards = max(1, shards.count())
    pack = _pack_anchors(least_percent, most_percent)

    alone = asked.withColumn("positives", F.lit(None).cast("array<long>"))
    blocks = _packed(work, alone, ["dim", "bucket"], block_rows, "block", pack, _WINDOWS)
    found = _found(work, spark, blocks, shards, block_pairs(blocks, shards, n_shards, ["dim", "bucket"]), True, positives, "same-label")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("place", place).where(F.col("place") <= positives)
    best = work.save(best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") - 1).cast("long").alias("window")), "positives")

    scores = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("x"))  # `positives` of them
    with_scores = asked.join(scores, "vec_id").select(*asked.columns, F.col("x.positive_score").alias("positives"))
    blocks = _packed(work, with_scores, ["dim", "near"], block_rows, "block", pack, _WINDOWS)
    found = _found(work, spark, blocks, shards, block_pairs(blocks, shards, n_shards, ["dim"]), False, negatives, "other-labels")
    order = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", order.cast("int")).where(F.col("rank") <= negatives)
    out = ranked.select("anchor_id", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(spark, rows, rows.where(F.col("vec_id") % 100 == 0))


OP12_SQL = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) e from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, c.vec_id, a.label = c.label same, cast(list_dot_product(a.e, c.e) as bigint) score from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) place from s where same qualify place <= {POSITIVES}),
r as (select p.anchor_id, p.place, p.vec_id positive_id, p.score positive_score, n.vec_id negative_id, n.score negative_score,
    row_number() over (partition by p.anchor_id, p.place order by n.score desc, n.vec_id) rank
    from p join s n on p.anchor_id = n.anchor_id and not n.same and {LEAST_PERCENT} * p.score <= 100 * n.score and 100 * n.score <= {MOST_PERCENT} * p.score)
select anchor_id, positive_id, cast(rank as integer) rank, negative_id, positive_score, negative_score from r where rank <= {NEGATIVES}
"""
