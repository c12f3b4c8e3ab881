"""Operator 7: near duplicates by MinHash bands, full-set verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.llm.common import BROADCAST_KEYS, Workspace, arrow_map, arrow_rows, small, with_uid
from passlake.llm.components import connected_components

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: 30 bands of 5 minima miss a pair of similarity 0.8 once in 150,000 pairs.
BANDS = 30
ROWS_PER_BAND = 5
SEED = 20_240_717
#: Signatures of pairs at 0.8 agree in 0.8 of 150 minima, with a deviation of 0.033: below this share no set is compared.
LEAST_AGREEMENT = 0.65
#: Members of a band that are compared with as many others at once.
BLOCK_ROWS = 32
#: Shingle hashes of a sketch, the smallest ones: sets up to this size are held whole.
SKETCH = 1024
#: Sketches of larger sets estimate a similarity of 0.8 with a deviation of 0.013 at most.
LEAST_ESTIMATE = 0.74
_CACHE = 100_000
#: Hashes of words that a Python worker has met; later tasks find those of earlier ones.
_SEEN: dict[bytes, int] = {}
_FEATURES = (
    "uid long, doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, signature binary"
)
_FEATURES_ARROW = pa.schema(
    [
        ("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
        ("bands", pa.list_(pa.int64())), ("signature", pa.binary()),
    ]
)
#: Pairs of sets, and sets, that a Python function holds at once.
PAIR_ROWS = 500


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of all words if there are fewer."""
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    hashed = []
    for w in parts:
        h = _SEEN.get(w)
        if h is None:
            if len(_SEEN) >= _CACHE:
                _SEEN.clear()
            h = _SEEN[w] = xxhash.xxh3_64_intdigest(w)
        hashed.append(h)
    h = np.array(hashed, np.uint64)
    n = len(h) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class Hashes:
    """Universal (multiply-shift) hash functions: the upper 32 bits of a * x + b modulo 2**64, a odd."""

    def __init__(self, n: int, seed: int = SEED):
        dice = np.random.Generator(np.random.PCG64(seed))
        self.a = dice.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = dice.integers(0, 1 << 63, n, dtype=np.uint64)

    def minima(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(values), 1024):
            part = values[at : at + 1024]
            np.minimum(out, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)


def features(text: str | None, words: int, hashes: Hashes, bands: int) -> tuple:
    """Set size, 128-bit key of the set, hashed bands and signature (the lower 16 bits of each minimum).

    Bands are hashed from the signature, so equal bands and equal parts of signatures are the same thing.
    """
    values = shingles(text, words)
    if not len(values):
        return 0, None, [], None
    minima = hashes.minima(values).astype(np.uint16)
    keys = [
        xxhash.xxh3_64_intdigest(x.tobytes(), seed=k) - (1 << 63) for k, x in enumerate(minima.reshape(bands, -1))
    ]
    return len(values), xxhash.xxh3_128_digest(values.tobytes()), keys, minima.tobytes()


def _signature_check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose signatures agree in enough places."""
    for batch in batches:
        if len(batch):
            left, right = (
                np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), -1) for c in ("sig_a", "sig_b")
            )
            batch = batch[(left == right).mean(axis=1) >= LEAST_AGREEMENT]
        yield batch[["a", "b"]]


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [np.unique((np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32)) for x in batch["shingles"]]
        found = pd.DataFrame({"n": [len(x) for x in sets], "sketch": [x[:SKETCH].tobytes() for x in sets]})
        yield pd.concat([batch[["node", "signature"]].reset_index(drop=True), found], axis=1)


def _likely(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int) -> bool:
    """Whether two sets may reach the similarity: exactly if the sketches hold both, else by the smallest hashes of their union."""
    if na <= SKETCH and nb <= SKETCH:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= percent * (na + nb - common)
    smallest = np.union1d(a, b)[:SKETCH]
    common = np.intersect1d(np.intersect1d(a, b, assume_unique=True), smallest, assume_unique=True)
    return len(common) >= LEAST_ESTIMATE * len(smallest)


def _block_check(bands: int, percent: int):
    """Pairs of two blocks of a band that lie in different components and may be similar enough.

    A pair is looked at in the first band that its signatures share, and only there.
    """

    def table(values: list[bytes], kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x in batch.itertuples(index=False):
                same = table(x.a["signature"], np.uint16)[:, None, :] == table(x.b["signature"], np.uint16)[None, :, :]
                first = same.reshape(*same.shape[:2], bands, -1).all(axis=3).argmax(axis=2) == x.number
                apart = np.asarray(x.a["label"])[:, None] != np.asarray(x.b["label"])[None, :]
                left, right = ([np.frombuffer(v, np.uint32) for v in y["sketch"]] for y in (x.a, x.b))
                for i, k in zip(*np.nonzero(first & apart & (same.mean(axis=2) >= LEAST_AGREEMENT)), strict=True):
                    if _likely(left[i], right[k], x.a["n"][i], x.b["n"][k], percent):
                        found.append(sorted((x.a["node"][i], x.b["node"][k])))
            yield pd.DataFrame(found, columns=["a", "b"]).astype(np.int64).drop_duplicates()

    return run


def _set_check(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u, v = [], []
            for a, b, own, others in batch[["a", "b", "set_a", "set_b"]].itertuples(index=False):
                base, other = np.frombuffer(own, np.uint64), np.frombuffer(others, np.uint64)
                common = len(np.intersect1d(base, other, assume_unique=True))
                if 100 * common >= percent * (len(base) + len(other) - common):
                    u.append(a)
                    v.append(b)
            yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return run


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    percent: int = SIMILARITY_PERCENT,
    bands: int = BANDS,
    rows_per_band: int = ROWS_PER_BAND,
    work: Workspace | None = None,
) -> DataFrame:
    """One row for each row of docs: uid, doc_id, text_hash, n_shingles, component_id, kept.

    1. Documents with equal shingle sets are one node, so exact copies never form pairs.
    2. Nodes meet in bands. First each band's nodes are compared with its first and its last node, by signature and
       then by full set; components of the links are formed. In bands that still hold several
       components, the nodes outside the largest one are compared with all nodes of other components, in blocks of
       signatures and sketches; pairs that agree are compared by full set. So each pair that shares a band was compared or
       lies in one component, and a group of copies yields links in proportion to its size.
    3. Components come from alternating large-star and small-star rounds.

    component_id is the smallest doc_id of the component and kept is doc_id = component_id. Null and
    empty texts have no shingles and are linked with nothing. Rows are told apart by
    position, so repeated rows join as exact copies (each with its doc_id; all rows
    with the smallest one are kept). A null doc_id never names a component unless all of its are null.
    An empty table gives an empty result; other columns are ignored. work: where intermediate tables go; the result
    reads its tables features and components, the others are deleted.
    """
    work = work or Workspace(spark, "minhash")
    before = [name for name, _ in work.saved]
    hashes_n = bands * rows_per_band

    hashes = Hashes(hashes_n)

    def described(rows: dict[str, list]) -> dict[str, list]:
        found = [features(t, words, hashes, bands) for t in rows["text"]]
        return dict(zip(("n_shingles", "set_key", "bands", "signature"), map(list, zip(*found, strict=True)), strict=True))

    def shingled(rows: dict[str, list]) -> dict[str, list]:
        return {"shingles": [shingles(t, words).tobytes() for t in rows["text"]]}

    run = arrow_map(described, ["text"], _FEATURES_ARROW)
    given = with_uid(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"))
    found = work.save(given.mapInArrow(run, _FEATURES), "features")
    filled = found.where("n_shingles > 0")
    nodes = work.save(
        filled.groupBy("set_key").agg(
            F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.min_by("text_hash", "uid").alias("h"), F.min_by("doc_id", "uid").alias("id")
        ),
        "nodes",
    )
    members = (
        filled.select("uid", "bands")
        .join(nodes.select(F.col("node").alias("uid")), "uid")
        .select(F.col("uid").alias("node"), F.posexplode("bands").alias("number", "band"))
    )
    members = work.save(members, "members")
    crowded = members.groupBy("band").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p <> q")
    members = work.save(members.join(crowded.select("band"), "band"), "crowded")
    wanted = members.select("node").distinct()
    sets = filled.select(F.col("uid").alias("node"), "signature").join(wanted, "node")
    where = nodes.join(wanted, "node").select("node", F.col("id").alias("__id"), F.col("h").alias("__h"))
    where = work.save(where, "wanted")
    text_of = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(small(where, where.count(), BROADCAST_KEYS), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h")))
        .select("node", "text")
    )
    kind = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    hashed = text_of.mapInArrow(arrow_map(shingled, ["text"], kind), "node long, shingles binary").dropDuplicates(["node"])
    sets = work.save(sets.join(hashed, "node"), "candidates")

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that full sets confirm."""
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
        with arrow_rows(spark, PAIR_ROWS):
            return work.save(pairs.join(right, "b").join(left, "a").mapInPandas(_set_check(percent), "u long, v long"), "links")

    # Stars around the first and the last node of each band.
    ends = work.save(crowded.select("band", F.explode(F.array("p", "q")).alias("pivot")), "ends")
    pairs = (
        members.join(ends, "band")
        .where("node <> pivot")
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .distinct()
    )
    sig = sets.select("node", "signature")
    pairs = pairs.join(sig.select(F.col("node").alias("b"), F.col("signature").alias("sig_b")), "b")
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("signature").alias("sig_a")), "a")
    edges = links(work.save(pairs.mapInPandas(_signature_check, "a long, b long"), "alike"))
    labels = work.save(connected_components(work, edges), "labels")

    # The rest: nodes outside a band's largest component against all of the band, block by block.
    state = members.join(labels, "node", "left").select("band", "number", "node", F.coalesce("label", "node").alias("label"))
    state = work.save(state, "state")
    parts = state.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("band").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.max_by("label", "n").alias("main")
    )
    # Two nodes in two components were compared as first and last node.
    open_ = work.save(open_.where("labels > 1 and n > 2").drop("labels"), "open")
    rest = work.save(state.join(open_, "band"), "rest")
    sketch = sets.join(rest.select("node").distinct(), "node").select("node", "signature", "shingles")
    with arrow_rows(spark, PAIR_ROWS):
        sketch = work.save(sketch.mapInPandas(_sketches, "node long, signature binary, n long, sketch binary"), "sketches")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n_band") / BLOCK_ROWS))
    blocks = (
        rest.withColumnRenamed("n", "n_band")
        .join(sketch, "node")
        .groupBy("band", "number", (F.col("label") == F.col("main")).alias("in_main"), block.alias("block"))
        .agg(F.collect_list(F.struct("node", "label", "signature", "n", "sketch")).alias("x"))
        .select("band", "number", "in_main", F.struct(*[F.col(f"x.{c}").alias(c) for c in ("node", "label", "signature", "n", "sketch")]).alias("x"))
    )
    blocks = work.save(blocks, "blocks")
    work.drop("features", "nodes", "candidates", "links", "blocks", *before)
    one = blocks.where(~F.col("in_main")).select("band", "number", F.col("x").alias("a"))
    other = blocks.select("band", F.col("x").alias("b"))
    pairs = one.join(other, "band").select("number", "a", "b")
    pairs = pairs.mapInPandas(_block_check(bands, percent), "a long, b long").distinct()
    with arrow_rows(spark, 64):  # a row has two blocks of sketches, 300 KB at most
        pairs = work.save(pairs, "alike")
    more = links(pairs)
    labels = work.save(connected_components(work, edges.union(more)), "labels")
    named = nodes.join(labels, "node", "left").select(
        "set_key", "least_id", F.coalesce("label", "node").alias("label")
    )
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = work.save(named.join(least, "label").select("set_key", F.col("component_id")), "components")
    work.drop("features", "components", *before)
    out = found.select("uid", "doc_id", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select(
        "uid",
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs whose text leads its component, with all columns.

    Rows are known by doc_id and their text's hash; repeated rows of a leader all stay, and so do rows without words.
    """
    work = Workspace(spark, "minhash")
    verdicts = near_duplicates(spark, docs, work=work).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"))
    gone = work.save(verdicts.where(~F.col("kept")).drop("kept"), "dropped")
    work.drop("dropped")
    gone = small(gone, gone.count(), BROADCAST_KEYS).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__hash"))
    return docs.join(gone, same, "left_anti")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(spark, docs, words=4).drop("uid", "text_hash")


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def components_sql(rows: str, words: int) -> str:
    """CTEs over `rows` (key, text) that end with components (key, n_shingles, least): all pairs that share a shingle are compared."""
    return f"""
cut as (select key, {WORDS.format(LOWER.format("text"))} w from {rows} where text is not null),
sets as (select key, list_distinct(case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) end) g from cut),
each_ as (select key, len(g) n, unnest(g) g from sets),
common as (select a.key a, b.key b, any_value(a.n) na, any_value(b.n) nb, count(*) c from each_ a join each_ b on a.g = b.g and a.key <> b.key group by 1, 2),
links as (select a, b from common where 100 * c >= {SIMILARITY_PERCENT} * (na + nb - c)),
reach as (select key, key other from sets union select reach.key, links.b from reach join links on reach.other = links.a),
components as (select sets.key, len(g) n_shingles, min(other) least from sets join reach on sets.key = reach.key group by all)"""


OP7_SQL = f"""
with recursive given as (select doc_id key, text from documents), {components_sql("given", 4)}
select d.doc_id, coalesce(n_shingles, 0) n_shingles, coalesce(least, d.doc_id) component_id, coalesce(least = d.doc_id, true) kept
from documents d left join components c on c.key = d.doc_id
"""
