"""Operator 4: toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.llm.common import arrow_map

#: Labelled rows, chosen by hash of doc_id, that the model is fitted on: a documented bound.
MAX_TRAIN_ROWS = 20_000
#: Terms are hashed to this many numbers.
HASH_SIZE = 1 << 20
#: Features, documented bounds of what is taken from the labelled sample: terms with the strongest association with the label, and members of pairs of words,
#: among all words of the sample, that stand together with other labels than either would tell.
MAX_TERMS = 4096
MIN_TERM_DOCS = 3
MIN_Z = 4.0
MAX_PAIRS = 512
MIN_PAIR_DOCS = 12
MIN_PAIR_Z = 6.0
FACTORS = 4
STEPS = 600
THRESHOLD = 0.3
#: A word also counts by its first letters, so that inflected forms of a stem share a term.
STEMS = (4, 5, 6)
SEED = 7
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


def term_ids(word: str) -> tuple[int, ...]:
    """Hashed terms of a lower-case word: the word itself and its stems."""
    terms = [f"w{word}"] + [f"{k}{word[:k]}" for k in STEMS if len(word) > k]
    return tuple(zlib.crc32(t.encode()) % HASH_SIZE for t in terms)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_TERMS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.list_(pa.int32())), ("words", pa.list_(pa.int32()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _terms(rows: dict[str, list]) -> dict[str, list]:
    ids = [[term_ids(w) for w in words_of(t)] for t in rows["text"]]
    return {"terms": [sorted({i for x in own for i in x}) for own in ids], "words": [sorted({x[0] for x in own}) for own in ids]}


class FactorizationMachine:
    """Logistic factorization machine over present terms; vectors of terms interact by inner products."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.terms, self.bias, self.weights, self.vectors = terms, bias, weights, vectors
        self.places = {int(t): k for k, t in enumerate(terms)}

    def score(self, present: list[int]) -> float:
        z = self.bias
        if present:
            v = self.vectors[present]
            total = v.sum(axis=0)
            z += self.weights[present].sum() + 0.5 * float(total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(
    terms: np.ndarray, docs: np.ndarray, places: np.ndarray, labels: np.ndarray, factors: int = FACTORS, steps: int = STEPS
) -> FactorizationMachine:
    """Adam on the logistic loss of all rows, with weights and vectors drawn towards 0.

    docs and places: row number and term number of each present term, sorted by row. Without factors it is a linear model.
    """
    n, m = len(labels), len(terms)
    rate = float(np.clip(labels.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    dice = np.random.Generator(np.random.PCG64(SEED))
    theta = [np.array([np.log(rate / (1 - rate))]), np.zeros(m), dice.normal(0, 0.05, (m, factors))]
    if not len(places) or labels.min() == labels.max():
        return FactorizationMachine(terms, float(theta[0][0]), theta[1], theta[2])
    first = [np.zeros_like(x) for x in theta]
    second = [np.zeros_like(x) for x in theta]
    pull = (0.0, 2e-4, 1e-3)

    def by(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        if values.ndim == 1:
            return np.bincount(index, values, size)
        return np.array([np.bincount(index, x, size) for x in values.T]).reshape(-1, size).T

    for step in range(1, steps + 1):
        bias, w, v = theta
        own = v[places]
        total = by(docs, own, n)
        z = bias[0] + by(docs, w[places], n) + 0.5 * ((total**2).sum(axis=1) - by(docs, (own**2).sum(axis=1), n))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        slope = error[docs]
        slopes = [
            np.array([error.sum()]),
            by(places, slope, m) + pull[1] * w,
            by(places, slope[:, None] * (total[docs] - own), m) + pull[2] * v,
        ]
        for x, g, a, b in zip(theta, slopes, first, second, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            x -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(terms, float(theta[0][0]), theta[1], theta[2])


def pair_members(docs: np.ndarray, places: np.ndarray, labels: np.ndarray, m: int, max_pairs: int = MAX_PAIRS) -> np.ndarray:
    """Of m words, those in pairs whose documents have other labels than the two words' own rates add up to: the max_pairs most telling pairs.

    docs and places as in fit. A word is counted beside all words of its documents, one word after the other, so every pair that stands together is looked at
    and memory follows the sample.
    """
    n = len(labels)
    if not len(places):
        return np.empty(0, np.int64)
    first = np.searchsorted(docs, np.arange(n + 1))  # where a document's words begin
    by_word = np.argsort(places, kind="stable")
    holders, start = docs[by_word], np.searchsorted(places[by_word], np.arange(m + 1))
    toxic = labels > 0
    both_of = np.bincount(places, minlength=m)
    rate = np.bincount(places, weights=toxic[docs], minlength=m) / np.maximum(1, both_of)
    p, best = labels.mean(), []
    for a in np.flatnonzero(both_of >= MIN_PAIR_DOCS):
        own = holders[start[a] : start[a + 1]]
        beside = np.concatenate([places[first[d] : first[d + 1]] for d in own])
        both = np.bincount(beside, minlength=m)
        others = np.flatnonzero(both >= MIN_PAIR_DOCS)
        others = others[others > a]
        if not len(others):
            continue
        bad = own[toxic[own]]
        hits = np.bincount(np.concatenate([places[first[d] : first[d + 1]] for d in bad]), minlength=m)[others] if len(bad) else np.zeros(len(others))
        both = both[others]
        wanted = np.clip(rate[a] + rate[others] - p, 0.0, 1.0)
        z = np.abs(hits - both * wanted) / np.sqrt(both * (wanted * (1 - wanted) + 0.01))
        best += [(-float(z[k]), int(a), int(others[k])) for k in np.flatnonzero(z >= MIN_PAIR_Z)]
        if len(best) > 8 * max_pairs:
            best = sorted(best)[:max_pairs]
    return np.unique(np.array([x[1:] for x in sorted(best)[:max_pairs]], np.int64).reshape(-1))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, factors: int = FACTORS, max_terms: int = MAX_TERMS, max_pairs: int = MAX_PAIRS) -> FactorizationMachine:
    """The model of at most max_rows labelled rows outside the held-out quarter.

    Features are the max_terms terms whose label rate deviates most from the mean, in standard errors, and the members of the max_pairs pairs of words that do so together; all
    words of the sample in MIN_PAIR_DOCS of its documents are looked at. To the driver come these terms and words and their places in max_rows rows. Of several texts
    of one doc_id the least is learned from.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    there = known.count()
    if there > max_rows:  # a hash bound first, so that only a little more than max_rows rows are sorted
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(there)) < max_rows + 5 * max_rows**0.5)
    known = known.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, there))), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").where(F.col("text").isNotNull())
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.mapInArrow(arrow_map(_terms, ["text"], _TERMS), "doc_id long, toxic int, terms array<int>, words array<int>").persist()
    try:
        n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        p = positive / n if n else 0.0
        seen, hits = F.col("n"), F.col("hits")
        z = F.abs((hits - seen * p) / F.sqrt(seen * (p * (1 - p) + 1e-9)))
        counts = (
            rows.select("toxic", F.explode("terms").alias("term"))
            .groupBy("term")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
            .where(seen >= MIN_TERM_DOCS)
            .withColumn("z", z)
        )
        marked = {r["term"] for r in counts.where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(max_terms).select("term").collect()}
        words = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAIR_DOCS)
        often = np.sort(words.select("word").toArrow()["word"].to_numpy().astype(np.int64))  # words of max_rows texts
        found = rows.select("doc_id", "toxic", "terms", "words").toArrow()
    finally:
        rows.unpersist()
    found = found.sort_by("doc_id").combine_chunks()
    y = found["toxic"].to_numpy().astype(np.float64)

    def only(column: str, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.list_value_length(found[column]).to_numpy()
        flat, at = pc.list_flatten(found[column]).to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        inside = np.isin(flat, terms)
        return at[inside], np.searchsorted(terms, flat[inside])

    if len(often) and len(y):
        marked.update(int(t) for t in often[pair_members(*only("words", often), y, len(often), max_pairs)])
    terms = np.array(sorted(marked), np.int64)
    return fit(terms, *only("terms", terms), y, factors)


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text, in one pass without a shuffle."""
    seen: dict[str, tuple[int, ...]] = {}

    def scored(rows: dict[str, list]) -> dict[str, list]:
        scores = []
        for text in rows["text"]:
            present: set[int] = set()
            for w in words_of(text):
                places = seen.get(w)
                if places is None:
                    if len(seen) >= _CACHE:
                        seen.clear()
                    places = seen[w] = tuple(model.places[i] for i in term_ids(w) if i in model.places)
                if places:
                    present.update(places)
            scores.append(model.score(sorted(present)))
        return {"score": scores, "predicted": [int(x >= threshold) for x in scores]}

    given = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return given.mapInArrow(arrow_map(scored, ["text"], _SCORES), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts score as the bias alone; a null doc_id is scored and never held out. Repeated rows are
    scored one by one; of repeated labels the highest counts, and labels without a document or value are
    ignored. Without labels, or with one class only, all scores are the (bounded) rate of that class. An empty
    table gives an empty result; other columns are ignored.
    """
    return score(docs, train(spark, docs, labels, max_rows))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return toxicity(spark, read("documents"), read("labels").select("doc_id", "toxic"))
