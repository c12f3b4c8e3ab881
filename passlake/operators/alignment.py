"""Comparison of passes, and of sequences by contiguous runs, monotone paths and interpolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlake.functions.vectors import bbox, lerp, points, rel_sim, vec_rms
from passlake.operators.matching import weighted_score

#: Weights of the comparison of two passes, and of a match in an alignment.
PASS_WEIGHTS = {"rms": 0.25, "chamfer": 0.20, "tangent": 0.15, "curvature": 0.15, "corner": 0.10, "aspect": 0.05, "topology": 0.05, "progress": 0.05}
MATCH_WEIGHTS = {"shape": 0.55, "width": 0.15, "height": 0.15, "bend": 0.10, "progress": 0.05}
GAP_COST = 0.45
_METRICS = "rms double, chamfer double, hausdorff double, tangent double, corner double"


def _metrics(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The metrics of rows of shapes of one length: an array of rows x 5."""
    p, q = a.reshape(len(a), -1, 2), b.reshape(len(b), -1, 2)
    rms = np.sqrt(((p - q) ** 2).sum(axis=(1, 2)) / p.shape[1])
    thin_p, thin_q = p[:, ::4], q[:, ::4]
    far = np.hypot(thin_p[:, :, None, 0] - thin_q[:, None, :, 0], thin_p[:, :, None, 1] - thin_q[:, None, :, 1])
    one, other = far.min(axis=2), far.min(axis=1)
    wrap = lambda x: np.abs((x + np.pi) % (2 * np.pi) - np.pi)
    headings = [np.arctan2(*np.diff(x, axis=1)[..., ::-1].transpose(2, 0, 1)) for x in (p, q)]
    tangent = (1 - wrap(headings[0] - headings[1]) / np.pi).mean(axis=1) if p.shape[1] > 1 else np.full(len(p), np.nan)
    bends = [wrap(np.diff(x, axis=1)) for x in headings]
    n = bends[0].shape[1]
    corner = np.maximum(0, 1 - np.abs(bends[0] - bends[1]).sum(axis=1) / (n * np.pi)) if n else np.full(len(p), np.nan)
    return np.column_stack([rms, np.minimum(1, (one.mean(axis=1) + other.mean(axis=1)) / 2), np.maximum(one.max(axis=1), other.max(axis=1)), tangent, corner])


def _paired(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Distances of two shapes (flat vectors); of the shorter one's number of points where they differ, null without points."""
    sizes = np.array([0 if x is None or y is None else min(len(x), len(y)) // 2 * 2 for x, y in zip(a, b, strict=True)], int)
    out = np.full((len(a), 5), np.nan)
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        left, right = (np.array([np.asarray(x, float)[:n] for x in side.iloc[at]]) for side in (a, b))
        out[at] = _metrics(left, right)
    return pd.DataFrame(out, columns=["rms", "chamfer", "hausdorff", "tangent", "corner"])


def _near_progress() -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(F.col("a_progress") - F.col("b_progress")))


def compare_passes(pairs: DataFrame) -> DataFrame:
    """pairs with score, coverage and hausdorff. pairs: shape, topology and progress of both sides, with the prefixes a_ and b_.

    Eight components; another topology leaves that component out of the mean and its share out of the coverage, as a missing
    aspect or progress does.
    """
    rows = pairs.withColumn("m", F.pandas_udf(_paired, _METRICS)("a_shape", "b_shape"))
    clean = lambda c: F.when(~F.isnan(c), c)
    aspect = rel_sim(bbox(points(F.col("a_shape")))["aspect"], bbox(points(F.col("b_shape")))["aspect"])
    one = F.lit(1.0)
    parts = {
        "rms": F.greatest(F.lit(0.0), 1 - F.col("m.rms")),
        "chamfer": 1 - F.col("m.chamfer"),
        "tangent": clean(F.col("m.tangent")),
        "curvature": clean(F.col("m.corner")),
        "corner": clean(F.col("m.corner")),
        "aspect": aspect,
        "topology": F.when(F.col("a_topology") == F.col("b_topology"), one),
        "progress": F.when(F.col("a_progress").isNotNull() & F.col("b_progress").isNotNull(), _near_progress()),
    }
    score, coverage = weighted_score(parts, PASS_WEIGHTS)
    return rows.select(*pairs.columns, score.alias("score"), coverage.alias("coverage"), F.round("m.hausdorff", 6).alias("hausdorff"))


def _pairs(generated: DataFrame, history: DataFrame, links: DataFrame) -> DataFrame:
    """The passes of linked sequences, side by side."""

    def sided(df: DataFrame, side: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("flower_id", "pass_id", "ord", "shape", "topology", "progress")])

    named = links.select(F.col("flower_id").alias("a_flower_id"), F.col("history_id").alias("b_flower_id")).distinct()
    return sided(generated, "a").join(named, "a_flower_id").join(sided(history, "b"), "b_flower_id")


def pass_top3(generated: DataFrame, history: DataFrame, links: DataFrame, k: int = 3) -> DataFrame:
    """Each generated pass's k most similar passes of the same topology in its history, with support (0 to 100) and band.

    generated, history: flower_id, pass_id, ord, shape, topology, progress; links: flower_id and history_id, the sequences that one is held against.
    """
    scored = compare_passes(_pairs(generated, history, links).where("a_topology = b_topology"))
    factor = F.when(F.col("score") >= 0.9, 1.0).otherwise(0.75)  # direct, generic
    warned = F.when(F.col("coverage") < 1, 0.8).otherwise(1.0)
    support = F.round(100 * F.col("score") * (0.5 + 0.5 * F.col("coverage")) * factor * warned, 6)
    band = F.when(F.col("support") >= 85, "HIGH").when(F.col("support") >= 70, "GOOD").when(F.col("support") >= 50, "LIMITED").otherwise("LOW")
    by_score = Window.partitionBy("a_pass_id").orderBy(F.desc("score"), "b_pass_id")
    ranked = scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).withColumn("support", support)
    return ranked.select(F.col("a_pass_id").alias("pass_id"), F.col("b_pass_id").alias("match_id"), "rank", "score", "coverage", "support", band.alias("band"))


def best_subsequence(generated: DataFrame, history: DataFrame, links: DataFrame, limit: int = 3) -> DataFrame:
    """The best runs of passes that a generated sequence shares with its historical ones, at most `limit` of each.

    Columns as in pass_top3. Every pair of equally long windows counts, from 3 passes on (2 in sequences of fewer). Pairs are scored once;
    the pairs of one diagonal (difference of orders) and start form runs, whose mean, minimum and progress are running windows. Supported are runs with a
    mean of 0.35 and an alignment of 0.40 or more. Sequences are short (28 passes): runs of two grow with the cube of that.
    """
    n = generated.groupBy(F.col("flower_id").alias("a_flower_id")).agg(F.count(F.lit(1)).alias("n"))
    pairs, near = _pairs(generated, history, links), _near_progress()
    scored = compare_passes(pairs).select(
        "a_flower_id", "b_flower_id", (F.col("a_ord") - F.col("b_ord")).alias("diagonal"), F.col("a_ord").alias("i"), F.col("b_ord").alias("j"), "score", near.alias("near")
    )
    key = ["a_flower_id", "b_flower_id", "diagonal"]
    runs = scored.select(*key, F.col("i").alias("start"), F.col("j").alias("other")).join(scored, key).where(F.col("i") >= F.col("start"))
    run = Window.partitionBy(*key, "start").orderBy("i")
    runs = runs.select(
        *key, "start", "other", "i", F.count(F.lit(1)).over(run).alias("length"), F.avg("score").over(run).alias("mean"), F.min("score").over(run).alias("least"), F.avg("near").over(run).alias("near")
    )
    runs = runs.where(F.col("length") == F.col("i") - F.col("start") + 1).join(n, "a_flower_id").where(F.col("length") >= F.when(F.col("n") < 3, 2).otherwise(3))
    alignment = 0.60 * F.col("mean") + 0.15 * F.col("least") + 0.20 * F.col("length") / F.col("n") + 0.05 * F.col("near")
    runs = runs.withColumn("alignment", F.round(alignment, 6)).where((F.col("mean") >= 0.35) & (F.col("alignment") >= 0.40))
    runs = runs.withColumn("mean", F.round("mean", 6))
    order = [F.desc("alignment"), F.desc("length"), F.desc("mean"), F.desc("least"), "b_flower_id", "other", "start"]
    top = runs.withColumn("rank", F.row_number().over(Window.partitionBy("a_flower_id").orderBy(*order))).where(F.col("rank") <= limit)
    return top.select(
        F.col("a_flower_id").alias("flower_id"), F.col("b_flower_id").alias("source_id"), "rank", "start", F.col("other").alias("source_start"), F.col("length"), "alignment", "mean", "least"
    )


def match_costs(pairs: DataFrame) -> DataFrame:
    """pairs with cost: 1 - the weighted likeness of shape, width, height, number of bends and progress."""
    box = {s: bbox(points(F.col(f"{s}_shape"))) for s in "ab"}
    parts = {
        "shape": F.greatest(F.lit(0.0), 1 - vec_rms(F.col("a_shape"), F.col("b_shape"))),
        "width": rel_sim(box["a"]["width"], box["b"]["width"]),
        "height": rel_sim(box["a"]["height"], box["b"]["height"]),
        "bend": rel_sim(F.col("a_bends").cast("double"), F.col("b_bends").cast("double"), 1.0),
        "progress": F.greatest(F.lit(0.0), 1 - F.abs(F.col("a_progress") - F.col("b_progress"))),
    }
    score, _ = weighted_score(parts, MATCH_WEIGHTS)
    return pairs.withColumn("cost", F.round(1 - score, 6))


def _path(cost: np.ndarray, gap: float) -> list[tuple[int, int, float, float]]:
    """(i, j, cost of the pair, cost of the whole) of the matches of the cheapest monotone path; a pass left out costs gap. Ties go to a match."""
    n, m = cost.shape
    best = np.zeros((n + 1, m + 1))
    best[:, 0], best[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = min(best[i - 1, j - 1] + cost[i - 1, j - 1], best[i - 1, j] + gap, best[i, j - 1] + gap)
    out, i, j = [], n, m
    while i and j:
        if best[i, j] >= best[i - 1, j - 1] + cost[i - 1, j - 1] - 1e-12:
            out.append((i - 1, j - 1, float(cost[i - 1, j - 1]), float(best[n, m])))
            i, j = i - 1, j - 1
        elif best[i, j] >= best[i - 1, j] + gap - 1e-12:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align_sequences(costs: DataFrame, gap: float = GAP_COST) -> DataFrame:
    """a_id, b_id, a_ord, b_ord, cost, total: the matches of the cheapest monotone path of each pair of sequences.

    costs: a_id, b_id, a_ord, b_ord and the cost of each pair of passes. Costs come from Spark columns; the path of a pair of sequences (28 passes each at
    most, by contract) is found in one task of its own.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="a_ord", columns="b_ord", values="cost").sort_index(axis=0).sort_index(axis=1)
        found = _path(table.to_numpy(float), gap)
        data = [(*key, int(table.index[i]), int(table.columns[j]), c, t) for i, j, c, t in found]
        return pd.DataFrame(data, columns=["a_id", "b_id", "a_ord", "b_ord", "cost", "total"])

    return costs.select("a_id", "b_id", "a_ord", "b_ord", "cost").groupBy("a_id", "b_id").applyInPandas(run, "a_id long, b_id long, a_ord long, b_ord long, cost double, total double")


def adapt_templates(sequences: DataFrame, targets: DataFrame, least: int = 8, most: int = 28) -> DataFrame:
    """target_id, source_id, station, shape, state, confidence: each source sequence resampled to the target's number of stations.

    sequences: flower_id, ord, shape; targets: target_id, source_id, stations, shape, score, coverage. A station's shape lies between the two passes around its place;
    the last one is the target's. state of the last interpolated shape against the target: PASS to an RMS of 0.05, WARN to 0.15, else MISMATCH;
    confidence is score x coverage, times 0.85 unless PASS. Numbers of stations outside least and most give no rows.
    """
    n = sequences.groupBy("flower_id").agg(F.count(F.lit(1)).alias("n"))
    numbered = Window.partitionBy("flower_id").orderBy("ord")
    rows = sequences.withColumn("k", F.row_number().over(numbered) - 1)
    asked = targets.where(F.col("stations").between(least, most)).join(n.withColumnRenamed("flower_id", "source_id"), "source_id")
    asked = asked.withColumn("station", F.explode(F.sequence(F.lit(0), F.col("stations") - 1)))
    asked = asked.withColumn("at", F.col("station") * (F.col("n") - 1) / (F.col("stations") - 1)).withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    for side in ("low", "high"):
        asked = asked.join(rows.select(F.col("flower_id").alias("source_id"), F.col("k").cast("long").alias(side), F.col("shape").alias(f"{side}_shape")), ["source_id", side])
    asked = asked.withColumn("between", lerp(F.col("low_shape"), F.col("high_shape"), F.col("at") - F.col("low")))
    last = F.col("station") == F.col("stations") - 1
    gap = F.max(F.when(last, vec_rms(F.col("between"), F.col("shape")))).over(Window.partitionBy("target_id", "source_id"))
    out = asked.withColumn("gap", gap)
    state = F.when(F.col("gap") <= 0.05, "PASS").when(F.col("gap") <= 0.15, "WARN").otherwise("MISMATCH")
    sure = F.col("score") * F.col("coverage") * F.when(state == "PASS", 1.0).otherwise(0.85)
    return out.select(
        "target_id", "source_id", F.col("station").cast("long").alias("station"), F.when(last, F.col("shape")).otherwise(F.col("between")).alias("shape"), state.alias("state"),
        F.round(sure, 6).alias("confidence"),
    )
