"""Linear models at scale: one pass over rows gives sums of products, small matrices are solved in the driver, rows are scored by columns."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Penalties tried, members of an ensemble, seed, shares of a blend by class.
LAMBDAS = (1e-6, 1e-4, 1e-2, 1.0, 100.0)
MEMBERS, SEED = 5, 1729
ALPHA = {"IN_DISTRIBUTION": 0.85, "NEAR_DISTRIBUTION": 0.5, "OUT_OF_DISTRIBUTION": 0.0}


def fit_pca(rows: DataFrame, column: str, most: int = 32, variance: float = 0.99) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (a row each) and shares of variance: the fewest components, at most `most`, that reach the variance.

    The covariance is summed by Spark; it has the square of the vector's length, not of the rows. Each component's largest loading is positive.
    """
    size = rows.select(F.max(F.size(column))).first()[0]
    given = rows.where(F.size(column) == size).select(array_to_vector(column).alias("v"))
    mean = np.array(rows.where(F.size(column) == size).select(*[F.avg(F.get(column, F.lit(k))) for k in range(size)]).first(), float)
    model = PCA(k=min(most, size), inputCol="v", outputCol="p").fit(given)
    share = model.explainedVariance.toArray()
    k = int(np.searchsorted(np.cumsum(share), variance - 1e-12) + 1)
    parts = model.pc.toArray().T[: min(k, len(share))]
    sign = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])
    return mean, parts * sign[:, None], share[: len(parts)]


def sums_of_products(rows: DataFrame, x: list[str], y: list[str], group: str) -> DataFrame:
    """group, place, total: the sums of products of (1, x..., y...) for each group, place by place. Rows with nulls take no part."""
    wide, width = _sums(rows, x, y, group), 1 + len(x) + len(y)
    every = F.array(*[F.col(_place(i, j)) for i in range(width) for j in range(width)])
    return wide.select("group", F.posexplode(every).alias("place", "total"))


def _place(i: int, j: int) -> str:
    return f"s{min(i, j)}_{max(i, j)}"


def _sums(rows: DataFrame, x: list[str], y: list[str], group: str) -> DataFrame:
    """A row for each group: the sums of products s0_0, s0_1, ..., those of one pair once. Aggregates of columns, so a group costs no call of Python and rows move as partial sums."""
    names = [*x, *y]
    given = rows.select(F.col(group).cast("long").alias("group"), *[F.col(c).cast("double").alias(c) for c in names]).dropna()
    terms = [F.lit(1.0), *[F.col(c) for c in names]]
    return given.groupBy("group").agg(*[F.sum(terms[i] * terms[j]).alias(_place(i, j)) for i in range(len(terms)) for j in range(i, len(terms))])


def _matrices(sums: DataFrame, width: int, weights: list[Column]) -> list[np.ndarray]:
    """The matrix of sums over all groups for each weight of groups, in one pass: width x width numbers each. A weight of 0 takes no part."""
    places = [(i, j) for i in range(width) for j in range(i, width)]
    row = sums.agg(*[F.sum(F.when(w != 0, F.col(_place(i, j)) * w)).alias(f"w{k}_{i}_{j}") for k, w in enumerate(weights) for i, j in places]).first()
    return [np.array([[row[f"w{k}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(width)] for i in range(width)]) for k in range(len(weights))]


def solve_ridge(z: np.ndarray, n_x: int, penalty: float) -> np.ndarray:
    """Coefficients (1 + n_x rows, a column for each output) of the penalised least squares, the intercept free."""
    a, b = z[: 1 + n_x, : 1 + n_x], z[: 1 + n_x, 1 + n_x :]
    free = np.eye(1 + n_x) * penalty
    free[0, 0] = 0.0
    return np.linalg.solve(a + free, b)


def squared_error(z: np.ndarray, w: np.ndarray) -> float:
    """Mean squared error of coefficients over the rows behind a matrix of sums."""
    k = len(w)
    a, b, c = z[:k, :k], z[:k, k:], z[k:, k:]
    return float(np.trace(c - 2 * w.T @ b + w.T @ a @ w) / max(z[0, 0], 1.0) / max(1, c.shape[0]))


def fit_ridge(rows: DataFrame, x: list[str], y: list[str], penalty: float) -> np.ndarray:
    """Multi-output ridge of all rows."""
    sums = _sums(rows.withColumn("__one", F.lit(0)), x, y, "__one")
    return solve_ridge(_matrices(sums, 1 + len(x) + len(y), [F.lit(1)])[0], len(x), penalty)


def fit_ensemble(rows: DataFrame, x: list[str], y: list[str], group: str, members: int = MEMBERS, seed: int = SEED) -> tuple[float, list[np.ndarray]]:
    """The penalty with the least error on a fifth of the groups, and the coefficients of members fitted on groups drawn with replacement.

    Sums are formed once for each group; a member weighs a group's sums by the number of times that a hash drew it: the Poisson limit of drawing with
    replacement, which needs no numbering of groups.
    """
    width = 1 + len(x) + len(y)
    held = F.pmod(F.xxhash64(F.lit(seed), "group"), F.lit(5)) == 0
    weights = [F.when(held, 0).otherwise(1), F.when(held, 1).otherwise(0)]
    cdf = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, j + 1))) if j else np.exp(-1.0) for j in range(12)])
    for k in range(members):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "group"), F.lit(1 << 30)) / float(1 << 30)
        weights.append(sum((F.when(u >= float(c), 1).otherwise(0) for c in cdf), F.lit(0)))
    fit, check, *drawn = _matrices(_sums(rows, x, y, group), width, weights)
    errors = {p: squared_error(check, solve_ridge(fit, len(x), p)) for p in LAMBDAS}
    penalty = min(LAMBDAS, key=lambda p: (errors[p], p))
    out = [solve_ridge(z, len(x), penalty) for z in drawn]
    return penalty, out


def _predicted(w: np.ndarray, x: list[str], output: int) -> Column:
    return sum((F.col(c) * float(w[1 + k, output]) for k, c in enumerate(x)), F.lit(float(w[0, output])))


def ood_class(distance: Column, near: Column, far: Column) -> Column:
    return F.when(distance > far, "OUT_OF_DISTRIBUTION").when(distance > near, "NEAR_DISTRIBUTION").otherwise("IN_DISTRIBUTION")


def score_ensemble(rows: DataFrame, x: list[str], members: list[np.ndarray], thresholds: DataFrame, centre: dict[str, tuple[float, float]]) -> DataFrame:
    """rows with predicted (mean of members), disagreement (their standard deviation), distance, ood and reasons.

    The distance is the RMS of standardised inputs; centre: mean and deviation of each. thresholds: one row of near and far. A null input gives no prediction
    and the reason MISSING_INPUT.
    """
    each = F.array(*[_predicted(w, x, 0) for w in members])
    scaled = [(F.col(c) - m) / max(s, 1e-9) for c, (m, s) in centre.items()]
    out = rows.withColumn("__each", each).withColumn("distance", F.sqrt(sum((z * z for z in scaled), F.lit(0.0)) / len(scaled)))
    mean = F.aggregate("__each", F.lit(0.0), lambda a, v: a + v) / len(members)
    out = out.withColumn("predicted", mean)
    spread = F.aggregate(F.transform("__each", lambda v: (v - F.col("predicted")) ** 2), F.lit(0.0), lambda a, v: a + v)
    out = out.withColumn("disagreement", F.sqrt(spread / len(members))).drop("__each").crossJoin(F.broadcast(thresholds))  # one row
    kind = ood_class(F.col("distance"), F.col("near"), F.col("far"))
    reasons = F.array_compact(F.array(F.when(F.col("distance").isNull(), "MISSING_INPUT"), F.when(F.col("distance") > F.col("far"), "OUT_OF_DISTRIBUTION")))
    return out.withColumn("ood", F.when(F.col("distance").isNull(), "OUT_OF_DISTRIBUTION").otherwise(kind)).withColumn("reasons", reasons).drop("near", "far")


def blend(rows: DataFrame, conservative: bool = False) -> DataFrame:
    """rows (baseline, predicted, distance, disagreement, far, ood) with alpha, blended and support.

    alpha is the prediction's share by its class, times 0.45 in the conservative form; without a prediction the baseline stands. support falls
    with the distance, to 0 at `far`, and with the disagreement.
    """
    alpha = F.when(F.col("predicted").isNull(), 0.0)
    for kind, share in ALPHA.items():
        alpha = alpha.when(F.col("ood") == kind, share)
    out = rows.withColumn("alpha", alpha.otherwise(0.0) * (0.45 if conservative else 1.0))
    blended = F.when(F.col("alpha") > 0, F.col("alpha") * F.col("predicted") + (1 - F.col("alpha")) * F.col("baseline")).otherwise(F.col("baseline"))
    near = F.greatest(F.lit(0.0), 1 - F.col("distance") / F.greatest(F.col("far"), F.lit(1e-9)))
    return out.withColumn("blended", blended).withColumn("support", F.coalesce(near / (1 + F.col("disagreement")), F.lit(0.0)))


def quality_gate(metrics: DataFrame) -> DataFrame:
    """The gates of rows of metrics (improvement, fallback, ood_found, rejected) and whether all are passed; a missing one is not."""
    gates = {
        "improvement_ok": F.col("improvement") >= 0.05, "fallback_ok": F.coalesce("fallback", F.lit(0.0)) <= 0.50, "ood_ok": F.col("ood_found") >= 0.75, "rejected_ok": F.col("rejected") <= 0.20,
    }
    out = metrics.select("*", *[F.coalesce(g, F.lit(False)).alias(c) for c, g in gates.items()])
    return out.withColumn("status", F.when(F.col("improvement_ok") & F.col("fallback_ok") & F.col("ood_ok") & F.col("rejected_ok"), "PASS").otherwise("NO_MEANINGFUL_IMPROVEMENT"))
