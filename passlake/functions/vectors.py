"""Column functions on point lists and vectors. Nulls give null; empty lists give null where a value is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(shape: Column) -> Column:
    """array<struct<x, y>> of a flat vector x0, y0, x1, y1, ..."""
    n = F.floor(F.size(shape) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(shape, 2 * i).alias("x"), F.get(shape, 2 * i + 1).alias("y"))
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def affine(pts: Column, matrix: list[list[float]], unit: float) -> Column:
    """Points under a 2 x 3 matrix, then scaled to the unit."""
    (a, b, c), (d, e, f) = matrix
    return F.transform(
        pts,
        lambda p: F.struct(
            ((F.lit(a) * p["x"] + F.lit(b) * p["y"] + F.lit(c)) * unit).alias("x"),
            ((F.lit(d) * p["x"] + F.lit(e) * p["y"] + F.lit(f)) * unit).alias("y"),
        ),
    )


def steps(pts: Column) -> Column:
    """Lengths of the segments between neighbouring points."""
    n = F.size(pts)
    return F.zip_with(
        F.slice(pts, 1, n - 1), F.slice(pts, 2, n - 1), lambda p, q: F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2)
    )


def path_length(pts: Column) -> Column:
    return F.when(F.size(pts) > 1, total(steps(pts))).otherwise(F.lit(0.0))


def bbox(pts: Column) -> Column:
    """min and max of both axes, width, height, aspect (null for zero height), area, perimeter, diagonal and centre of the box."""
    x, y = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    low_x, high_x, low_y, high_y = F.array_min(x), F.array_max(x), F.array_min(y), F.array_max(y)
    return F.struct(
        low_x.alias("min_x"),
        high_x.alias("max_x"),
        low_y.alias("min_y"),
        high_y.alias("max_y"),
        (high_x - low_x).alias("width"),
        (high_y - low_y).alias("height"),
        F.try_divide(high_x - low_x, high_y - low_y).alias("aspect"),
        ((high_x - low_x) * (high_y - low_y)).alias("area"),
        (2 * (high_x - low_x + high_y - low_y)).alias("perimeter"),
        F.hypot(high_x - low_x, high_y - low_y).alias("diagonal"),
        ((low_x + high_x) / 2).alias("center_x"),
        ((low_y + high_y) / 2).alias("center_y"),
    )


def vec_rms(a: Column, b: Column) -> Column:
    """Root mean square of differences; null for different lengths."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(total(squares) / F.size(a)))


def rel_sim(a: Column, b: Column, floor: float = 1e-9) -> Column:
    """1 - |a - b| / max(|a|, |b|, floor) in [0, 1]; null if either is null. A tolerance as floor keeps small values from differing wholly."""
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(floor))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(a - b) / scale))


def seq_sim(a: Column, b: Column) -> Column:
    """Mean of 1 - min(1, |difference|) by position; the shorter list goes on with its last item."""
    n = F.greatest(F.size(a), F.size(b))
    sims = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: 1
        - F.least(
            F.lit(1.0),
            F.abs(F.get(a, F.least(i, F.size(a)) - 1) - F.get(b, F.least(i, F.size(b)) - 1)),
        ),
    )
    return F.when((F.size(a) > 0) & (F.size(b) > 0), total(sims) / n)


def turns(pts: Column) -> Column:
    """Signed turn in degrees at each inner vertex."""
    n = F.size(pts)

    def heading(p: Column, q: Column) -> Column:
        return F.atan2(q["y"] - p["y"], q["x"] - p["x"])

    headings = F.zip_with(F.slice(pts, 1, n - 1), F.slice(pts, 2, n - 1), heading)
    m = n - 1
    raw = F.zip_with(F.slice(headings, 1, m - 1), F.slice(headings, 2, m - 1), lambda a, b: F.degrees(b - a))
    return F.transform(raw, lambda t: F.when(t > 180, t - 360).when(t <= -180, t + 360).otherwise(t))


def roughness(values: Column) -> Column:
    """RMS of second differences over RMS of first differences of a list; null if flat."""

    def diff(v: Column) -> Column:
        return F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda b, a: b - a)

    first = diff(values)
    second = diff(first)
    rms = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v))
    return F.when(F.size(values) > 2, F.try_divide(rms(second), rms(first)))


def fingerprint(values: Column) -> Column:
    """SHA-256 of the values as whole millionths, joined by commas."""
    return F.sha2(F.array_join(F.transform(values, lambda x: F.floor(x * 1_000_000 + 0.5).cast("long").cast("string")), ","), 256)


def flat(pts: Column) -> Column:
    """x0, y0, x1, y1, ... of points."""
    return F.flatten(F.transform(pts, lambda p: F.array(p["x"], p["y"])))


def vector_with_mask(*fields: Column) -> tuple[Column, Column]:
    """Values with 0 for missing ones (null, NaN, infinite), and a mask that is true for those."""
    missing = [f.isNull() | F.isnan(f) | (F.abs(f) == float("inf")) for f in fields]
    return (
        F.array(*[F.when(m, F.lit(0.0)).otherwise(f) for f, m in zip(fields, missing, strict=True)]),
        F.array(*missing),
    )


def lerp(a: Column, b: Column, t: float = 0.5) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)
