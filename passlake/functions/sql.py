"""The library's column functions for SQL: temporary functions with SQL bodies, which the optimizer inlines, and a table function of segments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

POINTS = "array<struct<x: double, y: double>>"
#: name: (parameters, result, body). Nulls give null, as do values that are undefined; later functions use earlier ones.
FUNCTIONS = {
    "pl_points": ("shape array<double>", POINTS, "transform(sequence(0, cast(size(shape) / 2 as int) - 1), i -> named_struct('x', shape[2 * i], 'y', shape[2 * i + 1]))"),
    "pl_affine": (
        f"pts {POINTS}, m array<double>, unit double", POINTS,
        "transform(pts, p -> named_struct('x', (m[0] * p.x + m[1] * p.y + m[2]) * unit, 'y', (m[3] * p.x + m[4] * p.y + m[5]) * unit))",
    ),
    "pl_total": ("v array<double>", "double", "aggregate(v, cast(0 as double), (a, x) -> a + x)"),
    "pl_steps": (
        f"pts {POINTS}", "array<double>",
        "zip_with(slice(pts, 1, greatest(size(pts) - 1, 0)), slice(pts, 2, greatest(size(pts) - 1, 0)), (p, q) -> sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)))",
    ),
    "pl_path_length": (f"pts {POINTS}", "double", "pl_total(pl_steps(pts))"),
    "pl_bbox": (
        f"pts {POINTS}", "struct<min_x: double, max_x: double, min_y: double, max_y: double, width: double, height: double>",
        "named_struct('min_x', array_min(pts.x), 'max_x', array_max(pts.x), 'min_y', array_min(pts.y), 'max_y', array_max(pts.y), "
        "'width', array_max(pts.x) - array_min(pts.x), 'height', array_max(pts.y) - array_min(pts.y))",
    ),
    "pl_chord": (f"pts {POINTS}", "double", "case when size(pts) > 0 then sqrt(pow(pts[size(pts) - 1].x - pts[0].x, 2) + pow(pts[size(pts) - 1].y - pts[0].y, 2)) end"),
    "pl_tortuosity": (f"pts {POINTS}", "double", "try_divide(pl_path_length(pts), pl_chord(pts))"),
    "pl_rel_sim": (
        "a double, b double, least double", "double",
        "case when a is not null and b is not null then greatest(cast(0 as double), 1 - abs(a - b) / greatest(abs(a), abs(b), least)) end",
    ),
    "pl_vec_rms": (
        "a array<double>, b array<double>", "double",
        "case when size(a) = size(b) and size(a) > 0 then sqrt(pl_total(zip_with(a, b, (x, y) -> (x - y) * (x - y))) / size(a)) end",
    ),
    "pl_seq_sim": (
        "a array<double>, b array<double>", "double",
        "case when size(a) > 0 and size(b) > 0 then pl_total(transform(sequence(1, greatest(size(a), size(b))), "
        "i -> 1 - least(cast(1 as double), abs(get(a, least(i, size(a)) - 1) - get(b, least(i, size(b)) - 1))))) / greatest(size(a), size(b)) end",
    ),
    "pl_scale_to_length": (
        f"pts {POINTS}, wanted double", POINTS,
        "case when pl_path_length(pts) > 0 then transform(pts, p -> named_struct('x', pts[0].x + (p.x - pts[0].x) * wanted / pl_path_length(pts), "
        "'y', pts[0].y + (p.y - pts[0].y) * wanted / pl_path_length(pts))) end",
    ),
    "pl_diff": ("v array<double>", "array<double>", "zip_with(slice(v, 2, greatest(size(v) - 1, 0)), slice(v, 1, greatest(size(v) - 1, 0)), (b, a) -> b - a)"),
    "pl_roughness": (
        "v array<double>", "double",
        "case when size(v) > 2 then try_divide(sqrt(pl_total(transform(pl_diff(pl_diff(v)), x -> x * x)) / (size(v) - 2)), sqrt(pl_total(transform(pl_diff(v), x -> x * x)) / (size(v) - 1))) end",
    ),
    "pl_reference_id": ("prefix string, text string", "string", "concat(prefix, '-', substring(sha2(text, 256), 1, 24))"),
}


@udtf(returnType="i int, x0 double, y0 double, x1 double, y1 double, length double")
class Segments:
    """The segments of a path, numbered from 0. A path of under two points has none."""

    def eval(self, pts: list) -> Iterator[tuple]:
        for i, (a, b) in enumerate(zip(pts or (), (pts or ())[1:], strict=False)):
            yield i, a["x"], a["y"], b["x"], b["y"], ((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2) ** 0.5


def register_functions(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session's SQL; returns their names. A repeated call replaces them."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    spark.udtf.register("pl_segments", Segments)
    return [*FUNCTIONS, "pl_segments"]
