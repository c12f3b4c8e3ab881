"""Shapes in a layout and in comparison: zones, descriptors, boxes, order, roles, variants, model errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlake.functions import vectors as v


def canonical_open(pts: Column) -> Column:
    """Points moved to the start, scaled by path length, in the smaller of both directions; null at zero length."""
    def form(p: Column) -> Column:
        known = F.array(F.struct(p.alias("p"), F.element_at(p, 1).alias("o"), v.path_length(p).alias("n")))  # once a row, not once a point
        scaled = F.transform(
            known,
            lambda k: F.when(
                k["n"] > 0,
                F.transform(
                    k["p"],
                    lambda q: F.struct(
                        F.round((q["x"] - k["o"]["x"]) / k["n"], 6).alias("x"), F.round((q["y"] - k["o"]["y"]) / k["n"], 6).alias("y")
                    ),
                ),
            ),
        )
        return F.element_at(scaled, 1)

    return F.least(form(pts), form(F.reverse(pts)))


def canonical_mirror(pts: Column) -> Column:
    """The least canonical form of the points and of their mirror images in x, in y and in both: eight variants; null at zero length."""

    def mirrored(sx: float, sy: float) -> Column:
        return F.transform(pts, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))

    return F.least(*[canonical_open(mirrored(sx, sy)) for sx in (1.0, -1.0) for sy in (1.0, -1.0)])


def fingerprints(shape: Column) -> Column:
    """physical (the values as they are), shape (canonical form), mirror (least mirror form), combined (all three) and whether the scale is zero."""
    pts = v.points(shape)
    each = {"physical": v.fingerprint(shape), "shape": v.fingerprint(v.flat(canonical_open(pts))), "mirror": v.fingerprint(v.flat(canonical_mirror(pts)))}
    combined = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in each.values()]), 256)
    return F.struct(*[c.alias(k) for k, c in each.items()], combined.alias("combined"), (v.path_length(pts) <= 0).alias("zero_scale"))


def path_features(pts: Column) -> Column:
    """Chord, tortuosity (null for a closed path) and the largest distance from the chord."""
    a, b = F.element_at(pts, 1), F.element_at(pts, -1)
    chord = F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)
    off = F.array_max(F.transform(pts, lambda p: F.abs((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))))
    return F.struct(chord.alias("chord"), F.try_divide(v.path_length(pts), chord).alias("tortuosity"), F.try_divide(off, chord).alias("max_offset"))


def bend_zones(turns: DataFrame, key: str, order: str, turn: str, least: float, gap: float) -> DataFrame:
    """Neighbouring turns of one sign, at most `gap` apart in `order`, as zones with their number, extent and angle."""
    w = Window.partitionBy(key).orderBy(order)
    kept = turns.where(F.abs(turn) >= least)
    apart = (F.col(order) - F.lag(order).over(w) > gap) | (F.signum(turn) != F.lag(F.signum(turn)).over(w))
    marked = kept.withColumn("__new", F.coalesce(apart, F.lit(True)).cast("int"))
    zoned = marked.withColumn("zone", F.sum("__new").over(w) - 1)
    return zoned.groupBy(key, "zone").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("turns"), F.sum(turn).alias("angle"))


def pass_aggregates(bends: DataFrame) -> DataFrame:
    """Of each pass: bends by sign, sum, largest and mean size, deviation, changes of sign in order of bend_id."""
    w = Window.partitionBy("flower_id", "pass").orderBy("bend_id")
    flip = F.col("angle") * F.lag("angle").over(w) < 0
    return bends.withColumn("__flip", flip).groupBy("flower_id", "pass").agg(
        F.count_if(F.col("angle") > 0).alias("up"),
        F.count_if(F.col("angle") < 0).alias("down"),
        F.sum(F.abs("angle")).alias("total_angle"),
        F.max(F.abs("angle")).alias("max_angle"),
        F.stddev_pop("angle").alias("deviation"),
        F.count_if(F.col("__flip")).alias("alternations"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (min_x, max_x, min_y, max_y); null where both have no area."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"]))
    high = F.greatest(zero, F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"]))
    area = [(x["max_x"] - x["min_x"]) * (x["max_y"] - x["min_y"]) for x in (a, b)]
    return F.try_divide(wide * high, area[0] + area[1] - wide * high)


def neighbour_iou(passes: DataFrame) -> DataFrame:
    """Overlap of each pass's box with that of the pass before it."""
    w = Window.partitionBy("flower_id").orderBy("ord")
    rows = passes.withColumn("b", v.bbox(v.points(F.col("shape"))))
    return rows.withColumn("a", F.lag("b").over(w)).where("a is not null").select("flower_id", "ord", iou(F.col("a"), F.col("b")).alias("iou"))


def order_layout(items: DataFrame, key: str, item: str) -> DataFrame:
    """Place of items (x, y) in their layout: from the top where y spreads over 1.5 times as far as x, else from the left; ties by id."""
    spread = items.groupBy(key).agg((F.max("y") - F.min("y") > 1.5 * (F.max("x") - F.min("x"))).alias("vertical"))
    main = F.when(F.col("vertical"), -F.col("y")).otherwise(F.col("x"))
    w = Window.partitionBy(key).orderBy("main", item)
    joined = items.join(spread, key).withColumn("main", main)
    return joined.select(key, item, "vertical", (F.row_number().over(w) - 1).cast("long").alias("place"))


def relative_role(x: Column, y: Column, box: Column, dead: float = 0.1) -> Column:
    """Upper, middle or lower and left, centre or right of a box, with a band of `dead` times its size around its centre."""
    def side(value: Column, low: Column, high: Column, names: tuple[str, str, str]) -> Column:
        off, band = value - (low + high) / 2, dead * (high - low)
        return F.when(off > band, names[2]).when(off < -band, names[0]).otherwise(names[1])

    up = side(y, box["min_y"], box["max_y"], ("LOWER", "MIDDLE", "UPPER"))
    return F.concat_ws("_", up, side(x, box["min_x"], box["max_x"], ("LEFT", "CENTRE", "RIGHT")))


def best_variant(passes: DataFrame) -> DataFrame:
    """Root mean square difference to the pass before it, as it is or mirrored in x; ties prefer it as it is."""
    w = Window.partitionBy("flower_id").orderBy("ord")
    rows = passes.withColumn("before", F.lag("shape").over(w)).where("before is not null")
    mirror = F.transform("shape", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    rows = rows.select("flower_id", "ord", v.vec_rms(F.col("shape"), F.col("before")).alias("plain"), v.vec_rms(mirror, F.col("before")).alias("mirrored"))
    return rows.select("flower_id", "ord", F.least("plain", "mirrored").alias("rms"), (F.round("mirrored", 6) < F.round("plain", 6)).alias("mirror"))


def validate_features(passes: DataFrame) -> DataFrame:
    """Of each sequence: vectors, their lengths, and those with a value that is null or not finite."""
    bad = F.exists("shape", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return passes.groupBy("flower_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("shape")).alias("least_size"), F.max(F.size("shape")).alias("most_size"), F.count_if(bad).alias("bad")
    )


def model_metrics(passes: DataFrame) -> DataFrame:
    """Errors of two predictions of each inner pass, by sequence and in all: the pass before it, and the middle of its neighbours."""
    w = Window.partitionBy("flower_id").orderBy("ord")
    rows = passes.withColumns({"a": F.lag("shape").over(w), "b": F.lead("shape").over(w)}).where("a is not null and b is not null")
    middle = F.zip_with("a", "b", lambda x, y: (x + y) / 2)
    rows = rows.select("flower_id", v.vec_rms(F.col("shape"), F.col("a")).alias("p"), v.vec_rms(F.col("shape"), middle).alias("q"))
    return rows.cube("flower_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("baseline"), F.avg("q").alias("blend"), (1 - F.avg("q") / F.avg("p")).alias("improvement")
    )


def search_usage(usages: DataFrame, role: str | None = None, least_projects: int = 1, stale: bool = False) -> DataFrame:
    """Designs with enough distinct projects among the usages that the filters leave."""
    kept = usages.where(F.lit(role is None) | (F.col("role") == role)).where(F.lit(stale) | (F.col("confirmation") != "stale"))
    return kept.groupBy("design_id").agg(F.count_distinct("project_id").alias("projects"), F.max("confirmed_at").alias("latest")).where(F.col("projects") >= least_projects)
