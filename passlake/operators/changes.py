"""What changes from a pass to the next: whole paths and their bends. Passes: flower_id, pass_id, ord (gapless), shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passlake.functions import paths
from passlake.functions.vectors import bbox, path_length, points

#: Changes of size and mean distance that are told, per cent of length from which an order is doubted; steps of a bend's angle and radius.
LEAST_SIZE, LEAST_DISTANCE, ORDER_PERCENT, ANGLE_STEP, RADIUS_STEP = 0.25, 0.5, 1.0, 1.0, 0.1


def _neighbours(passes: DataFrame, *columns: str) -> DataFrame:
    """Each pass (a) beside the next of its sequence (b), by an equi-join, so that a long sequence is no single task."""
    a = passes.select("flower_id", (F.col("ord") + 1).alias("__at"), F.col("ord"), F.struct(*columns).alias("a"))
    b = passes.select("flower_id", F.col("ord").alias("__at"), F.struct(*columns).alias("b"))
    return a.join(b, ["flower_id", "__at"]).drop("__at")


def path_transitions(passes: DataFrame) -> DataFrame:
    """A row for each pass that has a next one: changes of width, height, length (and in per cent), `path_change`, and classes.

    Classes in order: PROFILE_WIDENED or _NARROWED, PROFILE_HEIGHT_INCREASED or _DECREASED, TOPOLOGY_CHANGE (both have bends, not equally many), POSSIBLE_PASS_ORDER_ERROR (length
    changes by over 1 %), ASYMMETRIC_CHANGE (mean distance over 0.5); NO_SIGNIFICANT_CHANGE where there is none. A shape that is null or too short gives nulls.
    """
    pts = points(F.col("shape"))
    known = passes.select("flower_id", "ord", "pass_id", "shape", bbox(pts).alias("box"), path_length(pts).alias("long"), paths.bend_zones(F.col("shape")).alias("zones"))
    rows = _neighbours(known.withColumn("bends", F.size("zones")), "pass_id", "shape", "box", "long", "bends").withColumn("c", paths.path_change(F.col("a.shape"), F.col("b.shape")))
    dw, dh, dl = F.col("b.box.width") - F.col("a.box.width"), F.col("b.box.height") - F.col("a.box.height"), F.col("b.long") - F.col("a.long")
    percent = F.try_divide(100 * F.abs(dl), F.col("a.long"))
    topology = (F.col("a.bends") > 0) & (F.col("b.bends") > 0) & (F.col("a.bends") != F.col("b.bends"))
    classes = F.array_compact(
        F.array(
            F.when(dw > LEAST_SIZE, "PROFILE_WIDENED").when(dw < -LEAST_SIZE, "PROFILE_NARROWED"),
            F.when(dh > LEAST_SIZE, "PROFILE_HEIGHT_INCREASED").when(dh < -LEAST_SIZE, "PROFILE_HEIGHT_DECREASED"),
            F.when(topology, "TOPOLOGY_CHANGE"),
            F.when(percent > ORDER_PERCENT, "POSSIBLE_PASS_ORDER_ERROR"),
            F.when(F.col("c.mean_distance") > LEAST_DISTANCE, "ASYMMETRIC_CHANGE"),
        )
    )
    return rows.select(
        "flower_id", "ord", F.col("a.pass_id").alias("from_pass"), F.col("b.pass_id").alias("to_pass"), dw.alias("width_change"), dh.alias("height_change"), dl.alias("length_change"),
        percent.alias("length_percent"), "c.*", topology.alias("topology_change"), F.when(F.size(classes) > 0, classes).otherwise(F.array(F.lit("NO_SIGNIFICANT_CHANGE"))).alias("classes"),
    )


def bend_event(before: Column, after: Column, radius_before: Column, radius_after: Column) -> Column:
    """What happened to a bend, by its signed angles and radii on both passes. Angles within a step of each other are judged by radius, where both have one."""
    change = F.abs(after) - F.abs(before)
    return (
        F.when(before.isNull() & after.isNotNull(), "NEW_BEND_ACTIVATED").when(before.isNotNull() & after.isNull(), "BEND_DEACTIVATED")
        .when(before.isNull() & after.isNull(), "BEND_CORRESPONDENCE_UNCERTAIN").when(before * after < 0, "BEND_REVERSED")
        .when(change > ANGLE_STEP, "BEND_INCREASED").when(change < -ANGLE_STEP, "BEND_DECREASED")
        .when(radius_after < radius_before - RADIUS_STEP, "RADIUS_TIGHTENED").when(radius_after > radius_before + RADIUS_STEP, "RADIUS_OPENED").otherwise("UNCHANGED_BEND")
    )


def zone_events(zones: DataFrame, passes: DataFrame) -> DataFrame:
    """flower_id, ord, zone, both angles and radii, move along the path, and event, of every zone that stands on a pass or on the next.

    zones: flower_id, ord, zone, angle, radius, centre; a row with a null angle is a zone whose bend is unknown there. passes: flower_id, ord of all passes, those without zones
    too; the last of a sequence is compared with nothing. Rows meet by flower, place and zone; a sequence is no group here.
    """
    cols = ["angle", "radius", "centre"]
    a = zones.select("flower_id", "ord", "zone", F.struct(*cols).alias("a"))
    b = zones.select("flower_id", (F.col("ord") - 1).alias("ord"), "zone", F.struct(*cols).alias("b"))
    followed = passes.select("flower_id", "ord").join(passes.select("flower_id", (F.col("ord") - 1).alias("ord")), ["flower_id", "ord"], "left_semi")
    both = a.join(b, ["flower_id", "ord", "zone"], "full_outer").join(followed, ["flower_id", "ord"], "left_semi")
    event = bend_event(F.col("a.angle"), F.col("b.angle"), F.col("a.radius"), F.col("b.radius"))
    return both.select(
        "flower_id", "ord", "zone", F.col("a.angle").alias("angle_before"), F.col("b.angle").alias("angle_after"), F.col("a.radius").alias("radius_before"), F.col("b.radius").alias("radius_after"),
        (F.col("b.centre") - F.col("a.centre")).alias("move"), event.alias("event"),
    )
