"""Primitives, bend zones and changes of paths on shapes whose values are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passlake.functions import paths
from passlake.functions.vectors import points
from passlake.operators import changes as ch

SHAPES = "pass_id long, flower_id long, ord long, shape array<double>"


def zones(spark, *shapes):
    df = spark.createDataFrame([(i, 1, i, s) for i, s in enumerate(shapes)], SHAPES)
    return [r.z for r in df.select("pass_id", paths.bend_zones(F.col("shape")).alias("z")).orderBy("pass_id").collect()]


def test_primitives(spark):
    schema = "id long, kind string, shape array<double>, closed boolean, r double, a double, b double, mx double, my double, q double"
    square = [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]
    rows = [
        (0, "LINE", [0.0, 0.0, 3.0, 4.0], None, None, None, None, None, None, None), (1, "LWPOLYLINE", square, True, None, None, None, None, None, None),
        (2, "polyline", square, None, None, None, None, None, None, None), (3, "ARC", None, None, 2.0, 350.0, 80.0, None, None, None), (4, "ARC", None, None, 2.0, 10.0, 10.0, None, None, None),
        (5, "CIRCLE", None, None, 2.0, None, None, None, None, None), (6, "ELLIPSE", None, None, None, None, None, 3.0, 4.0, 1.0), (7, "ELLIPSE", None, None, None, 0.0, math.pi, 0.0, 2.0, 0.0),
        (8, "CIRCLE", None, None, None, None, None, None, None, None), (9, None, square, True, None, None, None, None, None, None),
    ]
    c = F.col
    length = paths.primitive_length(c("kind"), points(c("shape")), closed=c("closed"), radius=c("r"), start=c("a"), end=c("b"), major_x=c("mx"), major_y=c("my"), ratio=c("q"))
    df = spark.createDataFrame(rows, schema).select("id", length.alias("v"))
    assert "Python" not in df._jdf.queryExecution().toString()
    got = {r.id: r.v for r in df.collect()}
    assert got[8] is None
    want = {0: 5, 1: 8, 2: 6, 3: math.pi, 4: 4 * math.pi, 5: 4 * math.pi, 7: 4, 9: 6}
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert 10 * math.pi * 0.9995 < got[6] < 10 * math.pi


def test_zones_of_known_paths(spark):
    corner = [0.0, 0.0, 10.0, 0.0, 10.0, 10.0]
    round_ = [v for k in range(11) for v in (10 + math.sin(math.radians(9 * k)), 1 - math.cos(math.radians(9 * k)))]
    arc = [0.0, 0.0, *round_, 11.0, 10.0]
    stairs = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 2.0, 1.0]
    bumpy = [0.0, 0.0, 5.0, 0.1, 10.0, 0.0, 10.0, 0.0, 10.0, 10.0]
    back = [0.0, 0.0, 10.0, 0.0, 0.0, 0.1]
    got = zones(spark, corner, arc, stairs, bumpy, back, None, [1.0, 1.0], [1.0] * 8, [0.0, 0.0, float("nan"), 1.0, 2.0, 2.0])
    (one,) = got[0]
    assert (one.zone, one.angle, one.centre, one.u, one.length, one.turns, one.incoming, one.outgoing) == pytest.approx((1, 90, 10, 0.5, 20, 1, 0, 90))
    assert one.radius == pytest.approx(20 / math.radians(90))
    (bend,) = got[1]
    assert bend.angle == pytest.approx(90, abs=5.5) and bend.turns == 9
    # The rule takes the length between the first and last vertex, so a drawn arc of radius 1 reads as one step of its chords less.
    assert bend.radius == pytest.approx((bend.last - bend.first) / math.radians(bend.angle)) and bend.radius == pytest.approx(0.8, abs=0.01)
    assert [z.angle for z in got[2]] == pytest.approx([90, -90])
    assert [(z.turns, z.angle) for z in got[3]] == [(1, pytest.approx(90, abs=1))]
    assert got[4:] == [[], None, None, [], None]


def test_zones_join_only_near_turns_of_one_sign(spark):
    near = [0.0, 0.0, 100.0, 0.0, 105.0, 5.0, 105.0, 105.0]
    far = [0.0, 0.0, 100.0, 0.0, 150.0, 50.0, 150.0, 150.0]
    got = zones(spark, near, far)
    assert [[(z.turns, round(z.angle)) for z in x] for x in got] == [[(2, 90)], [(1, 45), (1, 45)]]


def test_reversed_and_turned_paths(spark):
    rng = np.random.default_rng(1)
    base = np.cumsum(rng.random((20, 2)) + [1.0, 0], axis=0)
    t = math.radians(20)
    turned = (base - base.mean(axis=0)) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + base.mean(axis=0)
    series = [base, base[::-1], base + [3.0, 4.0], turned]
    df = spark.createDataFrame([(i, 1, i, p.ravel().tolist()) for i, p in enumerate(series)] + [(9, 2, 0, None), (10, 2, 1, [1.0])], SHAPES)
    got = {(r.flower_id, r.ord): r for r in ch.path_transitions(df).collect()}
    same = got[1, 0]
    assert same.reversed and same.max_distance == pytest.approx(0, abs=1e-9) and same.move == pytest.approx(0, abs=1e-9) and same.length_change == pytest.approx(0, abs=1e-9)
    moved = got[1, 1]
    assert (moved.move_x, moved.move_y, moved.mean_distance, moved.best_rotation) == pytest.approx((3, 4, 5, 0), abs=1e-6)
    assert "ASYMMETRIC_CHANGE" in moved.classes
    whole = ch.path_transitions(spark.createDataFrame([(0, 1, 0, base.ravel().tolist()), (1, 1, 1, turned.ravel().tolist())], SHAPES)).first()
    assert whole.best_rotation == pytest.approx(20, abs=1e-6) and whole.rotation == pytest.approx(20, abs=1e-6)
    assert got[2, 0].mean_distance is None and got[2, 0].classes == ["NO_SIGNIFICANT_CHANGE"]
    assert ch.path_transitions(df.where("false")).count() == 0


def test_every_rule_of_the_event_ladder(spark):
    cases = [
        ((None, 5.0, None, None), "NEW_BEND_ACTIVATED"), ((5.0, None, None, None), "BEND_DEACTIVATED"), ((None, None, 1.0, 2.0), "BEND_CORRESPONDENCE_UNCERTAIN"), ((5.0, -5.0, 1.0, 1.0), "BEND_REVERSED"),
        ((5.0, 6.5, 1.0, 9.0), "BEND_INCREASED"), ((-6.5, -5.0, 1.0, 9.0), "BEND_DECREASED"), ((5.0, 6.0, 2.0, 1.5), "RADIUS_TIGHTENED"), ((5.0, 5.0, 1.0, 1.5), "RADIUS_OPENED"),
        ((5.0, 5.0, 1.0, 1.05), "UNCHANGED_BEND"), ((5.0, 5.0, None, 7.0), "UNCHANGED_BEND"), ((0.0, 0.5, None, None), "UNCHANGED_BEND"),
    ]
    df = spark.createDataFrame([(i, *v) for i, (v, _) in enumerate(cases)], "i long, a double, b double, r double, s double")
    got = df.select("i", ch.bend_event(*map(F.col, "abrs")).alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [e for _, e in cases]


def test_zones_of_a_flat_pass_end_and_begin(spark):
    z = spark.createDataFrame([(1, 0, 1, 30.0, 2.0, 5.0), (1, 2, 1, 20.0, 2.0, 6.0)], "flower_id long, ord long, zone long, angle double, radius double, centre double")
    passes = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "flower_id long, ord long")
    assert sorted((r.ord, r.zone, r.event) for r in ch.zone_events(z, passes).collect()) == [(0, 1, "BEND_DEACTIVATED"), (1, 1, "NEW_BEND_ACTIVATED")]
