"""Operators that SQL cannot express, and blocking with missing values, against plain Python on small rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passlake.functions import shapes as sh
from passlake.operators import alignment as al
from passlake.operators import graph, ranks
from passlake.operators import model as md
from passlake.operators import recognition as rec
from passlake.operators import review as rv
from passlake.operators import spatial as sp

BOX = "min_x double, min_y double, max_x double, max_y double"


def boxes(dice, n, first=0):
    rows = []
    for k in range(n):
        x, y, w, h = dice.integers(0, 30), dice.integers(0, 30), dice.integers(1, 4), dice.integers(1, 4)
        rows.append((int(k % 3), first + k, float(x), float(y), float(x + w), float(y + h)))
    return rows


def apart(a, b):
    dx, dy = max(a[2] - b[4], b[2] - a[4], 0.0), max(a[3] - b[5], b[3] - a[5], 0.0)
    return (dx * dx + dy * dy) ** 0.5


def test_labels_go_to_candidates_in_order(spark):
    dice = np.random.default_rng(1)
    given, labels = boxes(dice, 60), boxes(dice, 45, 1000)
    used, want, numbers = set(), {}, {}
    for c in given:
        near = sorted((apart(c, t), t[1]) for t in labels if t[0] == c[0] and t[1] not in used)
        want[c[1]] = near[0][1] if near and near[0][0] <= 5 else None
        if want[c[1]]:
            used.add(want[c[1]])
            numbers.setdefault((c[0], want[c[1]] % 10), want[c[1]])
    a = spark.createDataFrame([(*r, r[1]) for r in given], f"drawing int, id long, {BOX}, ord long")
    b = spark.createDataFrame([(*r, r[1] % 10) for r in labels], f"drawing int, id long, {BOX}, number long")
    got = sp.attach_labels(a, b, 5.0).collect()
    assert {r.id: r.label_id for r in got} == want
    assert all(r.conflict == (r.label_id is not None and numbers[r.drawing, r.number] != r.label_id) for r in got)


def test_boxes_match_greedily(spark):
    dice = np.random.default_rng(2)
    truth, found = boxes(dice, 50), boxes(dice, 50, 1000)

    def iou(a, b):
        w, h = (max(0.0, min(a[4 + k], b[4 + k]) - max(a[2 + k], b[2 + k])) for k in (0, 1))
        area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        return w * h / (area(a) + area(b) - w * h)

    pairs = sorted((-iou(a, b), a[1], b[1]) for a, b in itertools.product(truth, found) if a[0] == b[0] and iou(a, b) > 0)
    want, used = set(), set()
    for _, a, b in pairs:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    frames = [spark.createDataFrame(r, f"drawing int, id long, {BOX}") for r in (truth, found)]
    assert {(r.truth_id, r.found_id) for r in rv.match_boxes(*frames).collect()} == want
    assert rv.match_boxes(frames[0], frames[1].limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(150)] + [(500, 501), (501, 500), (7, 7)]
    nodes = spark.createDataFrame([(k,) for k in (*range(151), 500, 501, 900)], "id long")
    got = {r.id: r.component for r in graph.components(nodes, spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(151), 0), 500: 500, 501: 500, 900: 900}


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentiles_are_exact(spark, share):
    dice = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, v in zip(dice.integers(0, 3, 400), dice.integers(0, 40, 400), strict=True)] + [(1, None)]
    got = {r.g: r.p for r in ranks.percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"p": share}).collect()}
    assert got == pytest.approx({g: np.quantile([v for k, v in rows if k == g and v is not None], share) for g in range(3)})


def test_ridge_and_pca_equal_numpy(spark):
    dice = np.random.default_rng(4)
    x = dice.normal(0, 1, (300, 3)) * [1, 5, 0.2]
    y = x @ [[1.0, 2.0], [0.5, -1.0], [3.0, 0.0]] + [4.0, 5.0] + dice.normal(0, 0.1, (300, 2))
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, p double, q double")
    one = np.column_stack([np.ones(300), x])
    want = np.linalg.solve(one.T @ one + np.diag([0, 2.0, 2.0, 2.0]), one.T @ y)
    assert np.allclose(md.fit_ridge(df, ["a", "b", "c"], ["p", "q"], 2.0), want)
    mean, parts, share = md.fit_pca(df.select(F.array("a", "b", "c").alias("v")), "v", variance=0.95)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(mean, x.mean(axis=0)) and len(parts) == 1 and share[0] >= 0.95
    assert np.allclose(np.abs(parts[0]), np.abs(vectors[:, np.argmax(values)]), atol=1e-6)


def test_blocks_lose_no_pair_that_passes(spark):
    dice = np.random.default_rng(5)
    some = lambda v, p=0.25: None if dice.random() < p else v
    spec = "role string, diameter double, bore double, width double, groove double, curvature double, shape array<double>, physical_print string, shape_print string"
    attributes = lambda: (some(str(dice.integers(0, 2))), some(float(dice.integers(0, 60)) / 10), some(1.0), some(float(dice.integers(0, 60)) / 10), 1.0, 0.1, [0.1, 0.2], None, None)
    cases = [(k, *attributes(), "CONFIRMED" if k % 5 else "UNKNOWN", None, None, False, 0.9) for k in range(40)]
    revs = [(100 + k, f"D{k % 7}", *attributes(), None, k % 9 == 0, 0.5) for k in range(40)]
    c = spark.createDataFrame(cases, f"case_id long, {spec}, units string, hint string, alias string, invalid boolean, extraction double")
    r = spark.createDataFrame(revs, f"revision_id long, design_id string, {spec}, aliases array<string>, superseded boolean, confidence double")
    got = {(x.case_id, x.revision_id) for x in rec.score_designs(rec.candidate_pairs(c, r)).where(rec.passes()).collect()}
    want = set()
    for a, b in itertools.product(cases, revs):
        known = a[10] == "CONFIRMED"
        clash = a[1] is not None and b[2] is not None and a[1] != b[2]
        for i, tolerance in ((2, 1.0), (3, 0.5), (4, 1.0)):
            clash |= known and a[i] is not None and b[i + 1] is not None and abs(a[i] - b[i + 1]) > tolerance
        if not clash and not b[12]:
            want.add((a[0], b[0]))
    assert got == want


def test_path_of_least_cost():
    dice = np.random.default_rng(6)
    for _ in range(20):
        cost = dice.random((3, 4))
        found = al._path(cost, 0.45)
        every = []
        for k in range(4):
            for i in itertools.combinations(range(3), k):
                for j in itertools.combinations(range(4), k):
                    every.append(sum(cost[a, b] for a, b in zip(i, j, strict=True)) + 0.45 * (3 + 4 - 2 * k))
        assert min(every) == pytest.approx(sum(x[2] for x in found) + 0.45 * (7 - 2 * len(found)))


def test_shapes_by_hand(spark):
    square = [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]
    bow = [0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 0.0, 2.0]
    rows = spark.createDataFrame([(1, square), (2, bow), (3, None), (4, [1.0, 1.0])], "id int, s array<double>")
    got = {r.id: r for r in rows.select("id", sh.outline(F.col("s")).alias("o"), sh.symmetry(F.col("s")).alias("y"), sh.resample(F.col("s"), 3).alias("r")).collect()}
    assert got[1].o == pytest.approx([4.0, 8.0, 1.0, 1.0, 4.0, 1.0, np.pi / 4, 1.0]) and got[1].y == [1.0, 1.0, 1.0]
    assert got[2].o[-1] == 0.0 and got[3].o is None and got[4].o is None and got[4].r is None
    assert got[1].r == [0.0, 0.0, 2.0, 1.0, 0.0, 2.0]


def test_pairs_meet_once_by_names_and_without_attributes(spark):
    """Identifiers and aliases in any letters, both fingerprints, and cases that share no attribute with a revision."""
    spec = "role string, diameter double, bore double, width double, groove double, curvature double, shape array<double>, physical_print string, shape_print string"
    bare = (None, None, None, None, 1.0, 0.1, [0.1, 0.2])
    cases = [(1, "a", 9.0, 1.0, 1.0, 1.0, 0.1, [0.1, 0.2], "P", "S", "CONFIRMED", "d1", "X", False, 0.9), (2, *bare, None, "S", "UNKNOWN", None, None, False, 0.9), (3, "a", 1.0, 1.0, 1.0, 1.0, 0.1, None, None, None, "UNKNOWN", None, None, False, 0.9)]
    revs = [(10, "D1", "b", 1.0, 1.0, 1.0, 1.0, 0.1, [0.1, 0.2], "P", "S", ["x", "y"], False, 0.5), (11, "D2", *bare, None, "S", None, False, 0.5), (12, "D3", *bare, None, None, ["x"], True, 0.5)]
    c = spark.createDataFrame(cases, f"case_id long, {spec}, units string, hint string, alias string, invalid boolean, extraction double")
    r = spark.createDataFrame(revs, f"revision_id long, design_id string, {spec}, aliases array<string>, superseded boolean, confidence double")
    got = {(x.case_id, x.revision_id): (x.exact_id, x.exact_print, x.score) for x in rec.score_designs(rec.candidate_pairs(c, r)).collect()}
    assert set(got) == {(1, 10), (1, 11), (2, 10), (2, 11)}
    assert got[1, 10][:2] == (True, True) and got[1, 11][:2] == (False, True) and got[2, 10][:2] == (False, True)
    assert got[2, 11] == (False, True, 1.0)
    # shape 1, profile (8/9 apart, 0, 0), diameter 1/9, bore, width, groove and curvature 1, role 0, two fingerprints
    profile, diameter = math.floor((1 - 8 / 9 / 3) * 1e6 + 0.5), math.floor(1e6 / 9 + 0.5)
    total = 35 * 10**6 + 20 * profile + 10 * diameter + 30 * 10**6 + 200 * 10**6
    assert got[1, 10][2] == ((2 * total + 300) // 600) / 1e6
    assert rec.score_designs(rec.candidate_pairs(c.limit(0), r)).count() == 0 and rec.score_designs(rec.candidate_pairs(c, r.limit(0))).count() == 0


def test_equal_ranks_go_by_score(spark):
    rows = [(1, 1, 7, 2, 0.65, 0.9, "HIGH"), (1, 1, 7, 2, 0.9, 0.5, "HIGH"), (1, 1, 6, 1, 0.9, 0.6, "LOW"), (2, 3, 5, 1, 0.8, 0.5, "AMBIGUOUS"), (2, 3, 5, 1, 0.8, 0.7, "HIGH")]
    df = spark.createDataFrame(rows, "occurrence long, rank long, design_id long, revision_id long, score double, coverage double, state string")
    got = sorted((r.occurrence, r.place, r.design_id, r.score, r.state) for r in rv.direct_evidence(df, df.select("occurrence", "design_id").limit(0)).collect())
    assert got == [(1, 1, 6, 0.9, "AMBIGUOUS"), (1, 2, 7, 0.9, "AMBIGUOUS"), (1, 3, 7, 0.65, "AMBIGUOUS"), (2, 1, 5, 0.8, "AMBIGUOUS"), (2, 2, 5, 0.8, "AMBIGUOUS")]
    cases = spark.createDataFrame([(1, "MATCH_DESIGN", 6), (2, "MATCH_DESIGN", 5), (3, "MATCH_DESIGN", 1)], "case_id long, outcome string, expected long")
    r = rv.threshold_evaluation(cases, df.withColumnRenamed("occurrence", "case_id")).first()
    assert (r.cases, r.matches, r.top1, r.coverage, r.accuracy) == (3, 3, round(2 / 3, 6), round(2 / 3, 6), 1.0)
