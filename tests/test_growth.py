"""Steps whose work must follow the input: hot places, repeated sizes and shared names, against plain Python or the plan."""

from pyspark.sql import functions as F

from passlake.operators import folds
from passlake.operators import lifecycle as lc
from passlake.operators import matching as m
from passlake.operators import recognition as rec
from passlake.operators import spatial as sp


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_place_is_one_place(spark):
    zero = F.col("id") % 1  # no literal, which would make the join one without keys
    paths = spark.range(20000).select(zero.alias("drawing"), "id", (zero + 1.0).alias("x0"), (zero + 1.0).alias("y0"), (F.col("id") + 5.0).alias("x1"), F.lit(9.0).alias("y1"))
    points = paths.select("drawing", "id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    spots, near = sp._spots(points, 0.05)
    assert spots.count() == near.count() == 1
    assert "Broadcast" not in physical(near)
    row = sp.endpoint_chains(paths).collect()
    assert [(r["chain"], r["n"], r["n_ends"], r["branched"], r["closed"]) for r in row] == [(0, 20000, 20000, True, False)]


def test_circles_of_one_place_are_one_roller(spark):
    zero = F.col("id") % 1
    circles = spark.range(20000).select(zero.alias("drawing"), "id", (zero + 2.0).alias("x"), (zero + 3.0).alias("y"), (1 + F.col("id") % 2).cast("double").alias("radius"))
    lines = spark.createDataFrame([(0, 2.6, 3.8, 2.0, 3.0)], "drawing int, x0 double, y0 double, x1 double, y1 double")
    (row,) = sp.roller_candidates(circles, lines).collect()
    assert (row["roller"], row["n"], row["outer"], row["bore"], row["keyway"]) == (0, 20000, 4.0, 2.0, True)


def test_ends_within_the_tolerance_over_cells(spark):
    rows = [(0, 1, 0.19, 0.0, 5.0, 5.0), (0, 2, 0.21, 0.0, 9.0, 9.0), (0, 3, 9.04, 9.0, 20.0, 0.0), (0, 4, 9.2, 9.0, 30.0, 0.0)]
    got = sp.endpoint_chains(spark.createDataFrame(rows, "drawing int, id long, x0 double, y0 double, x1 double, y1 double")).collect()
    assert sorted((r["chain"], r["n"], r["n_ends"], r["branched"], r["closed"]) for r in got) == [(1, 3, 2, False, False), (4, 1, 2, False, False)]


def test_catalog_match_reads_each_name_once(spark):
    """20000 designs share a drawing, a print and their sizes with 20000 occurrences: 4e8 pairs, were they joined one by one."""
    k = F.col("id")
    catalog = spark.range(20000).select(k.alias("design_id"), F.array(F.lit("d")).alias("drawings"), F.lit("p").alias("fingerprint"), F.lit(5.0).alias("diameter"), F.lit(7.0).alias("width"))
    only = spark.createDataFrame([(90000, ["e", "e"], "q", 50.0, 70.0)], catalog.schema)
    occ = spark.range(20000).select(
        k.alias("occ_id"), F.when(k == 7, 3).cast("long").alias("design_id"), F.when(k % 4 == 1, "d").when(k % 4 == 2, "e").alias("drawing"),
        F.when(k % 4 == 0, "p").alias("fingerprint"), F.when(k % 8 == 3, 5.05).when(k == 15, 50.0).alias("diameter"), F.when(k % 8 == 3, 6.95).when(k == 15, 70.1).alias("width"),
    )
    got = {r["occ_id"]: (r["match"], r["tier"]) for r in m.catalog_match(occ, catalog.union(only)).collect()}
    assert len(got) == 20000 and got[7] == (3, "ID") and got[15] == (90000, "DIMENSIONS") and got[23] == (None, "NONE")
    assert got[1] == got[4] == got[3] == (None, "REVIEW") and got[2] == (90000, "DRAWING")


def test_near_duplicates_of_equal_sizes(spark):
    """20000 items of 20 sizes: 2e8 pairs, were items joined and not sizes."""
    k = F.col("id")
    size = k % 20
    items = spark.range(20000).select(F.lit("g").alias("grp"), "id", (10 + size % 5 * 0.1).alias("length"), (900 + size * 3.0).alias("width"), (5 + size % 2 * 0.2).alias("height"))
    got = {r["id"]: (r["canonical"], round(r["score"], 9)) for r in m.near_duplicates(items).collect()}
    sizes = [(10 + j % 5 * 0.1, 900 + j * 3.0, 5 + j % 2 * 0.2) for j in range(20)]

    def alike(a, b):
        return round(sum(w * (1 - abs(x - y) / max(x, y)) for x, y, w in zip(a, b, (0.5, 0.25, 0.25))), 9)

    want = {}
    for i in range(20000):
        near = [j for j in range(min(i, 20)) if alike(sizes[i % 20], sizes[j]) >= 0.985]
        if near:
            want[i] = (near[0], alike(sizes[i % 20], sizes[near[0]]))
    assert got == want


def test_total_angle_rounds_the_double(spark):
    """8.0605 is a little less than its text as a double: times 1000 it stays under the half, as in SQL."""
    rows = [(1, 1, "a", 0.1, 8.0605, 1), (1, 2, "a", 0.1, 0.0625, 1), (1, 2, "b", 0.2, -0.25, 2)]
    got = folds.pass_signatures(spark.createDataFrame(rows, "flower_id long, pass long, bend_id string, u double, angle double, track int")).orderBy("pass").collect()
    assert [r["total_angle"] for r in got] == [8.06, 0.313]


def test_assertions_are_read_once(spark):
    """The first label of a reviewer comes from a window over the case, not from a second pass with a join."""
    k = F.col("id")
    assertions = spark.range(6).select(
        k.alias("assertion_id"), F.when(k < 5, 1).cast("long").alias("case_id"), F.when(k != 4, "r").alias("reviewer"), F.lit("match_design").alias("outcome"), F.lit(7).cast("long").alias("design_id"),
        F.when(k == 0, 99).cast("long").alias("revision_id"), F.lit("seen").alias("reason"), F.lit(0.5).alias("confidence"),
    )
    cases = spark.createDataFrame([(1, 1)], "case_id long, dataset_id long")
    datasets = spark.createDataFrame([(1, "DRAFT")], "dataset_id long, status string")
    out = lc.judge_assertions(assertions, cases, datasets, spark.createDataFrame([(71, 7)], "revision_id long, design_id long"))
    assert physical(out).count("Range (") == 1
    got = {r["assertion_id"]: r["refused"] for r in out.collect()}
    assert got == {0: "REVISION_OF_OTHER_DESIGN", 1: None, 2: "REVIEWER_REPEATED", 3: "REVIEWER_REPEATED", 4: "REVIEWER_OR_REASON_MISSING", 5: "CASE_NOT_FOUND"}


def test_a_case_asks_in_one_cell(spark):
    row = spark.createDataFrame([(10.0, 5.0, 900.2, "A", "R")], "diameter double, bore double, width double, role string, revision_id string")
    asked = row.select(F.size(rec._every_key([15], [15], True, 1)).alias("n")).first()["n"]
    held = row.select(F.size(rec._every_key([15], [15], False, 1)).alias("n")).first()["n"]
    assert asked == 1 and held > 1


def test_cells_reach_the_whole_tolerance(spark):
    dice = [k * 0.25 for k in range(0, 41)]
    cases = [(f"c{k}", x, None, None, None, "CONFIRMED", None, None, [0.0]) for k, x in enumerate(dice)]
    held = [(f"r{k}", f"d{k}", x, None, None, None, False, None, [0.0]) for k, x in enumerate(dice)]
    a = spark.createDataFrame(cases, "case_id string, diameter double, bore double, width double, role string, units string, hint string, alias string, shape array<double>")
    b = spark.createDataFrame(held, "revision_id string, design_id string, diameter double, bore double, width double, role string, superseded boolean, aliases array<string>, shape array<double>")
    got = [(r["case_id"], r["revision_id"]) for r in rec.candidate_pairs(a, b).select("case_id", "revision_id").collect()]
    want = [(f"c{i}", f"r{j}") for i, x in enumerate(dice) for j, y in enumerate(dice) if abs(x - y) <= 1.0]
    assert sorted(got) == sorted(want)


def test_sums_of_products_are_columns(spark):
    """A group cost a call of numpy and a frame of pandas in each batch; now no row goes to Python."""
    from passlake.operators import model as md

    rows = spark.range(40).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), F.when(F.col("id") != 7, F.col("id") * 2.0).alias("y"))
    found = md.sums_of_products(rows, ["x"], ["y"], "g")
    assert "Pandas" not in physical(found)
    got = {(r.group, r.place): r.total for r in found.collect()}
    ids = [k for k in range(40) if k != 7]
    want = {(g, 3 * i + j): float(sum((1, k, 2 * k)[i] * (1, k, 2 * k)[j] for k in ids if k % 3 == g)) for g in range(3) for i in range(3) for j in range(3)}
    assert got == want


def test_templates_move_members_by_their_fields(spark):
    """Each member's hash as 64 hex digits went through three shuffles; its fields do now, and what stands in a registry is told as before."""
    from passlake.operators import evidence as ev

    rows = [(1, "a", 5), (1, "b", 6), (2, "b", 6), (2, "a", 5), (3, None, 5)]
    members = spark.createDataFrame(rows, "project_id long, role string, design_id long")
    none = spark.createDataFrame([], "template string, template_id string")
    found = ev.register_templates(members, none)
    shuffles = [line for line in physical(found).split("\n") if "Exchange hashpartitioning" in line]
    assert shuffles and not any("m#" in line for line in shuffles) and any("role#" in line and "t#" in line for line in shuffles)
    got = {r.project_id: r for r in found.collect()}
    assert got[1].template_id == got[2].template_id != got[3].template_id and not any(r.collision for r in got.values())
    assert {k: r.template for k, r in got.items()} == {r.project_id: r.template for r in ev.assembly_template(members).collect()}


def test_a_canonical_shape_keeps_no_rotations(monkeypatch):
    """A row of all rotations was a view, which kept them alive for each shape of a batch."""
    import numpy as np
    import pandas as pd

    from passlake.functions import shapes as sh

    held = []
    monkeypatch.setattr(sh.F, "pandas_udf", lambda f, kind: lambda column: held.append(f(column)))
    sh.canonical_closed(pd.Series([np.arange(64.0) % 7, None]))
    assert held[0][0].base is None and len(held[0][0]) == 64 and held[0][1] is None


def test_usages_stay_dealt_over_all_partitions(spark):
    """Lines and orders met in one merged partition, however many rows it held; now each shuffle partition is a task."""
    from passlake.views import view

    dealt = view(spark, "/root/testdata/sf0.001", "usages").groupBy(F.spark_partition_id().alias("p")).count()
    assert dealt.count() == int(spark.conf.get("spark.sql.shuffle.partitions")) == 4


def test_group_hashes_are_summed_as_longs(spark):
    """Sums of quarters were decimals, an object for each row and sum; halves of them are longs, and give the same text."""
    import hashlib

    from passlake.operators import evidence as ev

    rows = spark.range(50).select((F.col("id") % 3).alias("g"), "id", F.when(F.col("id") % 4 != 0, "x").alias("role"))
    found = ev.group_hash(rows, "g", ["role", "id"])
    sums = [line for line in physical(found).split("\n") if "partial_sum" in line]
    assert sums and not any("decimal" in line for line in sums)
    want = {}
    for g in range(3):
        ids = range(g, 50, 3)
        hashes = [hashlib.sha256(f"{'x' if k % 4 else '~'}:{k}".encode()).hexdigest() for k in ids]
        totals = [sum(int(h[15 * k : 15 * k + 15], 16) for h in hashes) for k in range(4)]
        want[g] = (len(ids), hashlib.sha256("|".join(str(x) for x in (len(ids), *totals)).encode()).hexdigest())
    assert {r.g: (r.n, r.hash) for r in found.collect()} == want


def test_boxes_of_a_hot_cell_are_not_paired(spark, monkeypatch):
    """2000 boxes of four places, two and two 0.2 apart: a million pairs, were boxes linked one by one; now a link for each box and pair of homes."""
    k, links = F.col("id"), []
    x = (k % 2) * 1.2 + F.floor(k / 1000) * 50
    boxes = spark.range(2000).select((k % 1).alias("drawing"), "id", x.alias("min_x"), (k % 1).cast("double").alias("min_y"), (x + 1).alias("max_x"), (1.0 + k % 1).alias("max_y"))
    real = sp.components
    monkeypatch.setattr(sp, "components", lambda nodes, edges: links.append(edges.count()) or real(nodes, edges))
    rows = sp.gap_components(boxes).groupBy("component", "n", "min_x", "max_x").count().orderBy("component").collect()
    assert [tuple(r) for r in rows] == [(0, 1000, 0.0, 2.2, 1000), (1000, 1000, 50.0, 52.2, 1000)]
    assert links[0] <= 2000


def test_boxes_without_size_have_no_gap(spark):
    same = spark.createDataFrame([(0, k, 1.0, 1.0, 1.0, 1.0) for k in (1, 2)], "drawing int, id long, min_x double, min_y double, max_x double, max_y double")
    assert sorted((r["id"], r["component"]) for r in sp.gap_components(same).collect()) == [(1, 1), (2, 2)]


def test_parts_are_settled_in_their_batches(spark, monkeypatch):
    """Only parts that lie in several batches go through rounds, and all components are as without parts."""
    import numpy as np

    from passlake.operators import graph

    dice = np.random.default_rng(11)
    rows = [(None if p == 0 else f"p{p}", f"{p}-{a}", f"{p}-{b}") for p in range(60) for a, b in dice.integers(0, 12, (8 if p else 90, 2)).tolist()]
    edges = spark.createDataFrame(rows, "part string, u string, v string")
    nodes = spark.createDataFrame([(f"{p}-{a}",) for p in range(60) for a in range(12)], "id string")
    seen, real = [], graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda df: seen.append(df.select(F.split("u", "-")[0]).distinct().count()) or real(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 0 < seen[0] < 50
    assert len(got) == 720 and got == {r.id: r.component for r in graph.components(nodes, edges.drop("part")).collect()}


def test_topology_links_numbers_once(spark, monkeypatch):
    """Names went through the rounds as text, once for each segment; profile a/b with vertex c also was vertex b/c of profile a."""
    seen, real = [], sp.components
    monkeypatch.setattr(sp, "components", lambda nodes, edges: seen.append((dict(edges.dtypes)["u"], edges.count())) or real(nodes, edges))
    vertices = [("a/b", "c", 0.0, 0.0), ("a/b", "c", 5.0, 0.0), ("a/b", "d", 1.0, 0.0), ("a", "b/c", 0.0, 0.0), ("a", "b/d", 0.0, 0.0), ("a", None, 7.0, 7.0), ("e", "f", 1.0, 1.0)]
    segments = [("a", k, "b/c", "b/d") for k in range(5)] + [("a", 5, None, "b/c"), ("a", 5, "b/c", "x"), ("e", 1, "f", "f")]
    got = sp.validate_topology(
        spark.createDataFrame(vertices, "profile string, id string, x double, y double"), spark.createDataFrame(segments, "profile string, id int, start string, end string")
    ).collect()
    assert sorted((r.profile, r.issue, r.n) for r in got) == [
        ("a", "BAD_DEGREE", 3), ("a", "DUPLICATE_SEGMENT", 1), ("a", "MISSING_VERTEX", 2), ("a", "ZERO_LENGTH", 5),
        ("a/b", "BAD_DEGREE", 2), ("a/b", "DISCONNECTED", 2), ("a/b", "DUPLICATE_VERTEX", 1), ("e", "ZERO_LENGTH", 1),
    ]
    assert seen == [("bigint", 4)]


def test_boxes_that_meet_are_told_once(spark):
    """A pair stood in each cell that both boxes cover, and all pairs were shuffled again to be told once; small tables were broadcast for their bytes."""
    import numpy as np

    from passlake.operators import review as rv

    dice = np.random.default_rng(12)
    corner = lambda: [float(v) for v in dice.integers(-12, 12, 2) / 2]
    made = [(d, k, x, y, x + float(dice.integers(0, 20)) / 2, y + float(dice.integers(0, 20)) / 2) for k in range(60) for d, (x, y) in [(k % 2, corner())]]
    spec = "drawing int, id long, min_x double, min_y double, max_x double, max_y double"
    a, b = (spark.createDataFrame(rows, spec) for rows in (made[:30], made[30:]))
    met = sp.box_join(a, b, 2.0, "meets")
    assert "Broadcast" not in physical(met) and "Aggregate" not in physical(met)
    want = [(p[0], p[1], q[1]) for p in made[:30] for q in made[30:] if p[0] == q[0] and all(p[2 + c] <= q[4 + c] and q[2 + c] <= p[4 + c] for c in (0, 1))]
    assert want and sorted(tuple(r) for r in met.collect()) == sorted(want)

    truth = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 2.0, 2.0), (1, 2, "b", 9.0, 0.0, 10.0, 4.0), (2, 3, "a", 0.0, 0.0, 1.0, 1.0)], spec.replace("id long", "id long, role string"))
    found = spark.createDataFrame([(1, 7, "a", True, 0.0, 0.0, 2.0, 1.5), (1, 8, "c", False, 9.0, 0.0, 10.0, 5.0), (3, 9, "a", True, 0.0, 0.0, 1.0, 1.0)], spec.replace("id long", "id long, role string, automatic boolean"))
    report = rv.quality_report(truth, found)
    assert physical(report).count("ExistingRDD") == 4  # truth and found once for the boxes, once for the counts of drawings
    assert {r.metric: (r.value, r.status) for r in report.collect()} == {
        "count_accuracy": (0.333333, "FAIL"), "mean_iou": (0.516667, "FAIL"), "recall": (0.666667, "FAIL"), "role_accuracy": (0.5, "FAIL"),
        "false_claim_rate": (0.5, "FAIL"), "size_error_pct": (12.5, "FAIL"),
    }
