"""Hand-worked cases of the library's operators: nulls, ties, empty input."""

from pyspark.sql import functions as F

from passlake.functions import vectors as v
from passlake.operators import evidence as ev
from passlake.operators import sequence as sq


def test_path_length_and_box(spark):
    row = spark.createDataFrame([([0.0, 0.0, 3.0, 4.0, 3.0, 4.0],)], "s array<double>")
    p = v.points(F.col("s"))
    got = row.select(v.path_length(p).alias("n"), v.bbox(p).alias("b")).first()
    assert (got.n, got.b.width, got.b.height) == (5.0, 3.0, 4.0)


def test_relative_similarity_keeps_nulls(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(v.rel_sim(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, None]


def test_monotone_order_never_goes_back(spark):
    rows = spark.createDataFrame([(1, k, w, m) for k, (w, m) in enumerate([(3, True), (1, True), (9, False), (4, True)])], "flower_id long, ord long, wanted long, m boolean")
    got = {r.ord: r.station for r in sq.monotone_order(rows, F.col("m")).collect()}
    assert got == {0: 3, 1: 4, 2: None, 3: 5}


def test_smoothness_of_short_sequences(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 9.0)], "flower_id long, ord long, width double")
    assert sq.smoothness(rows).first().smoothness == 100.0
    assert sq.smoothness(rows.limit(0)).count() == 0


def test_plan_batch_actions(spark):
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    ledger = spark.createDataFrame([("a", "1", "SUCCESS"), ("b", "x", "SUCCESS"), ("d", "4", "SUCCESS")], "path string, sha256 string, status string")
    got = {r.path: r.action for r in ev.plan_batch(manifest, ledger).collect()}
    assert got == {"a": "SKIP", "b": "PROCESS", "c": "PROCESS", "d": "STALE"}


def test_content_hash_ignores_row_order(spark):
    rows = [("g", k, str(k)) for k in range(50)]
    one = ev.content_hash(spark.createDataFrame(rows, "g string, a long, b string"), "g", ["a", "b"]).first()
    two = ev.content_hash(spark.createDataFrame(rows[::-1], "g string, a long, b string").repartition(7), "g", ["a", "b"]).first()
    assert one == two
