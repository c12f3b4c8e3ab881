"""Feeds with dirty values, and streaming jobs that are called again after new files came."""

from pyspark.sql import functions as F

from passlake.operators import rules as r
from passlake.sources import feeds
from passlake.streaming import jobs


def test_inventory_is_cleaned(spark, tmp_path):
    (tmp_path / "feed.csv").write_text("Asset ID,Bore (mm),Note\na1, 12.5 , ok \na2,tbd,-\na3,twelve,N/A\n")
    got = sorted(tuple(x) for x in feeds.read_inventory(spark, str(tmp_path / "feed.csv"), ["bore_mm"]).collect())
    assert got == [("a1", 12.5, "ok"), ("a2", None, None), ("a3", None, None)]


def test_project_tables_keep_other_projects(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, x string")
    feeds.write_project_tables(rows, str(tmp_path / "t"), "p")
    feeds.write_project_tables(spark.createDataFrame([(1, "z")], "p int, x string"), str(tmp_path / "t"), "p")
    assert sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "t")).select("p", "x").collect()) == [(1, "z"), (2, "c")]


def test_stream_jobs_take_only_new_files(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string").write.parquet(src)
    for _ in range(2):  # the second call finds nothing new
        table = jobs.stream_ingest(jobs.file_stream(spark, src), str(tmp_path / "ingest"), "k")
        latest = jobs.stream_latest(jobs.file_stream(spark, src), str(tmp_path / "latest"), "k", ["t"], "v")
    assert table.count() == 2
    spark.createDataFrame([(1, 2, "c"), (2, 0, "d")], "k int, t int, v string").write.mode("append").parquet(src)
    table = jobs.stream_ingest(jobs.file_stream(spark, src), str(tmp_path / "ingest"), "k")
    latest = jobs.stream_latest(jobs.file_stream(spark, src), str(tmp_path / "latest"), "k", ["t"], "v")
    assert table.count() == 4
    assert sorted(tuple(x) for x in latest.collect()) == [(1, "c"), (2, "b")]


def test_import_rejects_missing_and_repeated_keys(spark):
    feed = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), (None, 3, 0), ("b", 4, 1)], "k string, n int, f int")
    out = r.import_inventory(feed, ["k"], ["n"], F.col("f") == 1)
    got = {x["n"]: (x["status"], x["reasons"]) for x in out.collect()}
    assert got == {1: ("ACCEPTED", []), 2: ("REJECTED", ["DUPLICATE"]), 3: ("REJECTED", ["MISSING_ID"]), 4: ("REVIEW_REQUIRED", ["REVIEW"])}
