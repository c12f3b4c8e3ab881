"""Publishing of versions, manifests and bundles of files, streams by event time."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from passlake.operators import evidence as ev
from passlake.operators import ranks
from passlake.sources import files, publish
from passlake.streaming import jobs


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_failed_version_leaves_the_old_one(spark, tmp_path):
    lib = publish.Library(spark, str(tmp_path / "lib"))
    assert lib.pointer() is None and lib.read("stages") is None
    stages = spark.createDataFrame([(1,), (2,)], "stage long")
    uses = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "stage long, x string")
    rules = {"references": [("uses", "stage", "stages", "stage")], "keys": {"stages": ["stage"]}}
    assert lib.publish({"stages": stages, "uses": uses}, **rules, note="first") == 1
    reader = lib.read("uses")
    with pytest.raises(publish.IntegrityError, match="uses.stage: 1 rows"):
        lib.publish({"stages": stages.where("stage = 1"), "uses": uses}, **rules)
    with pytest.raises(publish.IntegrityError, match="stages: 1 keys"):
        lib.publish({"stages": stages.union(stages.where("stage = 1")), "uses": uses}, **rules)
    boom = stages.withColumn("stage", F.raise_error(F.lit("boom")).cast("long"))
    with pytest.raises(Exception, match="boom"):
        lib.publish({"stages": stages, "uses": boom})
    assert lib.pointer()[0] == 1 and lib.pointer()[2] == "first" and reader.count() == 3 and lib.read("stages").count() == 2
    # a rebuild reads what it replaces
    assert lib.publish({"stages": lib.read("stages").union(spark.createDataFrame([(3,)], "stage long")), "uses": lib.read("uses")}, **rules) == 2
    assert rows_of(lib.read("stages"), "stage") == [(1,), (2,), (3,)] and reader.count() == 3
    for _ in range(4):
        lib.publish({"stages": lib.read("stages"), "uses": lib.read("uses")}, **rules)
    assert lib.pointer()[0] == 6 and len(list((tmp_path / "lib" / "versions").iterdir())) < 6


def tree(root):
    (root / "a" / "b").mkdir(parents=True)
    good = {"id": "x1", "stations": [{"k": 1}]}
    (root / "a" / "one.bundle.json").write_text(json.dumps(good))
    (root / "a" / "b" / "two.json").write_text(json.dumps(good | {"id": "x2"}))
    (root / "a" / "b" / "broken.json").write_text('{"id": "x3", "stations": [')
    (root / "a" / "lacking.json").write_text('{"stations": []}')
    (root / "blank.json").write_text(" ")
    (root / "nothing.json").write_text("")  # the scan leaves it out
    (root / "it's (1).txt").write_text("text")
    (root / "skip.dat").write_text("no")


BUNDLE = StructType().add("id", StringType()).add("stations", ArrayType(StructType().add("k", LongType())))


def test_manifest_counts_a_file_once(spark, tmp_path):
    import hashlib

    tree(tmp_path)
    got = {r.path: (r.length, r.sha256) for r in files.file_manifest(spark, str(tmp_path), ["*.json", "*.txt", "*.bundle.json", "*.absent"]).collect()}
    want = {str(p.relative_to(tmp_path)): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*") if p.suffix in (".json", ".txt") and p.stat().st_size}
    assert got == want and len(got) == 6


def test_broken_bundles_fail_alone_and_a_batch_resumes(spark, tmp_path):
    root = tmp_path / "in"
    tree(root)
    empty = spark.createDataFrame([], "path string, sha256 string, config string, status string, run long")
    config = files.config_hash({"b": "2", "a": "1"})
    assert config == files.config_hash({"a": "1", "b": "2"}) != files.config_hash({"a": "1"})
    run = lambda held, conf, n: files.run_batch(spark, str(root), ["*.json"], BUNDLE, ["id"], held, conf, n)
    first = run(empty, config, 1).cache()
    assert rows_of(first, "path", "status", "error") == sorted([
        ("a/b/broken.json", "FAILED", "MALFORMED"), ("a/b/two.json", "SUCCESS", None), ("a/lacking.json", "FAILED", "MISSING: id"), ("a/one.bundle.json", "SUCCESS", None),
        ("blank.json", "FAILED", "MALFORMED"),
    ], key=repr)
    assert rows_of(first.where("bundle is not null"), "bundle.id") == [("x1",), ("x2",)]
    ledger = first.drop("bundle", "error")
    (root / "a" / "b" / "broken.json").write_text('{"id": "x3"}')
    (root / "a" / "b" / "two.json").unlink()
    assert rows_of(files.plan_files(files.file_manifest(spark, str(root), ["*.json"]), ledger, config), "path", "action") == [
        ("a/b/broken.json", "PROCESS"), ("a/b/two.json", "STALE"), ("a/lacking.json", "PROCESS"), ("a/one.bundle.json", "SKIP"), ("blank.json", "PROCESS")
    ]
    second = run(ledger, config, 2)
    assert rows_of(second, "path", "status") == [("a/b/broken.json", "SUCCESS"), ("a/lacking.json", "FAILED"), ("blank.json", "FAILED")]
    assert rows_of(run(ledger, "other", 2).where("status = 'SUCCESS'"), "path") == [("a/b/broken.json",), ("a/one.bundle.json",)]


def test_late_and_repeated_events(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "job")
    schema = "k long, t timestamp, e long, v string"

    def add(rows):
        spark.createDataFrame([(k, f"2024-01-{d:02d} 00:00:00", e, v) for k, d, e, v in rows], "k long, t string, e long, v string").select("k", F.to_timestamp("t").alias("t"), "e", "v").coalesce(1).write.mode("append").parquet(src)

    def run():
        got = jobs.latest_by_event_time(jobs.file_stream(spark, src), root, "k", "t", "e", "v", "3 days")
        return sorted((r.k, r.t.day, r.v) for r in got.collect())

    add([(1, 10, 1, "a"), (1, 10, 1, "a"), (2, 9, 2, "b"), (1, 9, 3, "old")])
    assert run() == [(1, 10, "a"), (2, 9, "b")]
    assert run() == [(1, 10, "a"), (2, 9, "b")]  # nothing new
    add([(1, 10, 1, "a"), (3, 20, 4, "c"), (2, 8, 5, "older")])  # a repeat, a jump, an event within the delay that is not the latest
    assert run() == [(1, 10, "a"), (2, 9, "b"), (3, 20, "c")]
    add([(2, 11, 6, "too late"), (3, 19, 7, "in time, not latest"), (4, 18, 8, "in time")])  # the watermark stands at the 17th
    assert run() == [(1, 10, "a"), (2, 9, "b"), (3, 20, "c"), (4, 18, "in time")]
    assert spark.read.parquet(f"{root}/library/versions/*/latest").schema.names == ["k", "t", "e", "v"] and schema


def test_deliveries_replace_projects(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "job")

    def run(rows):
        spark.createDataFrame(rows, "p long, t long, x string").coalesce(1).write.mode("append").parquet(src)
        return rows_of(jobs.replace_projects(jobs.file_stream(spark, src), root, "p", "t"), "p", "t", "x")

    assert run([(1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (2, 0, "older")]) == [(1, 1, "a"), (1, 1, "b"), (2, 1, "c")]
    assert run([(1, 2, "z")]) == [(1, 2, "z"), (2, 1, "c")]
    assert run([(1, 1, "a"), (2, 1, "again"), (3, 1, "d")]) == [(1, 2, "z"), (2, 1, "c"), (3, 1, "d")]


def test_folders_are_shared_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        jobs.shared_folder(Session(), "x")


def test_templates_are_reused_or_created_once(spark):
    rows = [(1, "top", 5), (1, "low", 6), (2, "low", 6), (2, "top", 5), (3, "low", 6), (3, "low", 6), (3, "top", 5), (4, None, None), (5, "low", 6)]
    df = spark.createDataFrame(rows, "project_id long, role string, design_id long")
    none = spark.createDataFrame([], "template string, template_id string")
    first = {r.project_id: r for r in ev.register_templates(df.repartition(5), none).collect()}
    assert first[1].template_id == first[2].template_id and len({first[k].template_id for k in (1, 3, 4, 5)}) == 4
    assert {r.action for r in first.values()} == {"CREATED"} and not any(r.collision for r in first.values())
    registry = spark.createDataFrame([(r.template, r.template_id) for r in first.values()] + [(first[5].template, "a-first")], "template string, template_id string")
    second = {r.project_id: r for r in ev.register_templates(df.coalesce(1), registry).collect()}
    assert {r.action for r in second.values()} == {"REUSED"} and second[5].template_id == "a-first" and second[1].template_id == first[1].template_id
    assert ev.register_templates(df.limit(0), none).count() == 0


def test_a_collision_of_templates_is_seen(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "a", 1)], "project_id long, role string, design_id long")
    monkeypatch.setattr(ev, "assembly_template", lambda m: m.select("project_id").distinct().withColumn("template", F.when(F.col("project_id") < 3, "same").otherwise("other")))
    got = {r.project_id: r.collision for r in ev.register_templates(df, spark.createDataFrame([], "template string, template_id string")).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_weighted_percentiles_equal_unfolded_rows(spark):
    import numpy as np

    rows = [("a", 1.0, 3), ("a", 4.0, 2), ("a", 4.0, 1), ("b", 2.0, 10_000_000), ("b", 3.0, 1)]
    df = spark.createDataFrame(rows, "k string, x double, n long")
    got = {r.k: (r.q, r.h) for r in ranks.percentiles(df, ["k"], "x", {"q": 0.25, "h": 0.9}, weight="n").collect()}
    flat = [1.0] * 3 + [4.0] * 3
    assert got["a"] == (np.quantile(flat, 0.25), np.quantile(flat, 0.9)) and got["b"] == (2.0, 2.0)
