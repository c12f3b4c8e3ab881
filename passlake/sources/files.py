"""Files as sources: manifests over a tree of files, and bundles of which broken ones fail alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_manifest(spark: SparkSession, root: str, patterns: list[str], content: bool = False) -> DataFrame:
    """path (below root), length and sha256 of the files below root, at any depth, whose name matches a pattern; also `content` if asked for.

    Patterns are globs (`*.json`) read in one scan, so a file that matches several counts once. A root without files gives no rows, and Spark's scan leaves
    out files of no bytes. A file is one row of the scan: those over spark.sql.sources.binaryFile.maxLength bytes make it fail.
    """
    glob = patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    # what stands below the root, whatever scheme and host come before
    path = F.substr("path", F.locate(f"{whole}/", "path") + len(whole) + 1)
    return found.select(path.alias("path"), "length", F.sha2("content", 256).alias("sha256"), *(["content"] if content else []))


def config_hash(settings: dict[str, str]) -> str:
    """SHA-256 of the settings in the order of their names."""
    return hashlib.sha256("".join(f"{k}={settings[k]}\n" for k in sorted(settings)).encode()).hexdigest()


def read_bundles(files: DataFrame, schema: StructType, required: list[str]) -> DataFrame:
    """path, sha256, bundle, status and error of every file, each a JSON document. files: path, sha256, content.

    A file that is no JSON of the schema, or lacks a required field, is FAILED with its reason and a null bundle; the others are SUCCESS. So a broken file costs no other one.
    """
    text = F.decode("content", "UTF-8")
    told = StructType([*schema.fields]).add("_broken", "string")
    parsed = files.withColumn("b", F.from_json(text, told, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"b.{c}").isNull(), c) for c in required]))
    error = (
        F.when(F.col("content").isNull() | (F.length("content") == 0), "EMPTY")
        .when(F.col("b").isNull() | F.col("b._broken").isNotNull(), "MALFORMED")
        .when(F.size(lacking) > 0, F.concat(F.lit("MISSING: "), F.array_join(lacking, ", ")))
    )
    bundle = F.when(F.col("error").isNull(), F.struct(*[F.col(f"b.{f.name}").alias(f.name) for f in schema.fields]))
    rows = parsed.withColumn("error", error)
    return rows.select("path", "sha256", bundle.alias("bundle"), F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED").alias("status"), "error")


def plan_files(manifest: DataFrame, ledger: DataFrame, config: str) -> DataFrame:
    """path, sha256 and action of each file: SKIP where the ledger has a success of the same content and settings, else PROCESS; STALE if it vanished.

    ledger: path, sha256, config, status, run; the latest run of a path counts. Failed files are tried again.
    """
    last = ledger.groupBy("path").agg(F.max_by(F.struct("sha256", "config", "status"), "run").alias("last"))
    both = manifest.select("path", "sha256").join(last, "path", "full_outer")
    same = (F.col("last.sha256") == F.col("sha256")) & (F.col("last.config") == config) & (F.col("last.status") == "SUCCESS")
    action = F.when(F.col("sha256").isNull(), "STALE").when(F.coalesce(same, F.lit(False)), "SKIP").otherwise("PROCESS")
    return both.select("path", "sha256", action.alias("action"))


def run_batch(spark: SparkSession, root: str, patterns: list[str], schema: StructType, required: list[str], ledger: DataFrame, config: str, run: int) -> DataFrame:
    """bundle and ledger rows (path, sha256, config, status, error, run) of the files that must be processed. Contents of skipped files are not parsed."""
    files = file_manifest(spark, root, patterns, content=True)
    todo = plan_files(files, ledger, config).where("action = 'PROCESS'").select("path")
    read = read_bundles(files.join(todo, "path", "left_semi"), schema, required)
    return read.select("path", "sha256", "bundle", F.lit(config).alias("config"), "status", "error", F.lit(run).cast("long").alias("run"))
