"""Readers of nested documents and the views of an inventory. Schemas are given, so no reader scans twice to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.sources.feeds import UNKNOWN, header

_BOX = "struct<min_x: double, min_y: double, max_x: double, max_y: double>"
BUNDLE = f"""project_id string, stations array<struct<station_id: string, bbox: {_BOX}, method: string, confidence: double>>,
    profiles array<struct<profile_id: string, station_id: string, developed_length_mm: double>>,
    rollers array<struct<occurrence_id: string, station_id: string, role: string, outer_mm: double, bore_mm: double>>,
    warnings array<struct<code: string, message: string>>"""
DATASET = """dataset_id string, flowers array<struct<flower_id: string, topology: string, passes: array<struct<pass_id: string, shape: array<double>, width: double, height: double>>,
    evidence: array<struct<station_id: string, design_id: string, status: string>>>>"""
CORPUS = "sample_id string, split string, family string, station_count int, teacher array<array<array<double>>>, baseline array<array<array<double>>>"


def read_bundles(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """The tables stations, profiles, rollers and warnings of project bundles: a JSON document in each file, or with `lines` in each line.

    An empty or missing array gives no rows.
    """
    docs = spark.read.schema(BUNDLE).option("multiLine", not lines).json(path)
    return {t: docs.select("project_id", F.inline(t)) for t in ("stations", "profiles", "rollers", "warnings")}


def read_metadata(spark: SparkSession, path: str, number: str = "row_number") -> DataFrame:
    """CSV rows with lower-case underscored headers, unknown values as null. The row number is a column of the file, as a long."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(*[F.col(f"`{c}`").alias(header(c)) for c in rows.columns])
    clean = [F.when(~F.lower(F.trim(c)).isin(UNKNOWN), F.trim(c)).alias(c) for c in rows.columns if c != number]
    return rows.select(F.col(number).try_cast("long").alias(number), *clean)


def read_sequence_dataset(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """The tables flowers, passes (with their order) and evidence of nested sequence datasets, one in each file, or with `lines` in each line."""
    flowers = spark.read.schema(DATASET).option("multiLine", not lines).json(path).select("dataset_id", F.inline("flowers"))
    passes = flowers.select("dataset_id", "flower_id", F.posexplode("passes").alias("ord", "p"))
    return {
        "flowers": flowers.select("dataset_id", "flower_id", "topology", F.coalesce(F.size("passes"), F.lit(0)).alias("n_passes")),
        "passes": passes.select("dataset_id", "flower_id", F.col("ord").cast("long").alias("ord"), "p.*"),
        "evidence": flowers.select("dataset_id", "flower_id", F.inline("evidence")),
    }


def read_corpus(spark: SparkSession, path: str, stations: int = 28, points: int = 128) -> DataFrame:
    """Training samples from Parquet with `valid`: whether both tensors have stations x points x 2 finite numbers."""
    rows = spark.read.schema(CORPUS).parquet(path)

    def shaped(c: str):
        whole = F.forall(c, lambda s: (F.size(s) == points) & F.forall(s, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v))))
        return F.coalesce((F.size(c) == stations) & whole, F.lit(False))

    return rows.withColumn("valid", shaped("teacher") & shaped("baseline"))


#: Columns of the inventory lists; each is ordered by its first column.
LISTS = {
    "designs": ["design_id", "name", "design_type", "manufacturer", "status", "verified"],
    "assets": ["asset_id", "design_id", "serial_number", "condition", "location_id", "verified"],
    "revisions": ["id", "revision_id", "design_id", "asset_id", "dimensions", "unit_status", "verification_status", "physical_fingerprint"],
    "batches": ["id", "source_name", "source_sha256", "status", "row_count", "accepted_count", "review_count", "rejected_count"],
    "locations": ["location_id", "name", "location_type", "parent_location_id"],
    "conditions": ["id", "asset_id", "condition", "observed_at", "source", "notes"],
    "regrinds": ["id", "asset_id", "performed_at", "amount_removed", "amount_unit", "resulting_revision_id", "source", "notes"],
    "compatibility": ["id", "design_id", "compatible_design_id", "status", "evidence", "verified"],
    "files": ["id", "sha256", "file_name", "relative_path", "content_type", "design_id", "asset_id", "revision_id"],
    "audit_events": ["id", "entity_type", "entity_key", "action", "actor", "source"],
}


def inventory_view(tables: dict[str, DataFrame], name: str, lists: dict[str, list[str]] = LISTS) -> DataFrame:
    """One of the inventory lists: its fixed columns, ordered by the first, which is a key. A missing column is null."""
    rows, columns = tables[name], lists[name]
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).orderBy(columns[0])
