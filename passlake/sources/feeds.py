"""Feeds and tables: cleaning of delimited feeds, redaction, tables of a project, evidence libraries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.operators.evidence import group_hash
from passlake.sources.publish import Library

#: Texts that stand for an unknown value, in lower case.
UNKNOWN = ["", "-", "?", "n/a", "na", "none", "null", "tbd", "unknown"]
#: Other names of inventory columns.
ALIASES = {"id": "asset_id", "roller_id": "asset_id", "design": "design_id", "alias": "design_alias"}
NUMBER = r"^[-+]?[0-9]+(\.[0-9]+)?$"


def header(name: str) -> str:
    """A column name in lower case with one underscore for other characters; other names of inventory columns become these."""
    text = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
    return ALIASES.get(text, text)


def clean_feed(df: DataFrame, numbers: list[str]) -> DataFrame:
    """Normalised headers, trimmed texts, null for unknown values, doubles in `numbers` (null where not a number)."""
    out = df.select(*[F.col(f"`{c}`").alias(header(c)) for c in df.columns])
    for name, kind in out.dtypes:
        if kind == "string":
            text = F.trim(name)
            out = out.withColumn(name, F.when(~F.lower(text).isin(UNKNOWN), text))
        if name in numbers:
            written = F.col(name).cast("string")
            out = out.withColumn(name, F.when(written.rlike(NUMBER), written.try_cast("double")) if kind == "string" else F.col(name).cast("double"))
    return out


def read_inventory(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV feed with a header, cleaned. All columns are read as texts, so no second scan infers types."""
    return clean_feed(spark.read.option("header", True).csv(path), numbers)


def reference_id(prefix: str, *parts: str) -> Column:
    """An opaque id of natural keys."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256), 1, 24))


def redact(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns that df has, in their order."""
    return df.select(*[c for c in allowed if c in df.columns])


def score_breakdown(df: DataFrame, ids: list[str], components: list[str]) -> DataFrame:
    """One row for each id and component that is not null."""
    return df.unpivot(ids, components, "component", "score").where(F.col("score").isNotNull())


def write_project_tables(df: DataFrame, path: str, key: str) -> None:
    """Replaces the partitions of the keys in df and keeps those of others, so that a repeated run changes nothing."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def evidence_library(stages: DataFrame, occurrences: DataFrame, key: str, parts: list[str], held: DataFrame | None = None) -> DataFrame:
    """stage_id (opaque), n and content of each stage: the number of its occurrences and an order-free hash over them, EMPTY without any.

    held: group_hash of these occurrences, where a caller has it already.
    """
    held = group_hash(occurrences, key, parts) if held is None else held
    return stages.select(key).join(held, key, "left").select(
        reference_id("stage", key).alias("stage_id"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hash", F.lit("EMPTY")).alias("content")
    )


def publish_library(library: Library, stages: DataFrame, occurrences: DataFrame, key: str, parts: list[str], note: str = "", held: DataFrame | None = None) -> int:
    """Publishes the evidence library with its occurrences as one version: stage ids are unique, and each occurrence belongs to a stage. Returns its number.

    held: group_hash of these occurrences, where a caller has it already.
    """
    own = occurrences.withColumn("stage_id", reference_id("stage", key)).drop(key)
    tables = {"stages": evidence_library(stages, occurrences, key, parts, held), "occurrences": own}
    return library.publish(tables, [("occurrences", "stage_id", "stages", "stage_id")], {"stages": ["stage_id"]}, note)
