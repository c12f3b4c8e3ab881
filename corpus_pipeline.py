"""A corpus pipeline in five stages, each one operator of passlake.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passlake.llm.common import Workspace
from passlake.llm.line_dedup import keep_lines
from passlake.llm.minhash_dedup import keep_one_of_each
from passlake.llm.mixing import mix_documents
from passlake.llm.packing import pack
from passlake.llm.quality_rules import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(spark, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood in an earlier one; those that held nothing else go."""
    return keep_lines(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_each(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a global random order."""
    return mix_documents(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 1024 tokens."""
    return pack(spark, docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL cannot express byte-pair packing; tests compare every stage with a plain version on hard rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written in the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
