"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passlake.llm import (
    chat,
    divergence,
    html_text,
    kdtree,
    license_scan,
    line_dedup,
    minhash_dedup,
    mixing,
    negatives,
    packing,
    quality_rules,
    sharding,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_query,
        "op2_license_scan": license_scan.op2_query,
        "op3_kdtree_topk": kdtree.op3_query,
        "op4_toxicity": toxicity.op4_query,
        "op5_sharding": sharding.op5_query,
        "op6_mixing": mixing.op6_query,
        "op7_minhash_dedup": minhash_dedup.op7_query,
        "op8_line_dedup": line_dedup.op8_query,
        "op9_html_text": html_text.op9_query,
        "op10_packing": packing.op10_query,
        "op11_divergence": divergence.op11_query,
        "op12_hard_negatives": negatives.op12_query,
        "op13_chat_trees": chat.op13_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op3_kdtree_topk": kdtree.OP3_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op7_minhash_dedup": minhash_dedup.OP7_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op11_divergence": divergence.OP11_SQL,
        "op12_hard_negatives": negatives.OP12_SQL,
        "op13_chat_trees": chat.OP13_SQL,
    }
