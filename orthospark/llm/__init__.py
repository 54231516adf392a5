"""Operators of a large-scale training-data pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotrain, exact_dedup, html_extract, jaccard_join, lm_score, packing, piece_nbest, pii, quality_rules, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over its whole table."""
    return {
        "op1_pii_feistel": pii.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_best_fit_packing": packing.query,
        "packing_under_limits": packing.limits_query,
        "op5_quality_cotraining": cotrain.query,
        "op6_size_tiered_sharding": sharding.query,
        "op7_stupid_backoff": lm_score.query,
        "op8_html_extraction": html_extract.query,
        "op9_piece_nbest": piece_nbest.query,
        "op10_quality_rules": quality_rules.query,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op2_jaccard_join": jaccard_join.ORACLE,
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op7_stupid_backoff": lm_score.ORACLE,
        "op10_quality_rules": quality_rules.ORACLE,
    }
