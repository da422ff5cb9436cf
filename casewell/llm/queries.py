"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_sharding, op2_token_tables, op3_packing, op4_toxicity, op5_line_dedup, op6_quality_rules, op7_mixing, op8_multiprobe, op9_jaccard_join, op10_token_counts, op11_token_alignment, op12_compression_quality, op13_conversation_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_bin_sharding": op1_sharding.query,
    "op2_token_tables": op2_token_tables.query,
    "op3_conflict_packing": op3_packing.query,
    "op4_weak_toxicity": op4_toxicity.query,
    "op5_line_edit_join": op5_line_dedup.query,
    "op6_quality_rules": op6_quality_rules.query,
    "op7_source_mixing": op7_mixing.query,
    "op8_multiprobe_neighbours": op8_multiprobe.query,
    "op9_jaccard_forest": op9_jaccard_join.query,
    "op10_token_counts": op10_token_counts.query,
    "op11_token_alignment": op11_token_alignment.query,
    "op12_compression_quality": op12_compression_quality.query,
    "op13_conversation_repair": op13_conversation_repair.query,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_edit_join": op5_line_dedup.ORACLE_SQL,
    "op6_quality_rules": op6_quality_rules.ORACLE_SQL,
    "op13_conversation_repair": op13_conversation_repair.ORACLE_SQL,
}
