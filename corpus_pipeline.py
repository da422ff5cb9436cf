"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewell.llm import op3_packing, op4_toxicity, op5_line_dedup, op7_mixing, op9_jaccard_join
from casewell.llm.common import saved, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", op4_toxicity.stage),
    ("line_dedup", op5_line_dedup.stage),
    ("near_duplicates", op9_jaccard_join.stage),
    ("mixing", op7_mixing.stage),
    ("packing", op3_packing.stage),
]

#: SQL can express neither the label model nor the searches; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
