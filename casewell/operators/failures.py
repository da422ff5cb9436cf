"""Where a system fails: wrong routing, wrong intents by cost, defects of drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def gold_by_output(outputs: DataFrame, gold: DataFrame) -> DataFrame:
    """All outputs; gold_ columns where there is a gold row."""
    named = gold.select("thread_id", F.lit(True).alias("has_gold"), *(F.col(c).alias(f"gold_{c}") for c in ("intent", "action", "escalation_reason")))
    return outputs.join(named, "thread_id", "left").withColumn("has_gold", F.coalesce("has_gold", F.lit(False)))


def defects(rows: DataFrame) -> DataFrame:
    """system, thread_id, defect: every pattern a reply matches, and names carried over from a precedent."""
    found = T.draft_defects(F.col("reply"))
    if "exemplars" in rows.columns:
        carried = F.when(T.carried_over_name(F.col("reply"), F.col("exemplars")).isNotNull(), F.array(F.lit("name_carried_from_precedent"))).otherwise(F.array().cast("array<string>"))
        found = F.concat(found, carried)
    return rows.select("system", "thread_id", F.explode(found).alias("defect"))


def defects_by_system(rows: DataFrame) -> DataFrame:
    return defects(rows).groupBy("system", "defect").agg(F.count("*").alias("n"))


def failure_rows(joined: DataFrame, never_auto: list[str]) -> DataFrame:
    """Matched rows with false_auto, false_escalate, intent_wrong and cost."""
    guarded = lambda c: F.coalesce(F.col(c).isin(never_auto), F.lit(False))
    wrong = ~F.col("intent").eqNullSafe(F.col("gold_intent"))
    return joined.where("has_gold").select(
        "*", ((F.col("action") == "auto") & (F.col("gold_action") == "escalate")).alias("false_auto"),
        ((F.col("action") == "escalate") & (F.col("gold_action") == "auto")).alias("false_escalate"), wrong.alias("intent_wrong"),
        F.when(wrong, F.when(guarded("gold_intent") & ~guarded("intent"), "lost a never-auto guard").otherwise("harmless direction")).alias("cost"),
    )


def failure_analysis(joined: DataFrame, never_auto: list[str]) -> DataFrame:
    """family, key, n: one pass over the outputs, every count of the report."""
    rows = failure_rows(joined, never_auto)
    mark = lambda family, key, on: F.when(on, F.struct(F.lit(family).alias("family"), key.alias("key")))
    marks = F.array(
        mark("false_auto_by_reason", F.col("gold_escalation_reason"), F.col("false_auto")),
        mark("false_auto_intent_also_wrong", F.lit("yes"), F.col("false_auto") & F.col("intent_wrong")),
        mark("false_auto_gold_never_auto", F.lit("yes"), F.col("false_auto") & F.col("gold_intent").isin(never_auto)),
        mark("false_escalate_by_rule", F.col("triggered_rule"), F.col("false_escalate")),
        mark("intent_confusion", F.concat(F.col("gold_intent"), F.lit(" -> "), F.col("intent")), F.col("intent_wrong")),
        mark("intent_cost", F.col("cost"), F.col("intent_wrong")),
        *(mark("draft_defect", F.lit(n), F.coalesce(F.col("reply").rlike(T.any_case(p)), F.lit(False))) for n, p in T.DEFECTS),
    )
    counts = rows.select(F.explode(F.array_compact(marks)).alias("m")).groupBy("m.family", "m.key").agg(F.count("*").alias("n"))
    totals = joined.select(F.explode(F.array_compact(F.array(
        F.struct(F.lit("total").alias("family"), F.lit("n").alias("key")), mark("total", F.lit("n_auto"), F.col("action") == "auto"),
        F.struct(F.lit("rule_fired").alias("family"), F.col("triggered_rule").alias("key")),
    ))).alias("m")).groupBy("m.family", "m.key").agg(F.count("*").alias("n"))
    return counts.unionByName(totals)


def false_auto_range(joined: DataFrame, never_auto: list[str]) -> DataFrame:
    return failure_rows(joined, never_auto).where("false_auto").agg(F.count("*").alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))
