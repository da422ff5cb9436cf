"""Routing: the first rule that fires decides; the same plan runs on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TAU_CONFIDENCE, TAU_SIMILARITY = 0.9, 0.75


def max_similarity(exemplars: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(exemplars, lambda e: e["similarity"])), F.lit(0.0))


def _words(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def rules(never_auto: Column, note: Column, tau_confidence: float, tau_similarity: float) -> list[tuple[Column, Column, Column]]:
    """(fires, rule, reason) in order, over hard_ and pii_ (names of the message's patterns), intent, confidence, ok, draft_ok, reply, truncated, grounded_in,
    uncertain, uncertainty_reason and max_similarity."""
    hard, pii = F.col("hard_"), F.col("pii_")
    lit, number = F.lit, lambda c: F.format_string("%.2f", c)
    # Rule names and the wording of reasons, which are output.
    return [
        (hard.isNotNull(), hard, F.concat(lit("message matches "), _words(hard), lit(" pattern"))),
        (pii.isNotNull(), F.concat(lit("pii_"), pii), F.concat(lit("message appears to contain "), _words(pii))),
        (never_auto, lit("never_auto_intent"), F.concat(lit("intent '"), F.col("intent"), lit("' is never auto-handled ("), F.coalesce(F.nullif(note, lit("")), lit("policy")), lit(")"))),
        (~F.col("ok"), lit("classifier_failure"), lit("intent classification failed")),
        (~F.col("draft_ok") | (F.trim(T.filled(F.col("reply"))) == ""), lit("draft_failure"), lit("no usable reply was drafted")),
        (F.col("truncated"), lit("draft_over_length"), lit("draft exceeded the length limit and was cut")),
        (F.size(F.coalesce("grounded_in", F.array().cast("array<string>"))) == 0, lit("draft_ungrounded"), lit("draft cites no historical precedent to ground it")),
        (F.col("uncertain"), lit("draft_uncertain"), F.concat(lit("drafter self-flagged: "), F.coalesce(F.nullif("uncertainty_reason", lit("")), lit("drafter flagged low confidence")))),
        (F.col("max_similarity") < tau_similarity, lit("low_retrieval_similarity"), F.concat(lit("no similar precedent (best similarity "), number(F.col("max_similarity")), lit(f" < {tau_similarity:.2f})"))),
        (F.col("confidence") < tau_confidence, lit("low_confidence"), F.concat(lit("intent confidence "), number(F.col("confidence")), lit(f" below {tau_confidence:.2f}"))),
    ]


def with_policy(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """never_auto and escalation_note of each row's intent. The class table has one row per class: a dozen."""
    policy = taxonomy.select(F.col("name").alias("intent"), "never_auto", "escalation_note")
    return rows.join(F.broadcast(policy), "intent", "left").withColumn("never_auto", F.coalesce("never_auto", F.lit(False)))


def with_patterns(rows: DataFrame, message: str = "customer_msg") -> DataFrame:
    """hard_ and pii_ of the message in projections of their own: a text is folded once, each pattern runs once at most."""
    folded = F.col("folded_")
    rows = rows.withColumn("folded_", T.fold(T.filled(F.col(message))))
    return rows.withColumns({"hard_": T.match_hard_escalation(F.col(message), folded), "pii_": T.match_pii(F.col(message), folded)}).drop("folded_")


def route(rows: DataFrame, taxonomy: DataFrame, tau_confidence: float = TAU_CONFIDENCE, tau_similarity: float = TAU_SIMILARITY) -> DataFrame:
    """``rows`` with action, reason, triggered_rule, decided_by."""
    rows = with_policy(with_patterns(rows), taxonomy)
    listed = rules(F.col("never_auto"), F.col("escalation_note"), tau_confidence, tau_similarity)
    rule = F.coalesce(*(F.when(fires, name) for fires, name, _ in listed), F.lit("rules_only"))
    reason = F.coalesce(*(F.when(fires, why) for fires, _, why in listed), F.lit("passed all deterministic rules"))
    rows = rows.withColumn("triggered_rule", rule).withColumn("reason", reason)
    return rows.withColumn("action", F.when(F.col("triggered_rule") == "rules_only", "auto").otherwise("escalate")).withColumn("decided_by", F.lit("rule")).drop("never_auto", "escalation_note", "hard_", "pii_")


def forced_escalation(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``rows`` with forced: a rule that no threshold can move escalates (blank replies are not looked at)."""
    rows = with_policy(with_patterns(rows), taxonomy)
    forced = F.col("hard_").isNotNull() | F.col("pii_").isNotNull() | F.col("never_auto") | ~F.col("ok") | ~F.col("draft_ok") | F.col("truncated")
    forced = forced | (F.size(F.coalesce("grounded_in", F.array().cast("array<string>"))) == 0) | F.col("uncertain")
    return rows.withColumn("forced", forced).drop("never_auto", "escalation_note", "hard_", "pii_")


def pattern_route(rows: DataFrame, message: str = "customer_msg") -> DataFrame:
    """``rows`` with triggered_rule: what the message alone triggers, or rules_only: what routes before any model is asked."""
    rule = F.coalesce("hard_", F.concat(F.lit("pii_"), F.col("pii_")), F.lit("rules_only"))
    return with_patterns(rows, message).withColumn("triggered_rule", rule).drop("hard_", "pii_")
