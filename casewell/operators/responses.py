"""Prompts out, recorded responses in: keys, resolution along a provider chain, parsing and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..scratch import bucketed

# The reasons an annotator may give.
REASONS = [
    "none", "needs_account_access", "angry_or_distressed", "policy_exception_or_refund", "safety_or_legal",
    "ambiguous_or_underspecified", "novel_no_precedent", "contains_personal_data", "multi_intent",
]


def response_table(responses: DataFrame, buckets: int | None = None) -> DataFrame:
    """key, response of recorded responses in a table dealt to buckets by key, so that requests come to them and they
    stay where they are."""
    n = buckets or int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(responses.select("key", "response").dropDuplicates(["key"]), "key", n, "responses")


def resolve_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """request_id, provider, response of the first provider in each request's chain that has a recorded response.
    requests: request_id, chain (array of struct(provider, key)) in order; misses have nulls. A ``response_table`` is not
    moved, other responses are shuffled by key."""
    tries = requests.select("request_id", F.posexplode_outer("chain").alias("place", "try")).select("request_id", "place", "try.provider", "try.key")
    known = responses.select("key", "response").dropDuplicates(["key"])
    ranked = tries.join(known, "key", "left").withColumn("hit", F.col("response").isNotNull())
    first = ranked.groupBy("request_id").agg(F.min_by(F.struct("provider", "response", "hit"), F.struct(~F.col("hit"), "place")).alias("x"))
    return first.select("request_id", F.when(F.col("x.hit"), F.col("x.provider")).alias("provider"), F.col("x.response").alias("response"))


def require_all(resolved: DataFrame) -> DataFrame:
    """Replay: a request without a response raises when the rows are read."""
    missing = F.raise_error(F.concat(F.lit("no recorded response for "), F.col("request_id").cast("string")))
    return resolved.withColumn("response", F.when(F.col("response").isNull(), missing).otherwise(F.col("response")))


def hit_counts(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count("response").alias("hits"), F.count_if(F.col("response").isNull()).alias("misses"))


def unfenced(response: Column) -> Column:
    """The response without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.trim(response), r"^```[A-Za-z]*\s*|\s*```$", ""))


def with_parsed(rows: DataFrame, response: str = "response", name: str = "parsed") -> DataFrame:
    """``rows`` with the response as one VARIANT, null where it is no JSON: every validator can read that column."""
    return rows.withColumn(name, F.try_parse_json(unfenced(F.col(response))))


def _parsed(rows: DataFrame, response: str) -> DataFrame:
    """``rows`` with parsed_: the response, parsed here unless it is a VARIANT already."""
    if dict(rows.dtypes)[response] == "variant":
        return rows.withColumn("parsed_", F.col(response))
    return with_parsed(rows, response, "parsed_")


def fields(parsed: Column, schema: str, marker: str | None = None) -> Column:
    """The fields of a VARIANT as a struct of ``schema``; a field of another type is null and spoils no other. Null where
    the response is no object. ``marker`` is a field that must be there."""
    listed = [f.split(" ", 1) for f in schema.split(", ")]
    row = F.struct(*(F.try_variant_get(parsed, f"$.{name}", kind).alias(name) for name, kind in listed))
    there = F.lit(True) if marker is None else F.try_variant_get(parsed, f"$.{marker}", dict(listed)[marker]).isNotNull()
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT") & there, row)


def parse_response(response: Column, schema: str, marker: str | None = None) -> Column:
    """The response as a struct of ``schema``; null where it is no JSON object. ``marker`` is a field that must be there."""
    return fields(F.try_parse_json(unfenced(response)), schema, marker)


def clamp(value: Column, low, high) -> Column:
    """The value within bounds; null stays null (least and greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def validate_classification(rows: DataFrame, names: list[str], response: str = "response") -> DataFrame:
    """intent, confidence, rationale, secondary_intent, ok, error. Labels are trimmed; unknown and missing ones become ``other`` with confidence 0."""
    keep, rows = [c for c in rows.columns if c != response], _parsed(rows, response)
    p = fields(F.col("parsed_"), schemas.CLASSIFICATION)
    intent, second = (F.regexp_replace(F.coalesce(p[c], F.lit("")), r"(?U)^\s+|\s+$", "") for c in ("intent", "secondary_intent"))
    known = p.isNotNull() & intent.isin(names)
    confidence = F.coalesce(clamp(p["confidence"].try_cast("double"), 0.0, 1.0), F.lit(0.0))
    return rows.select(
        *keep,
        F.when(known, intent).otherwise("other").alias("intent"),
        F.when(known, confidence).otherwise(0.0).alias("confidence"),
        F.substring(F.coalesce(p["rationale"], F.lit("")), 1, 300).alias("rationale"),
        F.when(second.isin(names), second).otherwise("").alias("secondary_intent"),
        F.coalesce(known, F.lit(False)).alias("ok"),
        F.when(p.isNull(), "unparseable").when(~known, F.concat(F.lit("invalid_label:"), intent)).alias("error"),
    )


def validate_draft(rows: DataFrame, response: str = "response", most: int = 280) -> DataFrame:
    """reply, truncated, grounded_in (blank citations dropped), uncertain, uncertainty_reason, draft_ok."""
    keep, rows = [c for c in rows.columns if c != response], _parsed(rows, response)
    p = fields(F.col("parsed_"), schemas.DRAFT, "reply")
    reply = F.trim(F.coalesce(p["reply"], F.lit("")))
    long = F.length(reply) > most
    cited = F.filter(F.coalesce(p["grounded_in"], F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return rows.select(
        *keep,
        F.when(long, F.rtrim(F.substring(reply, 1, most))).otherwise(reply).alias("reply"), long.alias("truncated"), cited.alias("grounded_in"),
        F.coalesce(p["uncertain"], F.lit(False)).alias("uncertain"), F.coalesce(p["uncertainty_reason"], F.lit("")).alias("uncertainty_reason"), (F.length(reply) > 0).alias("draft_ok"),
    )


def validate_judge(rows: DataFrame, reply: str = "reply", response: str = "response", model: str = "judge_model") -> DataFrame:
    """Scores clamped to 1..5 (unreadable: 1), their mean, the gate. An empty reply is all ones, not sendable, with no model."""
    keep, rows = [c for c in rows.columns if c not in (response, model)], _parsed(rows, response)
    p = fields(F.col("parsed_"), schemas.JUDGE, "would_send")
    empty = F.trim(F.coalesce(F.col(reply), F.lit(""))) == ""
    score = {d: F.when(empty, 1).otherwise(F.coalesce(clamp(p[d].try_cast("double").cast("int"), 1, 5), F.lit(1))) for d in ("groundedness", "resolution", "tone_fit", "safety")}
    claims = F.transform(F.slice(F.coalesce(p["unsupported_claims"], F.array().cast("array<string>")), 1, 5), lambda x: F.substring(x, 1, 200))
    return rows.select(
        *keep, *(v.cast("int").alias(d) for d, v in score.items()),
        (sum(score.values(), F.lit(0)) / 4).alias("mean_score"),
        F.when(empty, False).otherwise(F.coalesce(p["would_send"], F.lit(False))).alias("would_send"),
        F.substring(F.coalesce(p["justification"], F.lit("")), 1, 400).alias("justification"), claims.alias("unsupported_claims"),
        F.when(~empty, F.col(model)).alias(model), (empty | p.isNotNull()).alias("judged"),
    )


def validate_annotation(rows: DataFrame, names: list[str], never_auto: list[str], reasons: list[str] = REASONS) -> DataFrame:
    """Second-pass labels made consistent; rows: intent, action, escalation_reason, confidence (text), note."""
    intent = F.when(F.col("intent").isin(names), F.col("intent")).otherwise("other")
    said = F.when(F.col("action").isin("auto", "escalate"), F.col("action")).otherwise("escalate")
    action = F.when(intent.isin(never_auto), "escalate").otherwise(said)
    reason = F.when(F.col("escalation_reason").isin(reasons), F.col("escalation_reason")).otherwise("ambiguous_or_underspecified")
    reason = F.when(action == "auto", "none").when(reason == "none", "ambiguous_or_underspecified").otherwise(reason)
    confidence = clamp(F.coalesce(F.col("confidence").try_cast("double").cast("int"), F.lit(2)), 1, 3)
    keep = [c for c in rows.columns if c not in ("intent", "action", "escalation_reason", "confidence", "note")]
    return rows.select(*keep, intent.alias("intent"), action.alias("action"), reason.alias("escalation_reason"), confidence.cast("int").alias("confidence"), F.substring(F.coalesce("note", F.lit("")), 1, 300).alias("note"))


def build_prompts(rows: DataFrame, taxonomy_block: str, head: str = "Classify the message and draft a reply.") -> DataFrame:
    """``rows`` with prompt: instructions, classes, numbered precedents and the message."""
    lines = F.transform("exemplars", lambda e, i: F.format_string("E%d (similarity %s) customer: %s | reply: %s", i + 1, F.call_function("format_number", e["similarity"], F.lit("0.00")), e["customer_msg"], e["brand_reply"]))
    shown = F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("(no precedent)"))
    return rows.withColumn("prompt", F.concat_ws("\n\n", F.lit(head), F.lit(taxonomy_block), shown, F.concat(F.lit("Message: "), F.col("customer_msg"))))


def ranked_exemplars(hits: DataFrame, k: int = 5) -> DataFrame:
    """query_id, exemplars: the hits of a query as an array in rank order (at most k, so bounded)."""
    kept = hits.where(F.col("rank") <= k)
    arr = F.array_sort(F.collect_list(F.struct("rank", "thread_id", "customer_msg", "brand_reply", "similarity", "is_deflection")))
    return kept.groupBy("query_id").agg(F.transform(arr, lambda e: F.struct(e["thread_id"].alias("thread_id"), e["customer_msg"].alias("customer_msg"), e["brand_reply"].alias("brand_reply"), e["similarity"].alias("similarity"), e["is_deflection"].alias("is_deflection"))).alias("exemplars"))

