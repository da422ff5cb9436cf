"""Queries of routing, recorded responses and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import request_key, stable_bucket
from ..operators import agreement, responses
from ..operators import route as R
from ..scratch import saved
from ..sources import io
from . import inputs as I
from .registry import bucket_sql as b
from .registry import first_sql, query, with_

HARD, PII = first_sql("customer_msg", T.HARD), first_sql("customer_msg", T.PII)
RULES = f"""p AS (SELECT *, {HARD} AS hard, {PII} AS pii, intent IN ('c0', 'c3') AS never FROM x),
rt AS (SELECT *, CASE WHEN hard IS NOT NULL THEN hard WHEN pii IS NOT NULL THEN concat('pii_', pii) WHEN never THEN 'never_auto_intent' WHEN NOT ok THEN 'classifier_failure'
  WHEN NOT draft_ok OR trim(reply) = '' THEN 'draft_failure' WHEN truncated THEN 'draft_over_length' WHEN NOT grounded THEN 'draft_ungrounded' WHEN uncertain THEN 'draft_uncertain'
  WHEN max_similarity < 0.3 THEN 'low_retrieval_similarity' WHEN confidence < 0.4 THEN 'low_confidence' ELSE 'rules_only' END AS triggered_rule FROM p)"""
REASON = """CASE triggered_rule WHEN 'never_auto_intent' THEN concat('intent ''', intent, ''' is never auto-handled (', CASE WHEN intent = 'c0' THEN 'account access' ELSE 'policy' END, ')')
  WHEN 'classifier_failure' THEN 'intent classification failed' WHEN 'draft_failure' THEN 'no usable reply was drafted' WHEN 'draft_over_length' THEN 'draft exceeded the length limit and was cut'
  WHEN 'draft_ungrounded' THEN 'draft cites no historical precedent to ground it' WHEN 'draft_uncertain' THEN concat('drafter self-flagged: ', CASE WHEN uncertainty_reason = '' THEN 'drafter flagged low confidence' ELSE uncertainty_reason END)
  WHEN 'low_retrieval_similarity' THEN concat('no similar precedent (best similarity ', printf('%.2f', round(max_similarity, 2)), ' < 0.30)') WHEN 'low_confidence' THEN concat('intent confidence ', printf('%.2f', round(confidence, 2)), ' below 0.40')
  WHEN 'rules_only' THEN 'passed all deterministic rules' ELSE CASE WHEN hard IS NOT NULL THEN concat('message matches ', replace(hard, '_', ' '), ' pattern') ELSE concat('message appears to contain ', replace(pii, '_', ' ')) END END"""
query("r1_route", with_(I.DECISIONS, RULES) + f"SELECT thread_id, CASE WHEN triggered_rule = 'rules_only' THEN 'auto' ELSE 'escalate' END AS action, triggered_rule, {REASON} AS reason, 'rule' AS decided_by FROM rt")(
    lambda spark, d: R.route(I.decisions(spark, d), I.taxonomy(spark), 0.4, 0.3).select("thread_id", "action", "triggered_rule", "reason", "decided_by")
)
query("r2_forced_escalation", with_(I.DECISIONS, RULES) + "SELECT thread_id, hard IS NOT NULL OR pii IS NOT NULL OR never OR NOT ok OR NOT draft_ok OR truncated OR NOT grounded OR uncertain AS forced FROM rt")(
    lambda spark, d: R.forced_escalation(I.decisions(spark, d), I.taxonomy(spark)).select("thread_id", "forced")
)
HIT = with_(I.VECTORS, I.HITS)


def exemplars(spark, d):
    from .vector_plans import hits

    found = hits(spark, d).withColumn("similarity", F.round("similarity", 6))
    threads = found.select("id").distinct().select("id", F.col("id").cast("string").alias("thread_id"), F.concat(F.lit("msg "), F.col("id")).alias("customer_msg"), F.when(F.col("id") % 3 == 0, "please dm us").otherwise("we fixed it").alias("brand_reply"))
    from ..operators.vectors import exemplar_hits

    return responses.ranked_exemplars(exemplar_hits(found, threads))


query("r3_max_similarity", HIT + "SELECT query_id, round(max(similarity), 6) AS value FROM hits GROUP BY query_id")(lambda spark, d: exemplars(spark, d).select("query_id", R.max_similarity(F.col("exemplars")).alias("value")))
query("r9_build_prompts", HIT + """SELECT query_id, concat_ws(chr(10) || chr(10), 'Classify the message and draft a reply.', 'classes', string_agg(concat('E', rank, ' (similarity ', printf('%.2f', round(similarity, 6)), ') customer: msg ', id, ' | reply: ', CASE WHEN id % 3 = 0 THEN 'please dm us' ELSE 'we fixed it' END), chr(10) ORDER BY rank), concat('Message: m', query_id)) AS prompt FROM hits GROUP BY query_id""")(
    lambda spark, d: responses.build_prompts(exemplars(spark, d).withColumn("customer_msg", F.concat(F.lit("m"), F.col("query_id"))), "classes").select("query_id", "prompt")
)


@query("j9_canonical_exemplars", with_(I.OUTPUTS) + "SELECT thread_id, system, CASE WHEN thread_id % 2 = 0 THEN 'agent' ELSE system END AS evidence FROM o WHERE NOT (system = 'agent' AND thread_id % 2 = 1)")
def j9(spark, d):
    rows = I.outputs(spark, d).select("thread_id", "system", F.array(F.col("system")).alias("exemplars")).where("not (system = 'agent' and thread_id % 2 = 1)")
    return agreement.canonical_exemplars(rows).select("thread_id", "system", F.element_at("exemplars", 1).alias("evidence"))


# ---- recorded responses, some of them broken by a stable hash
def recorded(spark, d):
    """doc_id, response: classification, draft and judge fields in one JSON text; 1 in 20 fenced, 1 in 20 broken."""
    docs = I.table(spark, d, "documents").select("doc_id")
    h = lambda p, n: stable_bucket(F.concat(F.lit(p + ":"), F.col("doc_id")), n)
    body = F.to_json(F.struct(
        F.concat(F.lit(" c"), h("i", 13), F.lit(" ")).alias("intent"), (h("conf", 150) / 100).cast("string").alias("confidence"), F.lit("because").alias("rationale"), F.concat(F.lit("c"), h("s", 13), F.lit("\n")).alias("secondary_intent"),
        F.repeat(F.lit("ab "), (h("len", 120) + 0).cast("int")).alias("reply"), F.array(F.lit("E1"), F.lit(" ")).alias("grounded_in"), (h("un", 4) == 0).alias("uncertain"), F.lit("").alias("uncertainty_reason"),
        h("g", 8).cast("string").alias("groundedness"), h("re", 8).cast("string").alias("resolution"), F.lit("x").alias("tone_fit"), h("sa", 8).cast("string").alias("safety"), (h("ws", 2) == 0).alias("would_send"),
        F.lit("fine").alias("justification"), F.array(F.lit("claim")).alias("unsupported_claims"),
    ))
    kind = h("kind", 20)
    return docs.select("doc_id", F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, "not json").otherwise(body).alias("response"))


def hb(p, n):
    return b(f"concat('{p}:', doc_id)", n)


BROKEN = f"{hb('kind', 20)} = 1"


@query("a6_response_table_scan", f"""SELECT sha256(concat('r:', doc_id)) AS key, 'm' AS model, CAST(doc_id AS VARCHAR) AS prompt, {BROKEN} AS broken, CAST({hb('i', 13)} AS DOUBLE) AS created_at FROM documents""")
def a6(spark, d):
    """Recorded responses written as JSON lines and scanned by their declared schema."""
    from .thread_plans import place

    key, at = F.sha2(F.concat(F.lit("r:"), F.col("doc_id")), 256), place(spark, "responses")
    rows = recorded(spark, d).select(key.alias("key"), F.lit("m").alias("model"), F.col("doc_id").cast("string").alias("prompt"), "response", stable_bucket(F.concat(F.lit("i:"), F.col("doc_id")), 13).cast("double").alias("created_at"))
    io.write_json_lines(rows, at)
    return io.read_responses(spark, at).select("key", "model", "prompt", (F.col("response") == "not json").alias("broken"), "created_at")


query("r4_parse_response", f"SELECT doc_id, CASE WHEN NOT ({BROKEN}) THEN concat('c', {hb('i', 13)}) END AS intent FROM documents")(
    lambda spark, d: recorded(spark, d).select("doc_id", F.trim(responses.parse_response(F.col("response"), "intent string", "intent")["intent"]).alias("intent"))
)
query("r5_validate_classification", f"""SELECT doc_id, CASE WHEN NOT ({BROKEN}) AND {hb('i', 13)} < 10 THEN concat('c', {hb('i', 13)}) ELSE 'other' END AS intent,
  CASE WHEN NOT ({BROKEN}) AND {hb('i', 13)} < 10 THEN least(1.0, {hb('conf', 150)} / CAST(100 AS DOUBLE)) ELSE 0.0 END AS confidence,
  CASE WHEN NOT ({BROKEN}) AND {hb('s', 13)} < 10 THEN concat('c', {hb('s', 13)}) ELSE '' END AS secondary_intent, NOT ({BROKEN}) AND {hb('i', 13)} < 10 AS ok,
  CASE WHEN {BROKEN} THEN 'unparseable' WHEN {hb('i', 13)} >= 10 THEN concat('invalid_label:c', {hb('i', 13)}) END AS error FROM documents""")(
    lambda spark, d: responses.validate_classification(recorded(spark, d), I.NAMES).drop("rationale")
)
LEN = f"(CASE WHEN {BROKEN} THEN 0 ELSE greatest(0, 3 * {hb('len', 120)} - 1) END)"
query("r6_validate_draft", f"""SELECT doc_id, CASE WHEN {LEN} > 280 THEN rtrim(substr(repeat('ab ', 120), 1, 280)) ELSE substr(repeat('ab ', 120), 1, {LEN}) END AS reply, {LEN} > 280 AS truncated,
  CASE WHEN {BROKEN} THEN '' ELSE 'E1' END AS grounded_in, NOT ({BROKEN}) AND {hb('un', 4)} = 0 AS uncertain, {LEN} > 0 AS draft_ok FROM documents""")(
    lambda spark, d: responses.validate_draft(recorded(spark, d)).withColumn("grounded_in", F.array_join("grounded_in", ",")).drop("uncertainty_reason")
)


def clamped(p):
    return f"CAST(CASE WHEN doc_id % 10 = 0 OR {BROKEN} THEN 1 ELSE greatest(1, least(5, {hb(p, 8)})) END AS INTEGER)"


query("r7_validate_judge", f"""SELECT doc_id, {clamped('g')} AS groundedness, {clamped('re')} AS resolution, CAST(1 AS INTEGER) AS tone_fit, {clamped('sa')} AS safety, ({clamped('g')} + {clamped('re')} + 1 + {clamped('sa')}) / CAST(4 AS DOUBLE) AS mean_score,
  NOT ({BROKEN}) AND doc_id % 10 <> 0 AND {hb('ws', 2)} = 0 AS would_send, CASE WHEN doc_id % 10 <> 0 THEN 'm' END AS judge_model, doc_id % 10 = 0 OR NOT ({BROKEN}) AS judged FROM documents""")(
    lambda spark, d: responses.validate_judge(recorded(spark, d).withColumn("reply", F.when(F.col("doc_id") % 10 == 0, " ").otherwise("hello")).withColumn("judge_model", F.lit("m"))).drop("reply", "justification", "unsupported_claims")
)


@query("r8_validate_annotation", f"""WITH a AS (SELECT doc_id, CASE WHEN {hb('i', 13)} < 10 THEN concat('c', {hb('i', 13)}) ELSE 'other' END AS intent, CASE {hb('ac', 3)} WHEN 0 THEN 'auto' ELSE 'escalate' END AS said,
  CASE {hb('rs', 3)} WHEN 0 THEN 'none' WHEN 1 THEN 'safety_or_legal' ELSE 'ambiguous_or_underspecified' END AS r, least(3, greatest(1, {hb('cf', 6)})) AS confidence FROM documents),
c AS (SELECT *, CASE WHEN intent IN ('c0', 'c3') THEN 'escalate' ELSE said END AS action FROM a)
SELECT doc_id, intent, action, CASE WHEN action = 'auto' THEN 'none' WHEN r = 'none' THEN 'ambiguous_or_underspecified' ELSE r END AS escalation_reason, CAST(confidence AS INTEGER) AS confidence, 'n' AS note FROM c""")
def r8(spark, d):
    h = lambda p, n: stable_bucket(F.concat(F.lit(p + ":"), F.col("doc_id")), n)
    pick = lambda p, *values: F.element_at(F.array(*map(F.lit, values)), (h(p, len(values)) + 1).cast("int"))
    rows = I.table(spark, d, "documents").select("doc_id", F.concat(F.lit("c"), h("i", 13)).alias("intent"), pick("ac", "auto", "escalate", "maybe").alias("action"), pick("rs", "none", "safety_or_legal", "unknown").alias("escalation_reason"), h("cf", 6).cast("string").alias("confidence"), F.lit("n").alias("note"))
    return responses.validate_annotation(rows, I.NAMES, I.NEVER_AUTO)


@query("j12_resolve_responses", f"SELECT doc_id AS request_id, CASE WHEN {hb('a', 3)} = 0 THEN 'first' WHEN {hb('b', 3)} = 0 THEN 'second' END AS provider FROM documents")
def j12(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id")
    key = lambda p: request_key({"provider": F.lit(p), "prompt": F.col("doc_id").cast("string"), "model": F.lit("m")})
    requests = docs.select(F.col("doc_id").alias("request_id"), F.array(F.struct(F.lit("first").alias("provider"), key("first").alias("key")), F.struct(F.lit("second").alias("provider"), key("second").alias("key"))).alias("chain"))
    h = lambda p: stable_bucket(F.concat(F.lit(p + ":"), F.col("doc_id")), 3)
    known = docs.where(h("a") == 0).select(key("first").alias("key")).unionByName(docs.where(h("b") == 0).select(key("second").alias("key"))).withColumn("response", F.lit("{}"))
    return responses.resolve_responses(requests, responses.response_table(known)).select("request_id", "provider")


@query("r10_agent_pipeline", HIT.rstrip() + f""", doc AS (SELECT doc_id, coalesce(text, '') AS customer_msg, s FROM documents JOIN (SELECT query_id AS doc_id, max(similarity) AS s FROM hits GROUP BY 1) USING (doc_id)),
g AS (SELECT doc_id, s, {HARD} AS hard, {PII} AS pii, CASE WHEN NOT ({BROKEN}) AND {hb('i', 13)} < 10 THEN concat('c', {hb('i', 13)}) ELSE 'other' END AS intent, NOT ({BROKEN}) AND {hb('i', 13)} < 10 AS ok, least(1.0, {hb('conf', 150)} / 100.0) AS confidence, {LEN} AS n, {BROKEN} AS broken, {hb('un', 4)} = 0 AS un FROM doc)
SELECT doc_id AS thread_id, s.system, CASE WHEN hard IS NOT NULL THEN hard WHEN pii IS NOT NULL THEN concat('pii_', pii) WHEN intent IN ('c0', 'c3') THEN 'never_auto_intent' WHEN NOT ok THEN 'classifier_failure' WHEN n = 0 THEN 'draft_failure' WHEN n > 280 THEN 'draft_over_length' WHEN broken THEN 'draft_ungrounded' WHEN un THEN 'draft_uncertain'
  WHEN (CASE WHEN s.system = 'agent' THEN round(g.s, 6) ELSE 0.0 END) < 0.3 THEN 'low_retrieval_similarity' WHEN confidence < 0.4 THEN 'low_confidence' ELSE 'rules_only' END AS triggered_rule FROM g CROSS JOIN (VALUES ('agent'), ('no_retrieval')) s(system)""")
def r10(spark, d):
    """Retrieve, resolve along two providers, validate and route whole documents; the ablation is the same plan with an empty exemplar array."""
    found = exemplars(spark, d).select(F.col("query_id").alias("doc_id"), "exemplars")
    # written, for requests, responses and answers all start from these rows, and the search would run for each
    asked = saved(I.pool_documents(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("customer_msg")).join(found, "doc_id"), "asked")
    key = lambda p: request_key({"provider": F.lit(p), "prompt": F.col("doc_id").cast("string"), "model": F.lit("m")})
    answers = recorded(spark, d).join(asked.select("doc_id"), "doc_id", "left_semi")
    known = answers.select(request_key({"provider": F.when(stable_bucket(F.concat(F.lit("a:"), F.col("doc_id")), 3) == 0, "first").otherwise("second"), "prompt": F.col("doc_id").cast("string"), "model": F.lit("m")}).alias("key"), "response")
    requests = asked.select(F.col("doc_id").alias("request_id"), F.array(*(F.struct(F.lit(p).alias("provider"), key(p).alias("key")) for p in ("first", "second"))).alias("chain"))
    resolved = responses.require_all(responses.resolve_responses(requests, responses.response_table(known))).select(F.col("request_id").alias("doc_id"), "response")
    answered = saved(responses.with_parsed(asked.join(resolved, "doc_id")).drop("response"), "answered")  # one parse for all validators
    both = answered.withColumn("system", F.lit("agent")).unionByName(answered.withColumn("exemplars", F.slice("exemplars", 1, 0)).withColumn("system", F.lit("no_retrieval")))
    rows = both.withColumn("draft", F.col("parsed"))
    rows = responses.validate_draft(responses.validate_classification(rows, I.NAMES, "parsed"), "draft")
    rows = rows.withColumn("max_similarity", R.max_similarity(F.col("exemplars")))
    return R.route(rows, I.taxonomy(spark), 0.4, 0.3).select(F.col("doc_id").alias("thread_id"), "system", "triggered_rule")
