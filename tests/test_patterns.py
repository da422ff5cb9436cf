"""The prefilter of patterns, and the functions registered for SQL."""

import random

import pytest
from pyspark.sql import functions as F

from casewell.functions import prefilter, sql
from casewell.functions import text as T

LISTED = [*T.PII, *T.HARD, *T.DEFECTS, ("rage", T.RAGE), ("multi_intent", T.MULTI_INTENT)]


@pytest.mark.parametrize(
    "pattern, want",
    [(r"\b(lawyer|sue)\b", {"lawyer", "sue"}), (r"ab?c", {"a"}), (r"x*", None), (r"\d{3}-?", {"\\d"}), (r"(?:a|b*)", None), (r"!{3,}", {"!!!"}), (r"\p{Lu}", None), (r"colou?r", {"colo"})],
)
def test_strings_that_every_match_holds(pattern, want):
    got = prefilter.required(pattern)
    assert (set(got) if got else None) == want


def test_prefiltered_matches_equal_plain_ones(spark, sf):
    random.seed(3)
    bits = ["lawyer", "ſue", "SUE", "hospİtal", "dıed", "poisoned", "on fire", "fire risk", "K", "5500 0055 5555 5559", "a.b@c.org", "12 Old Mill Road", "١٢٣ ٤٥٦ ٧٨٩٠", "[order id]", "{name}", "TODO", "XXX",
            "will call you", "within 3 days", "escalated internally", "share the order number", "wtf", "!!!", "and also", "Unauthorised", "someone else used", "burnt my hand", "self harm", "123-1234567-1234567", "x", " ", "\n", "-"]
    texts = [" ".join(random.choice(bits) for _ in range(random.randint(1, 5))) for _ in range(600)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    folded = prefilter.fold(T.filled(F.col("text")))
    tests = [F.count_if(T.filled(F.col("text")).rlike(T.any_case(p)) != T.matches(F.col("text"), p, folded)).alias(n) for n, p in LISTED]
    hits = [F.count_if(T.filled(F.col("text")).rlike(T.any_case(p))).alias(n) for n, p in LISTED]
    assert set(rows.agg(*tests).first()) == {0} and min(rows.agg(*hits).first()) > 0


def test_routing_runs_each_pattern_once(spark):
    from casewell.operators.route import pattern_route

    rows = spark.createDataFrame([("call my lawyer",)], "customer_msg string").repartition(2)
    plan = pattern_route(rows)._jdf.queryExecution().optimizedPlan().toString()
    for _, p in [*T.PII, *T.HARD]:
        assert plan.count(f"(?iU){p[:25]}") <= 1
    assert pattern_route(rows).first().triggered_rule == "legal_or_press"


def test_functions_are_known_to_sql(spark, sf):
    names = sql.register(spark)
    spark.read.parquet(f"{sf}/documents.parquet").createOrReplaceTempView("docs_for_sql")
    got = spark.sql("SELECT doc_id, match_pii(text) AS p, match_hard_escalation(text) AS h, dedupe_key(text) AS d, stable_bucket(CAST(doc_id AS STRING), 100) AS b, defect_names(text) AS f FROM docs_for_sql")
    from casewell.functions.hashing import stable_bucket

    t = F.col("text")
    want = spark.table("docs_for_sql").select("doc_id", T.match_pii(t).alias("p"), T.match_hard_escalation(t).alias("h"), T.dedupe_key(t).alias("d"), stable_bucket(F.col("doc_id").cast("string"), 100).alias("b"), T.draft_defects(t).alias("f"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want) and len(names) == 6
    rows = spark.sql("SELECT x.id, d.defect FROM VALUES (1, 'I will call you within 3 days [order id]'), (2, 'fine') AS x(id, reply), LATERAL draft_defects(x.reply) d").collect()
    assert {(r.id, r.defect) for r in rows} == {(1, "unfilled_placeholder"), (1, "unsupported_time_commitment")}
    sql.register(spark, hard=[("own", "zebra's")])
    assert spark.sql("SELECT match_hard_escalation('a ZEBRA''s tail') AS h").first().h == "own"
    sql.register(spark)
