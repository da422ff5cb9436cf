import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casewell.operators import metrics as M, responses as RS, route as R
from casewell.plans import inputs
from casewell.sources import io

GOOD = dict(thread_id=1, customer_msg="where is my parcel", intent="c1", confidence=0.95, ok=True, draft_ok=True, reply="hello", truncated=False, grounded_in=["E1"], uncertain=False, uncertainty_reason="", max_similarity=0.9)
SCHEMA = "thread_id long, customer_msg string, intent string, confidence double, ok boolean, draft_ok boolean, reply string, truncated boolean, grounded_in array<string>, uncertain boolean, uncertainty_reason string, max_similarity double"


def routed(spark, **change):
    rows = spark.createDataFrame([tuple((GOOD | change).values())], SCHEMA)
    return R.route(rows, inputs.taxonomy(spark)).first()


@pytest.mark.parametrize("change, rule", [
    ({}, "rules_only"), ({"customer_msg": "the profile looks compromised"}, "account_compromise"), ({"customer_msg": "number 5500 0055 5555 5559 on the front"}, "pii_payment_card"),
    ({"intent": "c0"}, "never_auto_intent"), ({"ok": False}, "classifier_failure"), ({"reply": "  "}, "draft_failure"), ({"truncated": True}, "draft_over_length"),
    ({"grounded_in": []}, "draft_ungrounded"), ({"uncertain": True}, "draft_uncertain"), ({"max_similarity": 0.5}, "low_retrieval_similarity"), ({"confidence": 0.5}, "low_confidence"),
])
def test_first_rule_decides(spark, change, rule):
    got = routed(spark, **change)
    assert got.triggered_rule == rule and got.action == ("auto" if rule == "rules_only" else "escalate")


def test_forced_ignores_blank_replies(spark):
    rows = spark.createDataFrame([tuple((GOOD | {"reply": " "}).values())], SCHEMA)
    assert not R.forced_escalation(rows, inputs.taxonomy(spark)).first().forced


def test_harm_is_a_share_of_what_was_sent(spark):
    gold = ["auto"] * 5 + ["escalate"] * 3
    rows = lambda acts: spark.createDataFrame(list(zip(gold, acts)), "gold_action string, action string")
    mixed = M.routing_scores(rows(["auto"] * 3 + ["escalate"] * 2 + ["auto", "escalate", "auto"])).first()
    assert mixed.coverage == 5 / 8 and mixed.false_auto_rate == 2 / 5
    none = M.routing_scores(rows(["escalate"] * 8)).first()
    assert none.coverage == 0 and none.false_auto_rate == 0


def test_forced_rows_are_never_sent(spark):
    rows = spark.createDataFrame([(1.0, False, "auto"), (1.0, True, "auto")], "score double, forced boolean, gold_action string")
    assert M.coverage_curve(rows).where("threshold = 0").first().n_auto == 1


def test_kappa_numbers_and_nan(spark):
    k = lambda pairs, w=False: M.kappa(spark.createDataFrame(pairs, "a int, b int"), weighted=w).first().kappa
    assert abs(k([(1, 1), (2, 2), (3, 3), (1, 2)]) - 0.6363636) < 1e-6
    assert 0 < k([(1, 1), (2, 3), (5, 5), (4, 4)], True) < 1
    assert math.isnan(k([(1, 1), (1, 1)]))


def test_spearman_guards(spark):
    rho = lambda pairs: M.spearman(spark.createDataFrame(pairs, "a int, b int")).first().rho
    assert abs(rho([(1, 2), (2, 4), (3, 6)]) - 1) < 1e-9 and rho([(1, 1), (1, 2), (1, 3)]) is None and rho([(1, 1), (2, 2)]) is None


def test_missing_prediction_raises(spark):
    gold, pred = spark.createDataFrame([(1, "x"), (2, "y")], "id int, gold string"), spark.createDataFrame([(1, "x")], "id int, pred string")
    with pytest.raises(PySparkException):
        M.gold_vs_pred(gold, pred, "id", ["gold", "pred"]).collect()


def test_majority_class_of_nothing(spark):
    assert M.majority_class(spark.createDataFrame([], "label string, id int"), "label", "id").first().label == "other"


def test_replay_misses_raise(spark):
    requests = spark.createDataFrame([(1, [("p", "k1"), ("q", "k2")])], "request_id int, chain array<struct<provider:string,key:string>>")
    known = spark.createDataFrame([("k2", "{}"), ("k9", "{}")], "key string, response string")
    assert RS.resolve_responses(requests, known).first().provider == "q"
    empty = RS.resolve_responses(requests, known.where("key = 'k9'"))
    assert RS.hit_counts(empty).first().misses == 1
    with pytest.raises(PySparkException):
        RS.require_all(empty).collect()


def test_labels_are_trimmed_and_missing_ones_named(spark):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate([
        '{"intent": " c1 ", "confidence": 3, "secondary_intent": "c2\\n"}', '{"confidence": 0.5}', '{"intent": "zz", "confidence": 0.5}', "no json", '```json\n{"intent": "c2", "confidence": "x"}\n```', None,
    ])], "id int, response string")
    got = [(r.intent, r.confidence, r.secondary_intent, r.ok, r.error) for r in RS.validate_classification(rows, ["c1", "c2", "other"]).orderBy("id").collect()]
    assert got == [("c1", 1.0, "c2", True, None), ("other", 0.0, "", False, "invalid_label:"), ("other", 0.0, "", False, "invalid_label:zz"), ("other", 0.0, "", False, "unparseable"), ("c2", 0.0, "", True, None), ("other", 0.0, "", False, "unparseable")]


def test_patterns_run_once_a_row(spark):
    plan = R.route(spark.createDataFrame([tuple(GOOD.values())], SCHEMA), inputs.taxonomy(spark))._jdf.queryExecution().optimizedPlan().toString()
    digits = plan.count(", (?U)\\d)")  # asked before the patterns that need a digit
    assert plan.count("RLIKE") + plan.count("rlike") - digits == 9 and digits <= 2


def test_taxonomy_checks(spark):
    with pytest.raises(ValueError):
        io.taxonomy_dim(spark.createDataFrame([("a",), ("a",), ("other",)], "name string"))
    with pytest.raises(ValueError):
        io.taxonomy_dim(spark.createDataFrame([("a",)], "name string"))


def test_csv_log_and_blank_lines(spark, tmp_path):
    (tmp_path / "log.csv").write_text("tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n2,Brand,False,now,\"a, b\nc\",,1.0\n1,u,True,now,hi,2,\n")
    rows = {r.id: r for r in io.read_message_log(spark, str(tmp_path / "log.csv")).collect()}
    assert rows[2].parent == 1 and not rows[2].inbound and rows[1].parent is None and rows[2].text == "a, b\nc"
    (tmp_path / "x.json").write_text('{"thread_id": "1"}\n\n{"thread_id": "2"}\n')
    assert io.read_json_lines(spark, str(tmp_path / "x.json"), "thread_id string").where(F.col("thread_id").isNotNull()).count() == 2


def test_message_log_on_single_lines_can_be_split(spark, tmp_path):
    from casewell.sources import io

    texts = ["a, \"b\"\nc", "back\\slash\\n", "cr\r\nlf", "  spaces  ", "\\\\x", "ünï"]
    rows = spark.createDataFrame([(i, "u", True, i - 1 if i else None, "t", t) for i, t in enumerate(texts)], "id long, author string, inbound boolean, parent long, created_at string, text string")
    for one_line in (True, False):
        folder = str(tmp_path / f"log-{one_line}")
        io.write_message_log(rows.coalesce(1), folder, one_line)
        got = io.read_message_log(spark, folder, multi_line=not one_line)
        assert {r.id: r.text for r in got.collect()} == dict(enumerate(texts)) and {r.id: r.parent for r in got.collect()} == {0: None, **{i: i - 1 for i in range(1, 6)}}
    plan = io.scan_structure(io.read_message_log(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "created_at" not in plan[plan.index("ReadSchema") :]
