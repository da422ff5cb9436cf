from pyspark.sql import functions as F

from casewell.functions import hashing, text as T


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_normalise(spark):
    got = one(spark, T.normalise, "@LampStore2 the blue kettle LEAKS?? photo at www.example.org/k @40917 ASAP")
    assert got == "the blue kettle LEAKS?? photo at <URL> ASAP"
    assert one(spark, T.normalise, "ﬁne  &amp; ① @Ünï") == "fine & 1"
    assert one(spark, T.normalise, None) == ""


def test_threads_compose_compatibility_forms(spark):
    """NFKC, which the other engine lacks: ligatures, circled digits and full-width letters become plain ones."""
    from casewell.operators import threads

    log = [(1, "u1", True, None, "t0", "ﬁve ① ＡＢＣ lamps are here"), (2, "Brand0", False, 1, "t1", "ｔｈａｎｋｓ ﬂora")]
    rows = threads.build_threads(spark.createDataFrame(log, "id long, author string, inbound boolean, parent long, created_at string, text string"), ["brand0"]).collect()
    assert [(r.customer_msg, [x.text for x in r.brand_replies]) for r in rows] == [("five 1 ABC lamps are here", ["thanks flora"])]


def test_names_carried_over(spark):
    def found(reply, *precedents):
        rows = spark.createDataFrame([(reply, [(p,) for p in precedents])], "reply string, e array<struct<brand_reply:string>>")
        return rows.select(T.carried_over_name(F.col("reply"), F.col("e")).alias("x")).first().x

    assert found("Dear Selma, it ships today", "Dear Selma, thanks") == "Selma"
    assert found("dear selma, it ships today", "ask selma about it") == "selma" and found("dear selma, it ships", "Selma, thanks") is None
    assert found("Hello there, we apologise, sorry, Selma! ", "Selma is here") is None  # the greeting decides: no name
    assert found("Your lamp is late, sorry about it, Selma!", "Selma is here") == "Selma"
    assert found("Dear Selma, hi", "Selmas lamp") is None and found("Good day", "Good day") is None and found(None) is None


def test_bucket_is_pinned(spark):
    assert one(spark, lambda c: hashing.stable_bucket(c, 100), "thread-123") == 43


def test_dedupe_key(spark):
    key = lambda v: one(spark, T.dedupe_key, v)
    assert key("Kettle, blue: (2 pcs)") == key("kettle blue 2 pcs") and key("blue kettle") != key("blue kettles")


def test_deflection_and_handoff(spark):
    assert one(spark, T.is_deflection, "Please DM us your details") and one(spark, T.is_deflection, "send us a note")
    assert not one(spark, T.is_deflection, "Your parcel arrives tomorrow")
    assert one(spark, T.is_link_handoff, "contact us at <URL>") and not one(spark, T.is_link_handoff, "see <URL>")
    assert one(spark, T.is_handoff, "pm us")


def test_hard_patterns_both_ways(spark):
    for benign in ("a fireside chair", "is the wood fire pit in stock", "my ears burn when i sing", "fireproof gloves in red"):
        assert one(spark, T.match_hard_escalation, benign) is None
    for harmful in ("the toaster catches fire", "this cable is a fire risk", "the iron burnt her arm", "the stove set the curtain alight", "a spark started a fire", "kettle bursting into flames", "lamp on fire now"):
        assert one(spark, T.match_hard_escalation, harmful) == "safety_or_harm"
    assert one(spark, T.match_hard_escalation, "somebody has compromised our profile since may") == "account_compromise"


def test_pii_in_order(spark):
    assert one(spark, T.match_pii, "the number is 5500 0055 5555 5559 on the front") == "payment_card"
    assert one(spark, T.match_pii, "mail me at a.b@c.org") == "email_address"
    assert one(spark, T.match_pii, "I live at 12 Old Mill Road") == "postal_address"
    assert one(spark, T.match_pii, "order 111-1234567-1234567") in ("payment_card", "order_id")
    assert one(spark, T.match_pii, "") is None


def test_tags_and_defects(spark):
    tags = one(spark, T.adversarial_tags, "WHY IS THIS BROKEN?? WORST EVER!!! 😀😀😀 thanks a lot")
    assert tags == ["all_caps", "emoji_heavy", "multi_question", "rage_markers", "sarcasm_marker"]
    assert one(spark, T.adversarial_tags, "hm") == ["very_short"]
    assert one(spark, T.draft_defects, "[URL] ok") == [] and one(spark, T.draft_defects, "Hi [Customer Name]") == ["unfilled_placeholder"]


def test_language(spark):
    assert one(spark, T.is_probably_english, "where is my order please it was not here")
    assert not one(spark, T.is_probably_english, "wo ist mein paket und ich habe nicht die nummer")
    assert one(spark, T.is_probably_english, "u said the parcel would get here on monday")
    assert one(spark, T.latin_ratio, "") == 0.0 and not one(spark, T.is_usable, "short")


def test_zero_vector_and_grams(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>").select(T.l2_normalise(F.col("v")).alias("v")).collect()
    assert rows[0].v == [0.0, 0.0] and abs(rows[1].v[0] - 0.6) < 1e-9
    assert one(spark, T.char_wb_ngrams, "ab") == [" ab", "ab ", " ab "] and one(spark, T.char_wb_ngrams, "a") == [" a "]
