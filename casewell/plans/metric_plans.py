"""Queries of evaluation measures, agreement and failure analysis over derived outputs and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import bootstrap as BS
from ..operators import failures as FA
from ..operators import metrics as M
from ..operators import models
from ..scratch import saved
from . import inputs as I
from .registry import bucket_sql, query, with_

O = I.OUTPUTS
AG = "a AS (SELECT * FROM o WHERE system = 'agent')"


def agent(spark, d):
    return I.outputs(spark, d).where("system = 'agent'")


def rounded(df, *keep):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def per_class(by="", src="o"):
    g, on = (f"{by}, ", f"{by}") if by else ("", "")
    return f"""l AS (SELECT DISTINCT {g}gold AS label FROM {src} UNION SELECT DISTINCT {g}pred FROM {src}),
pc AS (SELECT {'l.' + by + ', ' if by else ''}l.label, count(*) FILTER (x.gold = l.label AND x.pred = l.label) AS tp, count(*) FILTER (x.gold = l.label) AS support, count(*) FILTER (x.pred = l.label) AS called
  FROM l JOIN {src} x ON {'l.' + by + ' = x.' + by + ' AND ' if by else ''}(x.gold = l.label OR x.pred = l.label) GROUP BY ALL),
pr AS (SELECT {g}label, coalesce(tp / nullif(CAST(called AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0) AS recall,
  coalesce(2 * tp / nullif(CAST(called + support AS DOUBLE), 0), 0) AS f1, support FROM pc)"""


query("g5_intent_scores", with_(O, per_class("system")) + "SELECT system, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, (SELECT round(avg(f1), 6) FROM pr WHERE pr.system = o.system) AS macro_f1 FROM o GROUP BY system")(
    lambda spark, d: rounded(M.intent_scores(I.outputs(spark, d), ["system"]))
)
query("g6_per_class_report", with_(O, AG, per_class("", "a")) + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pr")(
    lambda spark, d: rounded(M.per_class_report(agent(spark, d)))
)
query("g7_confusion_matrix", with_(O, AG, "l AS (SELECT gold AS label FROM a UNION SELECT pred FROM a)") + "SELECT x.label AS gold, y.label AS pred, (SELECT count(*) FROM a WHERE gold = x.label AND pred = y.label) AS n FROM l x CROSS JOIN l y")(
    lambda spark, d: M.confusion_matrix(agent(spark, d))
)
ROUTING = """count(*) AS n, round(avg(CASE WHEN action = 'auto' THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  round(coalesce(count(*) FILTER (action = 'auto' AND gold_action = 'escalate') / nullif(CAST(count(*) FILTER (action = 'auto') AS DOUBLE), 0), 0), 6) AS false_auto_rate,
  round(coalesce(count(*) FILTER (action = 'auto' AND gold_action = 'escalate') / nullif(CAST(count(*) FILTER (gold_action = 'escalate') AS DOUBLE), 0), 0), 6) AS escalation_miss_rate,
  round(coalesce(count(*) FILTER (action <> 'auto' AND gold_action = 'escalate') / nullif(CAST(count(*) FILTER (action <> 'auto') AS DOUBLE), 0), 0), 6) AS precision,
  round(coalesce(count(*) FILTER (action <> 'auto' AND gold_action = 'escalate') / nullif(CAST(count(*) FILTER (gold_action = 'escalate') AS DOUBLE), 0), 0), 6) AS recall,
  count(*) FILTER (action <> 'auto' AND gold_action = 'escalate') AS tp, count(*) FILTER (action <> 'auto' AND gold_action <> 'escalate') AS fp,
  count(*) FILTER (action = 'auto' AND gold_action = 'escalate') AS fn, count(*) FILTER (action = 'auto' AND gold_action <> 'escalate') AS tn"""
query("g8_routing_scores", with_(O) + f"SELECT system, {ROUTING} FROM o GROUP BY system")(lambda spark, d: rounded(M.routing_scores(I.outputs(spark, d), ["system"])))


def curve(score, name="c"):
    return f"""{name} AS (SELECT t / CAST(40 AS DOUBLE) AS threshold, count(*) FILTER (NOT forced AND {score} >= t / CAST(40 AS DOUBLE)) / CAST(count(*) AS DOUBLE) AS coverage,
  coalesce(count(*) FILTER (NOT forced AND {score} >= t / CAST(40 AS DOUBLE) AND gold_action = 'escalate') / nullif(CAST(count(*) FILTER (NOT forced AND {score} >= t / CAST(40 AS DOUBLE)) AS DOUBLE), 0), 0) AS false_auto_rate,
  count(*) FILTER (NOT forced AND {score} >= t / CAST(40 AS DOUBLE)) AS n_auto FROM a CROSS JOIN range(0, 41) g(t) GROUP BY t)"""


CURVE = with_(O, AG, curve("confidence"))
CURVED = "SELECT threshold, round(coverage, 6) AS coverage, round(false_auto_rate, 6) AS false_auto_rate, n_auto FROM c"
for key in ("g9_coverage_curve", "w9_cumulative_curve"):
    query(key, CURVE + CURVED)(lambda spark, d: rounded(M.coverage_curve(agent(spark, d), "confidence")))
query("g10_best_threshold", CURVE + CURVED + " WHERE n_auto > 0 AND c.false_auto_rate <= 0.4 ORDER BY c.coverage DESC, threshold LIMIT 1")(
    lambda spark, d: rounded(M.best_threshold(M.coverage_curve(agent(spark, d), "confidence"), 0.4))
)
query("g11_harm_floor", CURVE + CURVED + " WHERE n_auto > 0 ORDER BY c.false_auto_rate, threshold LIMIT 1")(
    lambda spark, d: rounded(M.harm_floor(M.coverage_curve(agent(spark, d), "confidence")))
)


def tuned(score, default, name):
    best = f"(SELECT threshold FROM {name} WHERE n_auto > 0 AND false_auto_rate <= 0.1 ORDER BY coverage DESC, threshold LIMIT 1)"
    return f"SELECT '{score}' AS score, coalesce({best}, {default}) AS threshold, {best} IS NOT NULL AS budget_feasible, (SELECT round(min(false_auto_rate), 6) FROM {name} WHERE n_auto > 0) AS floor"


query("g12_tune_thresholds", with_(O, AG, curve("confidence", "c1"), curve("max_similarity", "c2")) + tuned("confidence", 0.9, "c1") + " UNION ALL " + tuned("max_similarity", 0.75, "c2"))(
    lambda spark, d: M.tune_thresholds(agent(spark, d)).withColumn("floor", F.round("floor", 6))
)


def kappa_sql(src, by="", weighted=False, name="k"):
    g = f"{by}, " if by else ""
    same = f" AND {{}}.{by} = {{}}.{by}" if by else ""
    w = "pow(x.i - y.i, 2)" if weighted else "CASE WHEN x.v <> y.v THEN 1.0 ELSE 0.0 END"
    return f"""{name}v AS (SELECT {g}v, row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY v) AS i FROM (SELECT {g}a AS v FROM {src} UNION SELECT {g}b FROM {src})),
{name}q AS (SELECT {'x.' + by + ', ' if by else ''}{w} AS w, (SELECT count(*) FROM {src} z WHERE z.a = x.v AND z.b = y.v{same.format('z', 'x')}) AS o,
  (SELECT count(*) FROM {src} z WHERE z.a = x.v{same.format('z', 'x')}) AS na, (SELECT count(*) FROM {src} z WHERE z.b = y.v{same.format('z', 'x')}) AS nb, x.v = y.v AS same
  FROM {name}v x JOIN {name}v y ON true{same.format('x', 'y')}),
{name} AS (SELECT {g}CAST(sum(o) AS BIGINT) AS n, sum(CASE WHEN same THEN o ELSE 0 END) / CAST(sum(o) AS DOUBLE) AS raw_agreement,
  CASE WHEN sum(w * na * nb) > 0 THEN 1 - sum(w * o) * sum(o) / sum(w * na * nb) ELSE CAST('nan' AS DOUBLE) END AS kappa FROM {name}q {'GROUP BY ' + by if by else ''})"""


query("g13_kappa", with_("r AS (SELECT quality AS a, 1 - toxic AS b FROM labels)", kappa_sql("r")) + "SELECT n, round(raw_agreement, 6) AS raw_agreement, round(kappa, 6) AS kappa FROM k")(
    lambda spark, d: rounded(M.kappa(I.table(spark, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))))
)
PAIRS = with_(O, I.scores_sql("h", "h"), I.scores_sql("j", "j"), "hj AS (SELECT h.thread_id, h.system, " + ", ".join(f"h.{x} AS h_{x}, j.{x} AS j_{x}" for x in [*I.SCORED, "would_send"]) + " FROM h JOIN j USING (thread_id, system))")


def pairs(spark, d):
    return A.human_vs_judge(I.scores(spark, d, "h"), I.scores(spark, d, "j"))


WK = PAIRS.rstrip() + ", r AS (SELECT h_tone_fit AS a, j_tone_fit AS b FROM hj),\n"
query("g14_weighted_kappa", WK + kappa_sql("r", weighted=True) + " SELECT n, round(raw_agreement, 6) AS raw_agreement, round(kappa, 6) AS kappa FROM k")(
    lambda spark, d: rounded(M.kappa(pairs(spark, d).select(F.col("h_tone_fit").alias("a"), F.col("j_tone_fit").alias("b")), weighted=True))
)
RANKED = ", rk AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM r)"
query("g15_spearman", WK.rstrip().rstrip(",") + RANKED + " SELECT count(*) AS n, round(corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE)), 6) AS rho, round(avg(b - a), 6) AS mean_bias FROM rk")(
    lambda spark, d: rounded(M.spearman(pairs(spark, d).select(F.col("h_tone_fit").alias("a"), F.col("j_tone_fit").alias("b"))))
)
query("w8_average_rank", WK.rstrip().rstrip(",") + RANKED + " SELECT a, CAST(ra AS DOUBLE) AS ra, count(*) AS n FROM rk GROUP BY a, ra")(
    lambda spark, d: M.average_ranks(pairs(spark, d).select(F.col("h_tone_fit").alias("a")), "a").select("a", F.col("rank_").cast("double").alias("ra"), F.col("c_").alias("n"))
)
LONG = PAIRS.rstrip() + ", r AS (" + " UNION ALL ".join(f"SELECT '{x}' AS dimension, h_{x} AS a, j_{x} AS b FROM hj" for x in I.SCORED) + "),\n"
query("g16_judge_agreement", LONG + kappa_sql("r", "dimension", True) + """, rk AS (SELECT *, rank() OVER (PARTITION BY dimension ORDER BY a) + (count(*) OVER (PARTITION BY dimension, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY dimension ORDER BY b) + (count(*) OVER (PARTITION BY dimension, b) - 1) / 2.0 AS rb FROM r),
s AS (SELECT dimension, count(*) AS n, corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE)) AS rho, avg(b - a) AS mean_bias, avg(a) AS human_mean, avg(b) AS judge_mean FROM rk GROUP BY dimension)
SELECT dimension, s.n, round(rho, 6) AS rho, round(mean_bias, 6) AS mean_bias, round(kappa, 6) AS kappa, round(human_mean, 6) AS human_mean, round(judge_mean, 6) AS judge_mean FROM s JOIN k USING (dimension)""")(
    lambda spark, d: rounded(A.judge_agreement(pairs(spark, d)))
)
query("g16_gate_agreement", PAIRS.rstrip() + ", r AS (SELECT h_would_send AS a, j_would_send AS b FROM hj),\n" + kappa_sql("r") + " SELECT k.n, round(raw_agreement, 6) AS raw_agreement, round(kappa, 6) AS kappa, (SELECT round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) FROM r) AS human_rate, (SELECT round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 6) FROM r) AS judge_rate FROM k")(
    lambda spark, d: rounded(A.gate_agreement(pairs(spark, d)))
)
query("g16_gate_disagreements", PAIRS + "SELECT thread_id, system, h_would_send, j_would_send FROM hj WHERE h_would_send <> j_would_send ORDER BY thread_id, system LIMIT 15")(
    lambda spark, d: A.gate_disagreements(pairs(spark, d))
)
LABELS = with_(O, I.RELABELS, "both_ AS (SELECT stratum, intent, action, relabel_intent, relabel_action FROM pp UNION ALL SELECT '(all)', intent, action, relabel_intent, relabel_action FROM pp)", "ri AS (SELECT stratum, intent AS a, relabel_intent AS b FROM both_)", "ra AS (SELECT stratum, action AS a, relabel_action AS b FROM both_)")


def passes(spark, d):
    return A.pass_pairs(*I.relabels(spark, d))


query("g17_label_agreement", LABELS.rstrip() + ",\n" + kappa_sql("ri", "stratum", name="ki") + ",\n" + kappa_sql("ra", "stratum", name="ka") + """,
rt AS (SELECT stratum, avg(CASE WHEN action = 'escalate' THEN 1.0 ELSE 0.0 END) AS rate_1, avg(CASE WHEN relabel_action = 'escalate' THEN 1.0 ELSE 0.0 END) AS rate_2 FROM both_ GROUP BY stratum)
SELECT stratum, ki.n, round(ki.raw_agreement, 6) AS intent_raw, round(ki.kappa, 6) AS intent_kappa, round(ka.raw_agreement, 6) AS action_raw, round(ka.kappa, 6) AS action_kappa, round(rate_1, 6) AS rate_1, round(rate_2, 6) AS rate_2, abs(rate_1 - rate_2) >= 0.2 AS skewed
FROM ki JOIN ka USING (stratum) JOIN rt USING (stratum)""")(lambda spark, d: rounded(A.label_agreement(passes(spark, d))))
query("g17_action_confusion", LABELS + "SELECT action, relabel_action, count(*) AS n FROM pp GROUP BY 1, 2")(lambda spark, d: A.action_confusion(passes(spark, d)))
query("g17_disagreements", LABELS + "SELECT thread_id, stratum, intent, action, relabel_intent, relabel_action FROM pp WHERE intent <> relabel_intent OR action <> relabel_action")(
    lambda spark, d: A.disagreements(passes(spark, d))
)
query("j8_pass_pairs", LABELS + "SELECT thread_id, intent, relabel_intent FROM pp")(lambda spark, d: passes(spark, d).select("thread_id", "intent", "relabel_intent"))
query("j7_human_vs_judge", PAIRS + "SELECT thread_id, system, h_safety, j_safety FROM hj")(lambda spark, d: pairs(spark, d).select("thread_id", "system", "h_safety", "j_safety"))
query("g18_per_stratum_scores", with_(O) + f"SELECT system, stratum, {ROUTING}, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM o GROUP BY system, stratum HAVING count(*) >= 3")(
    lambda spark, d: rounded(M.per_stratum_scores(I.outputs(spark, d)))
)
query("g19_rule_counts", with_(O) + "SELECT system, triggered_rule, count(*) AS n, count(*) FILTER (action = 'escalate') AS n_escalated FROM o GROUP BY 1, 2")(lambda spark, d: M.rule_counts(I.outputs(spark, d)))
query("g20_degenerate_routing_flag", with_(O) + "SELECT system, bool_and(action = 'escalate') AS escalates_everything FROM o GROUP BY system")(lambda spark, d: M.degenerate_routing_flag(I.outputs(spark, d)))
JS = with_(O, I.scores_sql("j", "j"))
query("g21_judge_summary", JS + "SELECT system, count(*) AS n, round(avg(mean_score), 6) AS mean_score, round(avg(CASE WHEN would_send THEN 1.0 ELSE 0.0 END), 6) AS would_send_rate, " + ", ".join(f"round(avg({x}), 6) AS {x}_mean" for x in I.SCORED) + " FROM j GROUP BY system")(
    lambda spark, d: rounded(A.judge_summary(I.scores(spark, d, "j")))
)
WIDE = JS.rstrip() + ", ab AS (SELECT x.thread_id, " + ", ".join(f"x.{c} AS a_{c}, y.{c} AS b_{c}" for c in [*I.SCORED, "would_send"]) + ", x.thread_id % 4 = 0 AS h FROM j x JOIN j y ON x.thread_id = y.thread_id AND x.system = 'agent' AND y.system = 'baseline'), m AS (SELECT *, (a_resolution + a_tone_fit + a_safety) / 3.0 AS am, (b_resolution + b_tone_fit + b_safety) / 3.0 AS bm FROM ab)"


@query("g22_paired_comparison", WIDE + " SELECT count(*) AS n, " + ", ".join(f"round(avg(a_{x}), 6) AS a_{x}, round(avg(b_{x}), 6) AS b_{x}, round(avg(a_{x}) - avg(b_{x}), 6) AS delta_{x}" for x in I.SCORED) + """,
round(avg(CAST(am AS DOUBLE)), 6) AS a_comparable, round(avg(CAST(bm AS DOUBLE)), 6) AS b_comparable, count(*) FILTER (am > bm) AS a_better, count(*) FILTER (am < bm) AS b_better, count(*) FILTER (am = bm) AS tie,
round(avg(CASE WHEN a_would_send THEN 1.0 ELSE 0.0 END), 6) AS a_send_rate, round(avg(CASE WHEN b_would_send THEN 1.0 ELSE 0.0 END), 6) AS b_send_rate, count(*) FILTER (NOT b_would_send) AS b_blocked, count(*) FILTER (h) AS handoffs,
round(avg(b_resolution) FILTER (h), 6) AS resolution_handoff, round(avg(b_resolution) FILTER (NOT h), 6) AS resolution_direct FROM m""")
def g22(spark, d):
    s = I.scores(spark, d, "j")
    named = lambda who, p: s.where(F.col("system") == who).select("thread_id", *(F.col(c).alias(f"{p}_{c}") for c in [*I.SCORED, "would_send"]))
    both = named("agent", "a").join(named("baseline", "b"), "thread_id").withColumn("b_is_handoff", F.col("thread_id") % 4 == 0)
    return rounded(A.paired_comparison(both))


query("g23_paired_delta", with_(O, I.scores_sql("h", "h"), I.scores_sql("j", "j")) + "SELECT count(*) AS n, round(avg(j.mean_score - h.mean_score), 6) AS mean_delta, count(*) FILTER (j.would_send <> h.would_send) AS flips FROM h JOIN j USING (thread_id, system)")(
    lambda spark, d: rounded(A.paired_delta(I.scores(spark, d, "h"), I.scores(spark, d, "j")))
)
REPLY = "CASE thread_id % 5 WHEN 0 THEN 'Hi [Customer Name], please share your order id' WHEN 1 THEN 'We will update you within 24 hours' WHEN 2 THEN 'A human will look' ELSE 'Thanks' END"
FAIL = f"f AS (SELECT o.*, {REPLY} AS reply, thread_id % 9 <> 0 AS has_gold FROM o WHERE system = 'agent')"
GUARD = "gold IN ('c0', 'c3')"


def joined(spark, d):
    o = agent(spark, d).withColumn("reply", F.expr(REPLY)).withColumnRenamed("pred", "intent")
    gold = o.where("thread_id % 9 <> 0").select("thread_id", F.col("gold").alias("intent"), F.col("gold_action").alias("action"), F.col("reason").alias("escalation_reason"))
    return FA.gold_by_output(o.drop("gold", "gold_action"), gold)


query("j15_gold_by_output", with_(O, FAIL) + "SELECT thread_id, has_gold, CASE WHEN has_gold THEN gold END AS gold_intent FROM f")(lambda spark, d: joined(spark, d).select("thread_id", "has_gold", "gold_intent"))
query("g24_failure_analysis", with_(O, FAIL) + f"""SELECT 'false_auto_by_reason' AS family, reason AS key, count(*) AS n FROM f WHERE has_gold AND action = 'auto' AND gold_action = 'escalate' GROUP BY reason
UNION ALL SELECT 'false_auto_intent_also_wrong', 'yes', count(*) AS c FROM f WHERE has_gold AND action = 'auto' AND gold_action = 'escalate' AND gold <> pred HAVING c > 0
UNION ALL SELECT 'false_auto_gold_never_auto', 'yes', count(*) AS c FROM f WHERE has_gold AND action = 'auto' AND gold_action = 'escalate' AND {GUARD} HAVING c > 0
UNION ALL SELECT 'false_escalate_by_rule', triggered_rule, count(*) FROM f WHERE has_gold AND action = 'escalate' AND gold_action = 'auto' GROUP BY 2
UNION ALL SELECT 'intent_confusion', concat(gold, ' -> ', pred), count(*) FROM f WHERE has_gold AND gold <> pred GROUP BY 2
UNION ALL SELECT 'intent_cost', CASE WHEN {GUARD} AND pred NOT IN ('c0', 'c3') THEN 'lost a never-auto guard' ELSE 'harmless direction' END, count(*) FROM f WHERE has_gold AND gold <> pred GROUP BY 2
UNION ALL SELECT 'draft_defect', CASE thread_id % 5 WHEN 0 THEN 'unfilled_placeholder' WHEN 1 THEN 'unsupported_time_commitment' ELSE 'internal_routing_leak' END, count(*) FROM f WHERE has_gold AND thread_id % 5 < 3 GROUP BY 2
UNION ALL SELECT 'draft_defect', 'solicits_pii_publicly', count(*) FROM f WHERE has_gold AND thread_id % 5 = 0
UNION ALL SELECT 'total', 'n', count(*) FROM f UNION ALL SELECT 'total', 'n_auto', count(*) FROM f WHERE action = 'auto' UNION ALL SELECT 'rule_fired', triggered_rule, count(*) FROM f GROUP BY 2""")(
    lambda spark, d: FA.failure_analysis(joined(spark, d), I.NEVER_AUTO)
)
query("g24_false_auto_range", with_(O, FAIL) + "SELECT count(*) AS n, min(confidence) AS low, max(confidence) AS high FROM f WHERE has_gold AND action = 'auto' AND gold_action = 'escalate'")(
    lambda spark, d: FA.false_auto_range(joined(spark, d), I.NEVER_AUTO)
)
query("g25_defects_by_system", with_(O) + f"""SELECT system, defect, count(*) AS n FROM (SELECT system, unnest(CASE thread_id % 5 WHEN 0 THEN ['unfilled_placeholder', 'solicits_pii_publicly'] WHEN 1 THEN ['unsupported_time_commitment'] WHEN 2 THEN ['internal_routing_leak'] ELSE [] END) AS defect FROM o) GROUP BY 1, 2""")(
    lambda spark, d: FA.defects_by_system(I.outputs(spark, d).withColumn("reply", F.expr(REPLY)))
)
query("g26_override_rate", with_(O, I.RELABELS, "x AS (SELECT unnest([{'family': 'all', 'key': ''}, {'family': 'intent', 'key': intent}, {'family': 'action', 'key': action}, {'family': 'stratum', 'key': stratum}]) AS m, intent <> weak_intent AS other FROM p1)") + "SELECT m.family AS family, m.key AS key, count(*) AS n, round(avg(CASE WHEN other THEN 1.0 ELSE 0.0 END), 6) AS override_rate FROM x GROUP BY 1, 2")(
    lambda spark, d: rounded(A.override_rate(I.relabels(spark, d)[0]))
)
query("g27_provenance_mix", JS + "SELECT split, system, array_to_string(list_sort(list_distinct(list(judge_model) FILTER (judge_model IS NOT NULL))), ',') AS models, count(DISTINCT judge_model) > 1 AS mixed, count(*) AS n FROM j GROUP BY 1, 2")(
    lambda spark, d: A.provenance_mix(I.scores(spark, d, "j")).withColumn("models", F.array_join("models", ","))
)
query("g30_majority_class", "SELECT concat('c', label) AS label FROM embeddings GROUP BY embeddings.label ORDER BY count(*) DESC, min(vec_id) LIMIT 1")(
    lambda spark, d: M.majority_class(I.table(spark, d, "embeddings").select(F.concat(F.lit("c"), F.col("label")).alias("label"), "vec_id"), "label", "vec_id")
)
query("j6_gold_vs_pred", with_(O) + "SELECT thread_id, gold, pred FROM o WHERE system = 'agent'")(
    lambda spark, d: M.gold_vs_pred(agent(spark, d).select("thread_id", "gold"), agent(spark, d).select("thread_id", "pred"), "thread_id", ["gold", "pred"])
)
query("s1_union_systems", with_(O) + "SELECT system, thread_id, action FROM o")(
    lambda spark, d: A.union_systems(*(I.outputs(spark, d).where(F.col("system") == s).select("system", "thread_id", "action") for s in ("agent", "baseline")))
)
query("s2_label_universe", with_(O) + "SELECT gold AS label FROM o UNION SELECT pred FROM o")(lambda spark, d: M.label_universe(I.outputs(spark, d)).orderBy("label"))


HIT = "CASE WHEN gold = pred THEN 1 ELSE 0 END"
SENT = "CASE WHEN action = 'auto' THEN 1 ELSE 0 END"
HARM = "CASE WHEN action = 'auto' AND gold_action = 'escalate' THEN 1 ELSE 0 END"
#: statistic: numerator, denominator, value of a replicate without denominator.
RATIOS = {"accuracy": (HIT, "1", "NULL"), "false_auto_rate": (HARM, SENT, "0.0"), "mean_confidence": ("confidence", "1", "NULL"), "similarity_when_right": (f"max_similarity * {HIT}", HIT, "NULL")}
DRAWN = f"""bx AS (SELECT *, {bucket_sql("concat('boot:42:', thread_id)", BS.PRIME)} AS key FROM o WHERE system = 'agent'),
bw AS (SELECT bx.*, r.range AS r, {BS.draws_sql('key', 'r.range')} AS w FROM bx CROSS JOIN range(2000) r),
bv AS (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS statistic, r, CASE WHEN sum(w * {under}) <> 0 THEN sum(CAST(w * {over} AS DOUBLE)) / sum(w * {under}) ELSE {empty} END AS value FROM bw GROUP BY r" for name, (over, under, empty) in RATIOS.items()
) + """ UNION ALL SELECT 'macro_f1', r, avg(CASE WHEN sides > 0 THEN 2 * CAST(hit AS DOUBLE) / sides ELSE 0 END) FROM (SELECT r, label, sum(w * hit) AS hit, sum(w) AS sides FROM
  (SELECT r, w, gold AS label, CASE WHEN gold = pred THEN 1 ELSE 0 END AS hit FROM bw UNION ALL SELECT r, w, pred, 0 FROM bw) GROUP BY r, label) GROUP BY r)"""


@query("g29_bootstrap_ci", with_(O, DRAWN) + "SELECT statistic, (SELECT count(*) FROM bx) AS n, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM bv GROUP BY statistic")
def g29(spark, d):
    rows = saved(agent(spark, d).select("thread_id", "gold", "pred", "action", "gold_action", "confidence", "max_similarity"), "bootstrap-rows")
    found = BS.macro_f1_ci(rows, "thread_id").withColumn("statistic", F.lit("macro_f1"))
    for name, (over, under, empty) in RATIOS.items():
        found = found.unionByName(BS.ratio_ci(rows, "thread_id", F.expr(over), F.expr(under), empty=None if empty == "NULL" else float(empty)).withColumn("statistic", F.lit(name)))
    return found.select("statistic", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("m8_trivial_policies", with_(O) + f"SELECT doc_id, (SELECT concat('c', label) FROM embeddings GROUP BY label ORDER BY count(*) DESC, min(vec_id) LIMIT 1) AS intent, s.system, s.action FROM documents CROSS JOIN (VALUES ('trivial_always_auto', 'auto'), ('trivial_always_escalate', 'escalate')) s(system, action)")
def m8(spark, d):
    labelled = I.table(spark, d, "embeddings").select(F.concat(F.lit("c"), F.col("label")).alias("label"), F.col("vec_id").alias("id"))
    return models.trivial_policies(I.table(spark, d, "documents").select("doc_id"), labelled).drop("reply")


