"""Queries of the text functions, filters and curation over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import curate, sample
from . import inputs as I
from .registry import bucket_sql as b
from .registry import first_sql, matches_sql, query, re2

DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents)"


def docs(spark, d):
    return I.table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def per_doc(name, column, sql=None, prelude=""):
    """One value per document."""
    query(name, f"WITH {DOCS}{', ' + prelude if prelude else ''} SELECT doc_id, {sql} AS value FROM d" if sql else None)(lambda spark, d: docs(spark, d).select("doc_id", column().alias("value")))


URL_RE2 = r"(?i)https?://\S+|www\.\S+"
PLAIN = rf"trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '{URL_RE2}', '<URL>', 'g'), '@\pN+', '', 'g'), '@[\pL\pN_]{{1,15}}', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))"
per_doc("t1_normalise", lambda: T.normalise(F.col("text")), PLAIN.replace("(text,", "(nfc_normalize(text),"))
per_doc("t2_is_deflection", lambda: T.is_deflection(F.col("text")), matches_sql("text", "|".join(T.DEFLECTION)))
LINKED = "CASE WHEN doc_id % 3 = 0 THEN concat(text, ' contact us at <URL>') WHEN doc_id % 3 = 1 THEN concat(text, ' Call us') ELSE text END"
query("t3_is_link_handoff", f"WITH {DOCS} SELECT doc_id, {matches_sql(LINKED, T.CONTACT)} AND contains({LINKED}, '<URL>') AS value FROM d")(
    lambda spark, d: docs(spark, d).select("doc_id", T.is_link_handoff(F.expr(LINKED.replace("text", "coalesce(text, '')"))).alias("value"))
)
query("t4_is_handoff", f"WITH {DOCS} SELECT doc_id, ({matches_sql(LINKED, '|'.join(T.DEFLECTION))}) OR ({matches_sql(LINKED, T.CONTACT)} AND contains({LINKED}, '<URL>')) AS value FROM d")(
    lambda spark, d: docs(spark, d).select("doc_id", T.is_handoff(F.expr(LINKED.replace("text", "coalesce(text, '')"))).alias("value"))
)
LATIN = r"CASE WHEN regexp_matches(text, '\pL') THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / CAST(length(regexp_replace(text, '\PL', '', 'g')) AS DOUBLE) ELSE 0.0 END"
per_doc("t5_latin_ratio", lambda: F.round(T.latin_ratio(F.col("text")), 6), f"round({LATIN}, 6)")


def share_sql(words):
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))
    tokens = "regexp_extract_all(lower(text), '[a-z'']+')"
    return f"CASE WHEN len({tokens}) > 0 THEN len(list_filter({tokens}, lambda w: w IN ({listed}))) / CAST(len({tokens}) AS DOUBLE) ELSE 0.0 END"


ENGLISH, FOREIGN = share_sql(T.ENGLISH), share_sql(T.FOREIGN)
per_doc("t6_english_score", lambda: F.round(T.english_score(F.col("text")), 6), f"round({ENGLISH}, 6)")
per_doc("t7_foreign_score", lambda: F.round(T.foreign_score(F.col("text")), 6), f"round({FOREIGN}, 6)")
IS_ENGLISH = f"NOT (({FOREIGN} > {ENGLISH} AND {FOREIGN} >= 0.12) OR (regexp_matches(text, '{T.DIACRITICS.replace('(?iu)', '(?i)')}') AND {ENGLISH} < 0.08 AND {FOREIGN} > 0))"
per_doc("t8_is_probably_english", lambda: T.is_probably_english(F.col("text")), IS_ENGLISH)
USABLE = f"(length(text) >= 15 AND {LATIN} >= 0.6)"
per_doc("t9_is_usable", lambda: T.is_usable(F.col("text")), USABLE)
DEDUPE = "sha1(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')))"
per_doc("t10_dedupe_key", lambda: T.dedupe_key(F.col("text")), DEDUPE)
per_doc("t11_stable_bucket", lambda: H.stable_bucket(F.concat(F.lit("thread-"), F.col("doc_id")), 100), b("concat('thread-', doc_id)", 100))
per_doc("t12_text_key", lambda: H.text_key(T.filled(F.col("text")), "local", 64), "sha256(concat('local|64|', text))")
REQUEST = dict(model="m", provider="p", schema="s", system="y", temperature="0.0")
query("t13_request_key", f"WITH {DOCS} SELECT doc_id, sha256(concat('{{\"model\":\"m\",\"prompt\":\"', source, '\",\"provider\":\"p\",\"schema\":null,\"system\":\"y\",\"temperature\":0.0}}')) AS value FROM d WHERE source IS NOT NULL")(
    lambda spark, d: docs(spark, d).where("source is not null").select("doc_id", H.request_key({"prompt": F.col("source"), "model": F.lit("m"), "provider": F.lit("p"), "schema": F.lit(None).cast("string"), "system": F.lit("y"), "temperature": F.lit(0.0)}).alias("value"))
)
per_doc("t14_match_pii", lambda: T.match_pii(F.col("text")), first_sql("text", T.PII))
per_doc("t15_match_hard_escalation", lambda: T.match_hard_escalation(F.col("text")), first_sql("text", T.HARD))
UPPER = r"length(regexp_replace(text, '\P{Lu}', '', 'g')) / CAST(greatest(length(regexp_replace(text, '\PL', '', 'g')), 1) AS DOUBLE)"
TAGS = f"""list_filter([CASE WHEN length(text) < 40 THEN 'very_short' END, CASE WHEN length(text) > 20 AND {UPPER} > 0.7 THEN 'all_caps' END,
  CASE WHEN length(regexp_replace(text, '[^\\x{{2101}}-\\x{{10FFFF}}]', '', 'g')) >= 3 THEN 'emoji_heavy' END, CASE WHEN length(text) - length(replace(text, '?', '')) >= 2 THEN 'multi_question' END,
  CASE WHEN {matches_sql('text', T.RAGE)} THEN 'rage_markers' END, CASE WHEN {matches_sql('text', T.MULTI_INTENT)} THEN 'multi_intent' END,
  CASE WHEN {matches_sql('text', T.SARCASM)} THEN 'sarcasm_marker' END], lambda x: x IS NOT NULL)"""
per_doc("t16_adversarial_tags", lambda: F.array_join(T.adversarial_tags(F.col("text")), ","), f"array_to_string({TAGS}, ',')")
DRAFTED = "CASE doc_id % 5 WHEN 0 THEN concat('Hi [Customer Name], ', text) WHEN 1 THEN concat(text, ' please share your order id') WHEN 2 THEN concat('We will update you within 24 hours. ', text) WHEN 3 THEN '[URL] TODO handled by a human agent' ELSE text END"
DEFECT_CASES = ", ".join(f"CASE WHEN {matches_sql(DRAFTED, p)} THEN '{n}' END" for n, p in T.DEFECTS)
@query("t17_draft_defects", f"WITH {DOCS}, e AS (SELECT doc_id, list_filter([{DEFECT_CASES}], lambda x: x IS NOT NULL) AS found FROM d) SELECT doc_id, unnest(found) AS defect FROM e")
def t17(spark, d):
    """Drafts and their folds are columns of their own, so that each is made once and not for every condition on it."""
    drafts = docs(spark, d).select("doc_id", F.expr(DRAFTED.replace("text", "coalesce(text, '')")).alias("reply"))
    drafts = drafts.withColumn("folded_", T.fold(F.col("reply")))
    return drafts.select("doc_id", F.explode(T.draft_defects(F.col("reply"), F.col("folded_"))).alias("defect"))


GREETINGS = ["Hi Anna, ", "hello THERE, so sorry, Anna! ", "We are so sorry about that, Mark! ", "Hey Petra, ", "DEAR mark: ", "Good day. "]
REPLIED = "concat([" + ", ".join(f"'{g}'" for g in GREETINGS) + "][doc_id % 6 + 1], text)"
PRECEDENTS = ["Hi Anna and Mark, we are on it", "Petrarch wrote", "see you there, mark the date"]
KNOWN = ", ".join(f"'{w}'" for w in sorted(set(" ".join(PRECEDENTS).replace(",", "").split())))


@query("t18_carried_over_name", f"""WITH {DOCS}, e AS (SELECT doc_id, trim({REPLIED}) AS r, {REPLIED} AS r0 FROM d),
n AS (SELECT doc_id, CASE WHEN regexp_matches(r, '{re2(T.GREETED.replace('(?iU)', '(?i)'))}') THEN regexp_extract(r, '{re2(T.GREETED.replace('(?iU)', '(?i)'))}', 1)
  ELSE nullif(regexp_extract(r0, '{re2(T.NAMED_LATER.replace('(?U)', ''))}', 1), '') END AS name FROM e)
SELECT doc_id, CASE WHEN lower(name) NOT IN ({", ".join(f"'{w}'" for w in T.NOT_NAMES)}) AND name IN ({KNOWN}) THEN name END AS value FROM n""")
def t18(spark, d):
    greeting = F.element_at(F.array(*map(F.lit, GREETINGS)), (F.col("doc_id") % 6 + 1).cast("int"))
    precedents = F.array(*(F.struct(F.lit(p).alias("brand_reply")) for p in PRECEDENTS))
    return docs(spark, d).select("doc_id", T.carried_over_name(F.concat(greeting, T.filled(F.col("text"))), precedents).alias("value"))


per_doc("t19_ws_tokens", lambda: F.array_join(T.ws_tokens(F.col("text")), "|"), r"array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), '|')")
query("t20_l2_normalise", "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, round(unnest(embedding) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS x FROM embeddings")(
    lambda spark, d: I.table(spark, d, "embeddings").select("vec_id", F.posexplode(T.l2_normalise(F.col("embedding"))).alias("i", "x")).withColumn("x", F.round("x", 6))
)

# ---- filters and curation
REASON = f"CASE WHEN NOT {USABLE} THEN 'unusable_customer_message' WHEN NOT ({IS_ENGLISH}) THEN 'not_english' WHEN trim(substr(text, 1, doc_id % 7)) = '' THEN 'empty_brand_reply' END"
ORDER = b("concat('42:', coalesce(source, ''), ':', doc_id)", 1_000_000_000)
CASCADE = f"""{DOCS}, r1 AS (SELECT *, {REASON} AS reason, {DEDUPE} AS key, {ORDER} AS h FROM d),
r2 AS (SELECT *, row_number() OVER (PARTITION BY key, reason IS NULL ORDER BY h, doc_id) AS place FROM r1),
r AS (SELECT doc_id, coalesce(reason, CASE WHEN place > 1 THEN 'near_duplicate' END) AS drop_reason, {b("concat('split:', doc_id)", 100)} AS bucket FROM r2)"""


def cascade(spark, d):
    rows = docs(spark, d).withColumn("text", T.filled(F.col("text"))).withColumn("reply", F.expr("substring(text, 1, cast(doc_id % 7 as int))"))
    order = [H.stable_bucket(F.concat_ws(":", F.lit("42"), F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")), 1_000_000_000), F.col("doc_id")]
    return curate.curation_cascade(rows, "text", order, reply="reply")


query("f1_curation_cascade", f"WITH {CASCADE} SELECT doc_id, drop_reason FROM r")(lambda spark, d: cascade(spark, d).select("doc_id", "drop_reason"))
query("f2_near_dup_first", f"WITH {DOCS}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY {DEDUPE} ORDER BY doc_id) AS p FROM d) SELECT doc_id FROM k WHERE p = 1")(
    lambda spark, d: curate.near_dup_first(docs(spark, d), "text", [F.col("doc_id")]).select("doc_id")
)
SPLIT = f"{DOCS}, s AS (SELECT *, {b(chr(99) + 'oncat(' + chr(39) + 'split:' + chr(39) + ', doc_id)', 100)} AS bucket FROM d)"
query("f3_hash_split", f"WITH {SPLIT} SELECT doc_id, bucket, CASE WHEN bucket < 6 THEN 'golden_pool' ELSE 'history' END AS split FROM s")(
    lambda spark, d: curate.hash_split(docs(spark, d), "doc_id").select("doc_id", "bucket", "split")
)
DEVTEST = b("concat('devtest:', doc_id)", 100)
query("f4_devtest_split", f"WITH {DOCS} SELECT doc_id, CASE WHEN {DEVTEST} < 40 THEN 'dev' ELSE 'test' END AS devtest FROM d")(
    lambda spark, d: curate.devtest_split(docs(spark, d), "doc_id").select("doc_id", "devtest")
)
query("f5_split_scan", f"WITH {SPLIT} SELECT source, count(*) AS n FROM s WHERE bucket >= 6 GROUP BY source")(
    lambda spark, d: curate.split_scan(curate.hash_split(docs(spark, d), "doc_id"), "history").groupBy("source").agg(F.count("*").alias("n"))
)
query("f6_labelled_rows", "SELECT doc_id, CASE WHEN quality = 1 THEN 'good' END AS intent, CASE WHEN toxic = 1 THEN 'escalate' ELSE 'auto' END AS action FROM labels WHERE quality = 1")(
    lambda spark, d: curate.labelled_rows(I.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("intent"), F.when(F.col("toxic") == 1, "escalate").otherwise("auto").alias("action")))
)
query("f7_replies_present", f"WITH {DOCS} SELECT doc_id, source AS system FROM d WHERE trim(substr(text, 1, doc_id % 7)) <> '' AND source <> 'src0'")(
    lambda spark, d: curate.replies_present(docs(spark, d).select("doc_id", F.col("source").alias("system"), F.expr("substring(coalesce(text, ''), 1, cast(doc_id % 7 as int))").alias("reply")), "src0").select("doc_id", "system")
)
query("f8_length_band_sample", f"WITH {DOCS} SELECT doc_id FROM d WHERE length(text) BETWEEN 41 AND 239 ORDER BY {b(chr(99) + 'oncat(' + chr(39) + '42:' + chr(39) + ', doc_id)', 1_000_000_000)}, doc_id LIMIT 20")(
    lambda spark, d: curate.length_band_sample(docs(spark, d), "text", "doc_id", 20).select("doc_id")
)
query("f9_corpus_summary", f"""WITH {CASCADE} SELECT 'total' AS family, 'raw' AS key, count(*) AS n FROM r UNION ALL SELECT 'total', 'kept', count(*) FROM r WHERE drop_reason IS NULL
UNION ALL SELECT 'dropped', drop_reason, count(*) FROM r WHERE drop_reason IS NOT NULL GROUP BY drop_reason
UNION ALL SELECT 'split', CASE WHEN bucket < 6 THEN 'golden_pool' ELSE 'history' END, count(*) FROM r WHERE drop_reason IS NULL GROUP BY 2""")(
    lambda spark, d: curate.corpus_summary(curate.hash_split(cascade(spark, d), "doc_id"))
)


@query("j13_leakage_check", f"""WITH {SPLIT} SELECT 'shared_ids' AS "check", count(DISTINCT doc_id) FILTER (bucket = 3) AS n FROM s
UNION ALL SELECT 'golden_outside_pool', count(DISTINCT doc_id) FILTER (bucket = 6) FROM s UNION ALL SELECT 'split_not_reproduced', count(*) FILTER (bucket = 3) FROM s""")
def j13(spark, d):
    """Planted leaks: one pool bucket stands in the history as well, and the golden rows take in one history bucket."""
    rows = curate.hash_split(docs(spark, d).select("doc_id"), "doc_id")
    leaked = rows.unionByName(rows.where("bucket = 3").withColumn("split", F.lit("history")))
    return curate.leakage_check(leaked, rows.where("bucket <= 6"), "doc_id")


TODO = b("concat('todo:', doc_id)", 1_000_000_000)
query("j14_todo_anti", f"SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) ORDER BY {TODO}, doc_id LIMIT 50")(
    lambda spark, d: curate.todo_anti(docs(spark, d).select("doc_id"), I.table(spark, d, "labels"), ["doc_id"], "todo", 50)
)
RELABEL = b("concat('relabel:', doc_id)", 1_000_000_000)
query("w11_stable_subset", f"SELECT doc_id, {RELABEL} AS order_ FROM labels ORDER BY order_, doc_id LIMIT 50")(
    lambda spark, d: curate.stable_order(I.table(spark, d, "labels").select("doc_id"), "relabel", ["doc_id"], 50)
)
SHUFFLE = b("concat('humanjudge:', source, ':', doc_id)", 1_000_000_000)
query("w10_stable_shuffle", f"SELECT source, doc_id, {SHUFFLE} AS order_, row_number() OVER (ORDER BY {SHUFFLE}, source, doc_id) AS place FROM documents WHERE source IS NOT NULL")(
    lambda spark, d: curate.stable_order(docs(spark, d).where("source is not null").select("source", "doc_id"), "humanjudge", ["source", "doc_id"])
)
query("s3_distinct_messages", f"WITH {DOCS} SELECT DISTINCT text FROM documents WHERE text IS NOT NULL")(
    lambda spark, d: docs(spark, d).select("text").where("text is not null").distinct()
)
query("s4_disjointness", f"WITH {SPLIT} SELECT (SELECT count(*) FROM (SELECT doc_id FROM s WHERE bucket < 6 INTERSECT SELECT doc_id FROM s WHERE bucket >= 6)) AS shared, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM s)) AS outside")(
    lambda spark, d: _disjoint(spark, d)
)


def _disjoint(spark, d):
    rows = curate.hash_split(docs(spark, d), "doc_id")
    pool, history = (curate.split_scan(rows, s).select("doc_id") for s in ("golden_pool", "history"))
    shared = pool.intersect(history).agg(F.count("*").alias("shared"))
    return shared.join(I.table(spark, d, "labels").select("doc_id").exceptAll(rows.select("doc_id")).distinct().agg(F.count("*").alias("outside")), F.lit(True))


POOL = f"pool AS (SELECT CAST(doc_id AS VARCHAR) AS thread_id, source AS cluster, len({TAGS}) AS n_tags FROM d)"
GOLD = b("concat('golden:42:', thread_id)", 1_000_000_000)


@query("w6_stratified_sample", f"""WITH {DOCS}, {POOL}, t AS (SELECT *, {GOLD} AS rank, count(*) OVER (PARTITION BY cluster) AS size, count(*) OVER () AS total FROM pool),
adv AS (SELECT *, 'adversarial' AS stratum FROM t WHERE n_tags > 0 ORDER BY n_tags DESC, rank, thread_id LIMIT 22),
t1 AS (SELECT * FROM t ANTI JOIN adv USING (thread_id)), t2 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rank, thread_id) AS rn FROM t1),
rare AS (SELECT * EXCLUDE (rn), 'rare' AS stratum FROM t2 ORDER BY CASE WHEN rn > 1 THEN 1 ELSE 0 END, size, cluster, rank, thread_id LIMIT 38),
t3 AS (SELECT * FROM t1 ANTI JOIN rare USING (thread_id)), t4 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rank, thread_id) AS rn FROM t3),
prop AS (SELECT * EXCLUDE (rn), 'proportional' AS stratum FROM t4 WHERE rn <= greatest(1, round_even(90 * size / CAST(total AS DOUBLE), 0)) ORDER BY size DESC, cluster, rank, thread_id LIMIT 90),
c AS (SELECT * FROM adv UNION ALL SELECT * FROM rare UNION ALL SELECT * FROM prop),
more AS (SELECT *, 'proportional' AS stratum FROM (SELECT * FROM t3 ANTI JOIN prop USING (thread_id)) ORDER BY size DESC, cluster, rank, thread_id LIMIT (SELECT 150 - count(*) FROM c))
SELECT thread_id, cluster, stratum, rank FROM c UNION ALL SELECT thread_id, cluster, stratum, rank FROM more""")
def w6(spark, d):
    rows = docs(spark, d)
    return sample.stratified_sample(rows.select(F.col("doc_id").cast("string").alias("thread_id"), F.col("source").alias("cluster"), T.adversarial_tags(F.col("text")).alias("tags")))


query("w7_position_folds", f"SELECT doc_id, CAST({b(chr(99) + 'oncat(' + chr(39) + 'fold:' + chr(39) + ', doc_id)', 5)} AS INTEGER) AS fold FROM documents")(
    lambda spark, d: sample.position_folds(docs(spark, d).select("doc_id"), "doc_id")
)
query("w7_row_folds", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents")(
    lambda spark, d: sample.row_folds(docs(spark, d).select("doc_id"), ["doc_id"])
)
