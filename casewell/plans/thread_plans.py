"""Queries over the message log: forests, threads, brands, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curate
from ..operators import threads as TH
from ..operators.vectors import Neighbours
from ..scratch import folder
from ..sources import io
from ..streaming import stream
from . import inputs as I
from .registry import bucket_sql as b
from .registry import first_sql, matches_sql, query

REC = f"WITH RECURSIVE {I.LOG}, {I.ROOTS}"
WS = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
#: Normalised text; the other engine composes by NFC, which differs from NFKC where a text has compatibility characters (see the tests).
CLEAN = r"trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(l.text, '')), '(?i)https?://\S+|www\.\S+', '<URL>', 'g'), '@\pN+', '', 'g'), '@[\pL\pN_]{1,15}', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))"
THREADS = rf"""{I.OWNED},
m AS (SELECT o.root, o.brand, l.id, l.inbound, lower(l.author) AS author, l.created_at, {CLEAN} AS clean
  FROM owned o JOIN roots r USING (root) JOIN log l ON l.id = r.id),
th AS (SELECT CAST(root AS VARCHAR) AS thread_id, brand, max(CASE WHEN id = root THEN clean END) AS customer_msg,
  list(clean ORDER BY id) FILTER (NOT inbound AND author = brand) AS replies, CAST(count(*) FILTER (inbound AND id <> root) + 1 AS INTEGER) AS customer_turns,
  max(CASE WHEN id = root THEN created_at END) AS created_at FROM m GROUP BY root, brand HAVING count(*) FILTER (NOT inbound AND author = brand) > 0)"""


def built(spark, d):
    return TH.build_threads(I.message_log(spark, d), I.BRANDS)


query("a1_scan_structure", f"WITH {I.LOG} SELECT id, author, inbound, parent FROM log")(lambda spark, d: io.scan_structure(I.message_log(spark, d)))


@query("a1_csv_ingest", f"WITH {I.LOG} SELECT id, author, inbound, parent, created_at, coalesce(text, '') AS text FROM log")
def a1_csv(spark, d):
    """The log written as CSV lines and read back by its declared schema, in as many tasks as its bytes ask for."""
    folder = place(spark, "log-csv")
    io.write_message_log(I.message_log(spark, d), folder)
    return io.read_message_log(spark, folder, multi_line=False).withColumn("text", F.coalesce("text", F.lit("")))


@query("a2_scan_text_for_ids", f"{REC}, {I.OWNED} SELECT l.id, l.created_at, l.text FROM owned JOIN roots USING (root) JOIN log l USING (id)")
def a2(spark, d):
    """The second scan: text only of messages in threads that a brand owns."""
    log = I.message_log(spark, d)
    roots = TH.thread_roots(log)
    owned = TH.root_opener_filter(TH.brand_of_root(log, roots, I.BRANDS), log).select("root")
    return io.scan_text_for_ids(log, TH.thread_members(log, roots).join(owned, "root", "left_semi"))


def place(spark, name):
    return f"{folder(spark)}/casewell/{name}-{uuid.uuid4().hex}"


@query("a3_threads_json_io", f"{REC}, {THREADS} SELECT thread_id, brand, customer_msg, len(replies) AS n_replies, customer_turns, created_at FROM th")
def a3(spark, d):
    at = place(spark, "threads-json")
    io.write_json_lines(built(spark, d), at)
    return io.read_json_lines(spark, at).select("thread_id", "brand", "customer_msg", F.size("brand_replies").cast("long").alias("n_replies"), "customer_turns", "created_at")


@query("a4_vector_table_io", "SELECT CAST(vec_id AS VARCHAR) AS key, len(embedding) AS dim FROM embeddings")
def a4(spark, d):
    rows = I.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"))
    at = place(spark, "vectors")
    rows.where("cast(key as long) % 2 = 0").write.parquet(at)
    known = spark.read.parquet(at)
    return io.put_vectors(known, rows).select("key", F.size("vector").cast("long").alias("dim"))


@query("a5_taxonomy_dim", "SELECT DISTINCT concat('c', label) AS name, label IN (0, 3) AS never_auto FROM embeddings UNION ALL SELECT 'other', false")
def a5(spark, d):
    found = I.table(spark, d, "embeddings").select(F.concat(F.lit("c"), F.col("label")).alias("name")).distinct()
    classes = found.unionByName(spark.range(1).select(F.lit("other").alias("name")))
    return io.taxonomy_dim(classes).select("name", F.col("name").isin(I.NEVER_AUTO).alias("never_auto"))


@query("a7_report_rows", f"WITH {I.LOG}, v AS (SELECT author, count(*) AS n FROM log WHERE NOT inbound GROUP BY author) SELECT concat_ws(' | ', author, n) AS line FROM v")
def a7(spark, d):
    return io.report_rows(TH.brand_volume(I.message_log(spark, d)), ["author", "n"], "n")


@query("a8_run_audit_append", f"WITH {I.LOG} SELECT 'final' AS run, count(*) AS n FROM log UNION ALL SELECT 'again', count(*) FROM log")
def a8(spark, d):
    at = place(spark, "audit")
    for run in ("final", "again"):
        io.append_audit(I.message_log(spark, d).agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), "n"), at)
    return spark.read.schema("run string, n long").json(at)


@query("a9_multi_system_scan", f"WITH {I.OUTPUTS} SELECT system, count(*) AS n FROM o GROUP BY system")
def a9(spark, d):
    at = place(spark, "systems")
    io.write_by_system(I.outputs(spark, d), at)
    return io.multi_system_scan(spark, at).groupBy("system").agg(F.count("*").alias("n"))


query("j1_thread_roots", f"{REC} SELECT id, root FROM roots")(lambda spark, d: TH.thread_roots(I.message_log(spark, d)))


@query("j2_thread_members", f"{REC} SELECT root, id FROM roots")
def j2(spark, d):
    log = I.message_log(spark, d)
    return TH.thread_members(log, TH.thread_roots(log))


@query("j3_root_opener_filter", f"{REC}, {I.OWNED} SELECT root, brand FROM owned")
def j3(spark, d):
    log = I.message_log(spark, d)
    return TH.root_opener_filter(TH.brand_of_root(log, TH.thread_roots(log), I.BRANDS), log)


query("j4_brand_semi", f"WITH {I.LOG} SELECT id, author FROM log WHERE NOT inbound AND lower(author) IN ('brand1', 'brand2')")(
    lambda spark, d: TH.brand_semi(I.message_log(spark, d), ["Brand1", "BRAND2"]).select("id", "author")
)
query("g1_brand_volume", f"WITH {I.LOG} SELECT author, count(*) AS n FROM log WHERE NOT inbound GROUP BY author ORDER BY n DESC, author LIMIT 40")(
    lambda spark, d: TH.brand_volume(I.message_log(spark, d))
)
query("g2_assemble_threads", f"{REC}, {THREADS} SELECT thread_id, brand, customer_msg, array_to_string(replies, '||') AS replies, customer_turns, created_at FROM th")(
    lambda spark, d: built(spark, d).select("thread_id", "brand", "customer_msg", F.array_join(F.transform("brand_replies", lambda r: r["text"]), "||").alias("replies"), "customer_turns", "created_at")
)
FIRST = "replies[1]"
HANDOFF = f"(({matches_sql(FIRST, '|'.join(T.DEFLECTION))}) OR ({matches_sql(FIRST, T.CONTACT)} AND contains({FIRST}, '<URL>')))"
USABLE = r"length(customer_msg) >= 15 AND length(regexp_replace(customer_msg, '[^A-Za-z]', '', 'g')) >= 0.6 * length(regexp_replace(customer_msg, '\PL', '', 'g')) AND regexp_matches(customer_msg, '\pL')"
query("g3_brand_profile", rf"""{REC}, {THREADS}, u AS (SELECT * FROM th WHERE {USABLE}),
k AS (SELECT brand, unnest(list_filter(regexp_split_to_array(lower({FIRST}), '\s+'), lambda w: w <> '')) AS token FROM u),
kk AS (SELECT brand, count(DISTINCT token) / CAST(count(token) AS DOUBLE) AS lexical_diversity FROM k GROUP BY brand),
p AS (SELECT brand, count(*) AS threads, avg(CASE WHEN {matches_sql(FIRST, '|'.join(T.DEFLECTION))} THEN 1.0 ELSE 0.0 END) AS dm, avg(CASE WHEN {HANDOFF} THEN 1.0 ELSE 0.0 END) AS handoff,
  CAST(trunc(median(length({FIRST}))) AS INTEGER) AS median_reply_chars, avg(CASE WHEN NOT {HANDOFF} AND length({FIRST}) >= 80 THEN 1.0 ELSE 0.0 END) AS substantive,
  avg(CASE WHEN customer_turns > 1 THEN 1.0 ELSE 0.0 END) AS multi_turn, median(len(replies)) AS median_replies FROM u GROUP BY brand),
n AS (SELECT * FROM (VALUES ('brand0'), ('brand1'), ('brand2'), ('brand3'), ('brand9')) t(brand))
SELECT brand, coalesce(threads, 0) AS threads, round(dm, 6) AS dm, round(handoff, 6) AS handoff, median_reply_chars, round(substantive, 6) AS substantive, round(multi_turn, 6) AS multi_turn,
  median_replies, round(lexical_diversity, 6) AS lexical_diversity FROM n LEFT JOIN p USING (brand) LEFT JOIN kk USING (brand)""")(
    lambda spark, d: TH.brand_profile(built(spark, d), spark.createDataFrame([(x,) for x in [*I.BRANDS, "brand9"]], "brand string")).select(
        "brand", "threads", F.round("dm_deflection_rate", 6).alias("dm"), F.round("handoff_rate", 6).alias("handoff"), "median_reply_chars", F.round("substantive_rate", 6).alias("substantive"),
        F.round("multi_turn_rate", 6).alias("multi_turn"), F.col("median_replies_per_thread").alias("median_replies"), F.round("lexical_diversity", 6).alias("lexical_diversity"),
    )
)
CAP = b("concat('42:', brand, ':', root)", 1_000_000_000)


@query("w1_cap_per_brand", f"{REC}, {I.OWNED} SELECT root, brand, row_number() OVER (PARTITION BY brand ORDER BY {CAP}, root) AS place FROM owned QUALIFY place <= 5")
def w1(spark, d):
    return TH.cap_per_brand(j3(spark, d), 5)


@query("w2_brand_of_root", f"{REC} SELECT r.root, arg_max(lower(l.author), l.id) AS brand FROM log l JOIN roots r USING (id) WHERE NOT l.inbound AND lower(l.author) LIKE 'brand%' GROUP BY r.root")
def w2(spark, d):
    log = I.message_log(spark, d)
    return TH.brand_of_root(log, TH.thread_roots(log), I.BRANDS)


query("w3_first_reply", f"{REC}, {THREADS} SELECT thread_id, replies[1] AS first_reply FROM th")(lambda spark, d: TH.first_reply(built(spark, d)).select("thread_id", "first_reply"))

SPLIT = b("concat('split:', thread_id)", 100)
RULE = f"coalesce({first_sql('customer_msg', T.HARD)}, CASE WHEN {first_sql('customer_msg', T.PII)} IS NOT NULL THEN concat('pii_', {first_sql('customer_msg', T.PII)}) END, 'rules_only')"
DEDUPE = "sha1(trim(regexp_replace(regexp_replace(lower(customer_msg), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')))"


@query("triage_rule_counts", f"""{REC}, {THREADS}, u AS (SELECT *, row_number() OVER (PARTITION BY {DEDUPE} ORDER BY CAST(thread_id AS BIGINT)) AS place FROM th WHERE {USABLE})
SELECT CASE WHEN {SPLIT} < 6 THEN 'golden_pool' ELSE 'history' END AS split, {RULE} AS triggered_rule, count(*) AS n FROM u WHERE place = 1 GROUP BY 1, 2""")
def triage(spark, d):
    """How many conversations would be escalated, and by which rule, per split."""
    from ..operators.route import pattern_route

    usable = built(spark, d).where(T.is_usable(F.col("customer_msg")))
    once = curate.near_dup_first(usable, "customer_msg", [F.col("thread_id").cast("long")])
    routed = pattern_route(curate.hash_split(once, "thread_id"))
    return routed.groupBy("split", "triggered_rule").agg(F.count("*").alias("n"))


@query("x1_stream_triage", f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS customer_msg FROM conversations WHERE role = 'user'), {I.VECTORS},
n AS (SELECT q.id, max({I.COS.format('q.vector', 'h.vector')}) AS s FROM v q JOIN v h ON NOT h.pool AND h.id <> q.id WHERE q.id IN (SELECT conv_id FROM c) GROUP BY q.id)
SELECT conv_id, turn, CASE WHEN {RULE} <> 'rules_only' THEN {RULE} WHEN v.cluster IN (0, 3) THEN 'never_auto_intent' WHEN coalesce(n.s, 0) < 0.3 THEN 'low_retrieval_similarity' ELSE 'rules_only' END AS triggered_rule
FROM c LEFT JOIN v ON v.id = conv_id LEFT JOIN n ON n.id = conv_id""")
def x1(spark, d):
    """User turns as a stream: joined with static classes and their policy, retrieval in every micro-batch."""
    files, sink = I.table(spark, d, "conversations"), place(spark, "stream-out")
    source = spark.readStream.schema(files.schema).parquet(f"{d}/conversations.parquet/" if _is_folder(files) else f"{d}/conversations.parquet*")
    vectors, history = I.vectors(spark, d).withColumnRenamed("id", "conv_id"), Neighbours(I.split_vectors(spark, d)[1].select("id", "vector"))
    classes = vectors.select("conv_id", F.concat(F.lit("c"), F.col("cluster")).alias("intent"))
    judged = stream.with_policy_of(source.where("role = 'user'"), classes, I.taxonomy(spark), "conv_id")
    stream.run_batches(judged, lambda rows: stream.route_batch(rows, vectors, history, "conv_id").select("conv_id", "turn", "triggered_rule"), f"triage-{uuid.uuid4().hex}", place(spark, "stream-state"), sink)
    return spark.read.schema("conv_id long, turn long, triggered_rule string").parquet(f"{sink}/*")


MESSAGE = "concat_ws(' ', event_type, props, CAST(user_id AS VARCHAR))"


@query("x2_stream_dedupe", f"""WITH RECURSIVE e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, {DEDUPE.replace('customer_msg', MESSAGE)} AS dedupe_key FROM events WHERE ts IS NOT NULL),
w(dedupe_key, ts) AS (SELECT dedupe_key, min(ts) FROM e GROUP BY 1 UNION ALL SELECT w.dedupe_key, min(e.ts) FROM w JOIN e ON e.dedupe_key = w.dedupe_key AND e.ts >= w.ts + INTERVAL 10 DAY GROUP BY w.dedupe_key)
SELECT min(e.event_id) AS event_id, w.dedupe_key FROM w JOIN e ON e.dedupe_key = w.dedupe_key AND e.ts = w.ts GROUP BY w.dedupe_key, w.ts""")
def x2(spark, d):
    """Events as a stream, driven to its end: a closing row far ahead lets the watermark pass all others."""
    files = I.table(spark, d, "events")
    columns = files.select("event_id", "event_type", "props", "user_id", "ts")
    end = place(spark, "stream-closing")
    columns.limit(0).unionByName(spark.sql("SELECT -1 AS event_id, '' AS event_type, '' AS props, 0 AS user_id, TIMESTAMP '2200-01-01 00:00:00' AS ts").select(*(F.col(c).cast(t).alias(c) for c, t in columns.dtypes))).write.parquet(end)
    stored = spark.readStream.schema(files.schema).parquet(f"{d}/events.parquet/" if _is_folder(files) else f"{d}/events.parquet*")
    source = stored.select(*columns.columns).unionByName(spark.readStream.schema(columns.schema).parquet(end)).where("ts is not null")
    keyed = source.withColumn("message", F.concat_ws(" ", "event_type", "props", F.col("user_id").cast("string"))).withColumn("ts", F.col("ts").cast("timestamp"))
    once = stream.stream_dedupe(keyed, "message", "ts", "event_id", "10 days")
    return stream.run_to_end(once, f"dedupe-{uuid.uuid4().hex}", place(spark, "stream-state"), place(spark, "stream-out")).where("id <> -1").select(F.col("id").alias("event_id"), "dedupe_key")


def _is_folder(files) -> bool:
    return not files.inputFiles()[0].split("?")[0].endswith((".parquet",)) or files.inputFiles()[0].rsplit("/", 1)[-1].startswith("part-")
