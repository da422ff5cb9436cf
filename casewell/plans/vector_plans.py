"""Queries of retrieval, clustering, features and fitted models over the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import text_key
from ..operators import agreement, features, models, sparse_svd
from ..operators import vectors as V
from ..operators.curate import hash_split
from ..scratch import saved
from . import inputs as I
from .registry import query, with_

KEY = "sha256(concat('local|64|', text))"
query("j5_missing_vectors", f"SELECT DISTINCT {KEY} AS key FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")(
    lambda spark, d: V.missing_vectors(
        I.table(spark, d, "documents"), "text", I.table(spark, d, "documents").where("doc_id % 2 = 0").select(text_key(F.col("text"), "local", 64).alias("key")), "local", 64
    ).select("key")
)


def hits(spark, d, k=5):
    pool, history = I.split_vectors(spark, d)
    return V.knn_topk(pool, history, k)


query("j10_knn_topk", with_(I.VECTORS, I.HITS) + "SELECT query_id, id, rank, round(similarity, 6) AS similarity FROM hits")(
    lambda spark, d: hits(spark, d).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))
)


@query("w4_topk_per_query", with_(I.VECTORS, I.HITS) + "SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 3")
def w4(spark, d):
    return V.topk_per_query(hits(spark, d).drop("rank").withColumn("similarity", F.round("similarity", 12)), 3).select("query_id", "id", "rank")


#: Centroids of the given classes, by position.
CENTRES = """e AS (SELECT id, cluster, pool, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v),
c0 AS (SELECT cluster, i, avg(x) AS x FROM e GROUP BY cluster, i),
centre AS (SELECT cluster AS cluster_id, list(x ORDER BY i) AS centroid FROM c0 GROUP BY cluster)"""
query("j11_assign_clusters", with_(I.VECTORS, CENTRES) + "SELECT id, arg_max(cluster_id, (round(list_dot_product(vector, centroid), 12), -cluster_id)) AS cluster_id FROM v CROSS JOIN centre GROUP BY id")(
    lambda spark, d: V.assign_clusters(I.vectors(spark, d), V.centroids(I.vectors(spark, d)))
)
CENTRAL = "near AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY round(list_dot_product(vector, centroid), 9) DESC, id) AS place FROM v JOIN centre ON cluster = cluster_id)"
query("w5_central_members", with_(I.VECTORS, CENTRES, CENTRAL) + "SELECT cluster, id, place FROM near WHERE place <= 25")(
    lambda spark, d: V.central_members(I.vectors(spark, d), V.centroids(I.vectors(spark, d)), 25)
)
query("g4_cluster_profile", with_(I.VECTORS, CENTRES, CENTRAL) + """SELECT cluster, size, round(size / CAST(sum(size) OVER () AS DOUBLE), 6) AS share, exemplars FROM (SELECT cluster, count(*) AS size FROM v GROUP BY cluster)
JOIN (SELECT cluster, array_to_string(list(id ORDER BY place), ',') AS exemplars FROM near WHERE place <= 8 GROUP BY cluster) USING (cluster)""")(
    lambda spark, d: V.cluster_profile(I.vectors(spark, d)).select("cluster", "size", F.round("share", 6).alias("share"), F.array_join(F.transform("exemplars", lambda x: x.cast("string")), ",").alias("exemplars"))
)


def _halved(df):
    return df.withColumn("vector", F.slice("vector", 1, 32))


@query("g28_retrieval_agreement", with_(I.VECTORS, I.HITS, "v2 AS (SELECT id, vector[1:32] AS vector, pool FROM v)", f"s2 AS (SELECT q.id AS query_id, c.id, {I.COS.format('q.vector', 'c.vector')} AS similarity FROM v2 q JOIN v2 c ON q.pool AND NOT c.pool)",
    "h2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS rank FROM s2 QUALIFY rank <= 5)",
    "l AS (SELECT query_id, list(id) AS ids, max(id) FILTER (rank = 1) AS one, max(similarity) FILTER (rank = 1) AS s FROM hits GROUP BY 1)", "r AS (SELECT query_id, list(id) AS ids, max(id) FILTER (rank = 1) AS one, max(similarity) FILTER (rank = 1) AS s FROM h2 GROUP BY 1)")
    + "SELECT count(*) AS n, round(avg(CASE WHEN l.one = r.one THEN 1.0 ELSE 0.0 END), 6) AS top1_identical, round(avg(len(list_intersect(l.ids, r.ids)) / 5.0), 6) AS mean_overlap, round(avg(l.s), 6) AS left_similarity, round(avg(r.s), 6) AS right_similarity FROM l JOIN r USING (query_id)")
def g28(spark, d):
    pool, history = I.split_vectors(spark, d)
    found = agreement.retrieval_agreement(V.knn_topk(pool, history), V.knn_topk(_halved(pool), _halved(history)))
    return found.select("n", *(F.round(c, 6).alias(c) for c in found.columns if c != "n"))


@query("s5_shared_hits", with_(I.VECTORS, I.HITS, "l AS (SELECT query_id, list(id) AS ids FROM hits GROUP BY 1)", "r AS (SELECT query_id, list(id) AS ids FROM hits WHERE rank <= 3 GROUP BY 1)") + "SELECT query_id, len(list_intersect(l.ids, r.ids)) AS shared FROM l JOIN r USING (query_id)")
def s5(spark, d):
    found = hits(spark, d)
    per = found.groupBy("query_id").agg(F.collect_set("id").alias("l"), F.collect_set(F.when(F.col("rank") <= 3, F.col("id"))).alias("r"))
    return per.select("query_id", F.size(F.array_intersect("l", "r")).cast("long").alias("shared"))


MESSAGES = "doc AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents)"
GRAMS = r"""w AS (SELECT id, concat(' ', unnest(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '')), ' ') AS w FROM doc),
g AS (SELECT id, unnest(list_concat(list_concat([substr(w, i, 3) for i in range(1, greatest(length(w) - 3 + 1, 1) + 1)], CASE WHEN length(w) >= 4 THEN [substr(w, i, 4) for i in range(1, length(w) - 4 + 2)] ELSE [] END), CASE WHEN length(w) >= 5 THEN [substr(w, i, 5) for i in range(1, length(w) - 5 + 2)] ELSE [] END)) AS term FROM w),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2)"""


def messages(spark, d):
    """Whole texts of documents."""
    return I.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("message"), "lang")


query("m1_char_wb_ngrams", with_(MESSAGES, GRAMS) + "SELECT id, term, tf FROM tf")(lambda spark, d: features.term_counts(messages(spark, d), "message"))
TFIDF = with_(MESSAGES, GRAMS, "vo AS (SELECT term, ln((1 + (SELECT count(*) FROM doc)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 2)", "wt AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vo USING (term))")
query("m2_tfidf", TFIDF + "SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM wt")(
    lambda spark, d: features.tfidf(messages(spark, d), "message").withColumn("weight", F.round("weight", 6))
)


def text_vectors(spark, d):
    """id, vector, split: TF-IDF of whole texts on the first 256 right singular vectors of the history's rows."""
    terms, rows = features.sparse_counts(messages(spark, d), "message")
    rows, idf = saved(hash_split(rows, "id"), "tfidf-rows"), features.by_place(terms)
    _, basis = sparse_svd.truncated_svd(rows.where("split = 'history'"), terms.count(), idf=idf)
    return saved(hash_split(sparse_svd.project(rows, basis, idf), "id").drop("bucket"), "tfidf-projected")


def _pool_and_history(vectors):
    return vectors.where("split = 'golden_pool'").select(F.col("id").alias("query_id"), "vector"), vectors.where("split = 'history'").select("id", "vector")


@query("m3_svd_project")
def m3(spark, d):
    """Retrieval by text alone: the exact top 5 among projected TF-IDF rows."""
    found = V.knn_topk(*_pool_and_history(text_vectors(spark, d)))
    return found.select("query_id", "id", "rank", F.round("similarity", 4).alias("similarity"))


@query("g28_backend_comparison")
def g28_backends(spark, d):
    """Both rankers over the same queries and the same corpus, the messages that have a vector: dense vectors against TF-IDF."""
    dense = hash_split(I.vectors(spark, d).select("id", "vector"), "id")
    sparse = text_vectors(spark, d)
    both = [x.join(y.select("id"), "id", "left_semi") for x, y in ((dense, sparse), (sparse, dense))]
    found = agreement.retrieval_agreement(*(V.knn_topk(*_pool_and_history(x)) for x in both))
    return found.select("n", *(F.round(c, 6).alias(c) for c in found.columns if c != "n"))


query("m4_kmeans")(lambda spark, d: models.kmeans_assign(I.vectors(spark, d).drop("cluster"), 10))
query("m5_choose_k")(lambda spark, d: models.choose_k(I.vectors(spark, d).drop("cluster")))
query("m6_logreg_oof")(
    lambda spark, d: models.logreg_oof(messages(spark, d).where("lang is not null").select("id", F.col("lang").alias("label"), "message")).select("id", "label", "pred", "fold")
)
REPLIES = "CASE id % 3 WHEN 0 THEN 'please dm us' ELSE 'we fixed it' END"
query("m7_nn_reply", with_(I.VECTORS, I.HITS) + f"SELECT query_id, {REPLIES} AS reply, round(similarity, 6) AS max_similarity FROM hits WHERE rank = 1")(
    lambda spark, d: models.nn_reply(hits(spark, d, 1).withColumn("brand_reply", F.expr(REPLIES))).select("query_id", "reply", F.round("max_similarity", 6).alias("max_similarity"))
)
