"""Fitted models: k-means with restarts, the k sweep, out-of-fold logistic regression; baselines."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import saved
from . import sweep
from .features import sparse_features, sparse_weights, term_totals, vocabulary
from .metrics import majority_class
from .sample import position_folds
from .sparse_svd import term_places

#: Fixed value: the canned reply.
CANNED_REPLY = "Sorry for the trouble! We'd like to help. Please share more details so we can look into this for you."

#: MB of rows that a task of the regression multiplies at a time: each such block also costs a pass over classes x terms numbers.
BLOCK_MB = 32.0


def kmeans_assign(vectors: DataFrame, k: int, seed: int = 42, restarts: int = 4) -> DataFrame:
    """id, cluster of the model of the lowest cost among the restarts, which advance together."""
    found = sweep.fits(vectors, [k], [seed + i for i in range(restarts)])
    if not found:
        return vectors.select("id", F.lit(None).cast("int").alias("cluster"))
    return sweep.assigned(vectors, min(found.values(), key=lambda m: m[1])[0])


def choose_k(vectors: DataFrame, ks=range(8, 24, 2), seed: int = 42, restarts: int = 4) -> DataFrame:
    """k, silhouette (cosine, four digits, over all rows), chosen: the best score, the lowest k on ties. All models of the
    sweep advance in the same scans: at most ``sweep.ROUNDS`` + 3 of them, whatever the number of models."""
    found = sweep.fits(vectors, list(ks), [seed + i for i in range(restarts)])
    best = {k: min((m for (own, _), m in found.items() if own == k), key=lambda m: m[1])[0] for k in ks} if found else {}
    scores = {k: round(s, 4) for k, s in sweep.silhouettes(vectors, best).items()} if best else {}
    chosen = min(scores, key=lambda k: (-scores[k], k), default=None)
    return vectors.sparkSession.createDataFrame([(int(k), scores[k], k == chosen) for k in ks if k in scores], "k int, silhouette double, chosen boolean")


def logreg_oof(messages: DataFrame, folds: int = 5, most: int = 100_000, iterations: int = 100) -> DataFrame:
    """id, label, pred, confidence, fold: a balanced multinomial regression on the character TF-IDF of the ``most`` most
    frequent terms, every row predicted by a model whose vocabulary, weights and coefficients come from the other folds.
    messages: id, label (text), message. Messages without a known term are predicted from the intercepts."""
    rows = saved(position_folds(messages.select("id", "label", "message"), "id", folds), "oof-rows")
    totals = saved(term_totals(rows, "message", "fold").groupBy("part", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "oof-terms")
    sizes = rows.groupBy("label", "fold").agg(F.count("*").alias("n")).toPandas()  # one row per class and fold
    labels = sorted(sizes.label.unique())
    number = F.element_at(F.create_map(*(F.lit(x) for i, name in enumerate(labels) for x in (name, float(i)))), F.col("label"))
    out = None
    for k in range(folds):
        own = sizes[sizes.fold != k].groupby("label").n.sum()
        n = int(own.sum())
        weight = F.element_at(F.create_map(*(F.lit(x) for name, c in own.items() for x in (name, n / (len(own) * float(c))))), F.col("label"))
        terms = term_places(vocabulary(totals.where(F.col("part") != k), n, 1, most))
        every = rows.select("id", "label", "fold", number.alias("number"), weight.alias("weight"), "message")
        full = sparse_features(sparse_weights(every, "message", terms), max(1, terms.count()))
        model = LogisticRegression(standardization=False, regParam=1.0 / max(1, n), weightCol="weight", labelCol="number", maxIter=iterations, maxBlockSizeInMB=BLOCK_MB).fit(full.where(F.col("fold") != k))
        pred = F.element_at(F.array(*map(F.lit, labels)), (F.col("prediction") + 1).cast("int"))
        one = model.transform(full.where(F.col("fold") == k)).select("id", "label", pred.alias("pred"), F.array_max(vector_to_array("probability")).alias("confidence"), "fold")
        out = one if out is None else out.unionByName(one)
    return out


def nn_reply(hits: DataFrame) -> DataFrame:
    """query_id, reply, grounded_in, max_similarity: the reply of the nearest hit, copied."""
    return hits.where("rank = 1").select("query_id", F.col("brand_reply").alias("reply"), F.array(F.lit("E1")).alias("grounded_in"), F.col("similarity").alias("max_similarity"))


def trivial_policies(messages: DataFrame, labelled: DataFrame, label: str = "label", position: str = "id") -> DataFrame:
    """Both trivial systems: the majority class, a canned reply, and one action for every message."""
    best = F.broadcast(majority_class(labelled, label, position).select(F.col("label").alias("intent")))
    rows = messages.join(best, F.lit(True)).withColumn("reply", F.lit(CANNED_REPLY))
    policies = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.lit(a).alias("action")) for s, a in (("trivial_always_auto", "auto"), ("trivial_always_escalate", "escalate")))))
    return rows.withColumn("p", policies).select(*messages.columns, "intent", "reply", "p.system", "p.action")
