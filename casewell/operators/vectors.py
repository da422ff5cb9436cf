"""Similarity over vector tables: exact top-k, cluster assignment, central members, missing vectors, projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import text_key
from ..session import ship
from .pivots import PivotIndex, ranked

#: Queries and corpus rows of a block.
QUERY_BLOCK, CORPUS_BLOCK = 8192, 16_384
#: Tasks whose parts of a square are added up together.
TASKS_ADDED = 256


def distinct_messages(rows: DataFrame, message: str) -> DataFrame:
    return rows.select(F.col(message).alias("text")).where("text is not null").distinct()


def missing_vectors(rows: DataFrame, message: str, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """key, text of distinct messages that have no vector yet."""
    texts = distinct_messages(rows, message).withColumn("key", text_key(F.col("text"), model, dim))
    return texts.join(vectors.select("key"), "key", "left_anti").select("key", "text")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _block_topk(k: int):
    def best(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        if not len(queries) or not len(corpus):
            return none
        asked, names, q, c, parts = queries.query_id.to_numpy(), corpus.id.to_numpy(), _unit(_matrix(queries.asked)), _unit(_matrix(corpus.held)), [none]
        for i in range(0, len(q), 1024):
            s = q[i : i + 1024] @ c.T
            n = min(k, len(names))
            # ties at the cut go to smaller ids: of what equals the k-th best within rounding, the k smallest ids stay
            kth = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            r, j = np.nonzero(s > kth + 1e-12)
            tr, tj = np.nonzero(np.abs(s - kth) <= 1e-12)
            order = np.lexsort((names[tj], tr))
            tr, tj = tr[order], tj[order]
            kept = np.arange(len(tr)) - np.searchsorted(tr, tr) < k
            r, j = np.concatenate([r, tr[kept]]), np.concatenate([j, tj[kept]])
            parts.append(pd.DataFrame({"query_id": asked[i : i + 1024][r], "id": names[j], "similarity": s[r, j]}))
        return pd.concat(parts)

    return best


class Neighbours:
    """Exact top-k of one corpus (id, vector) for any number of searches: a corpus of more than one block gets a pivot index,
    which is made once and of which queries visit only the shells that can hold a neighbour; a smaller one is scored as it
    is, by blocks of queries. No pair of rows passes the driver."""

    def __init__(self, corpus: DataFrame):
        ship(corpus.sparkSession)
        self.corpus = corpus
        self.index = PivotIndex(corpus) if corpus.count() > CORPUS_BLOCK else None

    def topk(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, id, similarity, rank: the k most similar corpus rows by cosine, exactly; ties to smaller ids."""
        if self.index:
            return ranked(self.index.search(queries, k), k)
        n_q = max(1, -(-queries.count() // QUERY_BLOCK))
        q = queries.select("query_id", F.col("vector").alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("qb"))
        c = self.corpus.select("id", F.col("vector").alias("held"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
        # names differ by side: both may come from one table, and a cogroup would take their columns for the same
        scored = q.groupBy("qb").cogroup(c.groupBy("qb")).applyInPandas(_block_topk(k), "query_id long, id long, similarity double")
        return ranked(scored, k)


def knn_topk(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """One search (``Neighbours``)."""
    return Neighbours(corpus).topk(queries, k)


def topk_per_query(scored: DataFrame, k: int) -> DataFrame:
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))
    return best.where(F.col("rank") <= k)


def exemplar_hits(hits: DataFrame, threads: DataFrame) -> DataFrame:
    """Hits with message, first reply and deflection flag of the thread found (id, thread_id, customer_msg, brand_reply)."""
    return hits.join(threads, "id").withColumn("is_deflection", T.is_deflection(F.col("brand_reply")))


def centroids(vectors: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster_id, centroid (mean of the members' vectors), by position: no vector is collected."""
    parts = vectors.select(cluster, F.posexplode("vector").alias("i", "x")).groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return parts.groupBy(cluster).agg(arr.alias("centroid")).withColumnRenamed(cluster, "cluster_id")


def assign_clusters(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """id, cluster_id of the largest inner product (not distance); ties to the smaller cluster. One row per centroid is broadcast."""
    pairs = vectors.select("id", "vector").join(F.broadcast(centres.select(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("all"))), F.lit(True))
    scored = F.transform("all", lambda c: F.struct(F.round(T.dot(F.col("vector"), c["centroid"]), 12).alias("s"), (-c["cluster_id"]).alias("m")))
    return pairs.select("id", (-F.array_max(scored)["m"]).alias("cluster_id"))


def central_members(vectors: DataFrame, centres: DataFrame, n: int = 25, cluster: str = "cluster") -> DataFrame:
    """cluster, id, place of the n members nearest to their own centroid by inner product."""
    own = vectors.join(F.broadcast(centres.withColumnRenamed("cluster_id", cluster)), cluster)
    scored = own.select(cluster, "id", F.round(T.dot(F.col("vector"), F.col("centroid")), 9).alias("s"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("s"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= n).select(cluster, "id", "place")


def cluster_profile(vectors: DataFrame, shown: int = 8, cluster: str = "cluster") -> DataFrame:
    """cluster, size, share and the ids of up to ``shown`` central members."""
    sizes = vectors.groupBy(cluster).agg(F.count("*").alias("size"))
    whole = Window.partitionBy(F.lit(1))
    sizes = sizes.withColumn("share", F.col("size") / F.sum("size").over(whole))
    near = central_members(vectors, centroids(vectors, cluster), shown, cluster)
    shown_ids = near.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda e: e["id"]).alias("exemplars"))
    return sizes.join(shown_ids, cluster)


def right_singular(vectors: DataFrame, k: int) -> np.ndarray:
    """The first k right singular vectors (columns) of the rows, not centred. Every task adds up its part of the square
    of products, which is as large as a vector is long, squared; the rows themselves stay where they are. Parts are added
    up by ``TASKS_ADDED`` tasks first, then their sums: a million tasks are groups of some thousand rows."""

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for pdf in batches:
            if len(pdf):
                m = _matrix(pdf.vector)
                total = total + m.T @ m
        if isinstance(total, np.ndarray):
            yield pd.DataFrame({"task": TaskContext.get().partitionId(), "i": np.arange(len(total), dtype=np.int32), "row": list(total)})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf.i[:1], "row": [_matrix(pdf.row).sum(axis=0)]})

    parts = vectors.select("vector").mapInPandas(squares, "task int, i int, row array<double>")
    sums = parts.groupBy("i", F.expr(f"task div {TASKS_ADDED}")).applyInPandas(added, "i int, row array<double>")
    rows = sums.groupBy("i").applyInPandas(added, "i int, row array<double>").orderBy("i").toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    values, basis = np.linalg.eigh(_matrix(rows.row))
    order = np.argsort(-values)[:k]
    return basis[:, order[values[order] > 1e-12 * max(values.max(), 1e-300)]]


def svd_project(fit_on: DataFrame, rows: DataFrame, k: int = 256) -> DataFrame:
    """id, vector: rows projected on the first k right singular vectors of ``fit_on``, at unit length."""
    ship(rows.sparkSession)
    basis = right_singular(fit_on, k)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf.id, "vector": list(_unit(_matrix(pdf.vector) @ basis))})

    return rows.select("id", "vector").mapInPandas(project, "id long, vector array<double>")
