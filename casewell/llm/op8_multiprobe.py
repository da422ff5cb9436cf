"""Operator 8, approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to unit length, so the largest cosine is the smallest distance. Each of ``TABLES``
tables cuts ``PROJECTIONS`` Gaussian projections into slots. A query knows how far inside its slots it
lies, so for a neighbour at distance d every perturbed bucket has a known chance to hold it. Buckets
are visited down to the chance at which the visited ones hold the neighbour with probability
``CHANCE`` (found from ``DRAWS`` simulated neighbours, not by listing buckets); rows of visited buckets
are scored exactly in double precision and the tables' candidates are merged.

d is local to the query, in three passes. Pass 1 visits the few likeliest buckets (``FIRST``). Pass 2
probes with the k-th distance that pass 1 found, or the one that a sample (a quarter of the rows, 256 to
``SAMPLE`` vectors) leads to expect among all rows, if smaller. A query that has fewer than k hits, or whose k-th hit is farther than
its k-th neighbour in the sample, has certainly missed one: pass 3 scores it against all rows, in blocks.

Rows are dealt to cells by the slots of a table's first projections; a query goes only to cells that
hold a visited bucket, a cell of more than ``CELL`` rows is split, and so are queries beyond
``QUERY_BLOCK``, so no task gets an unbounded group. Vectors of equal direction (13 digits of their
unit vectors) are one class with its smallest ids, at most k + 1, all that a result can hold. Where
many classes share the last place, those with the smallest ids stay.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
parts take no part, nor do null ids; repeated (id, vector) rows count once; scores that agree within
1e-12 are ties and go to the smaller id; fewer candidates than k are all returned; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces_for, saved, ship, table

TABLES, PROJECTIONS, CHANCE, FIRST, DRAWS, SAMPLE, CELL, QUERY_BLOCK, SEED = 2, 8, 0.8, 0.1, 256, 2048, 8192, 16_384, 11
#: Most coarse cells of a table; rows that a cell should have at least, on average.
CELLS, LEAST_CELL = 4096, 2048
TIE = 1e-12
FOUND = "q1 long, q2 long, c1 long, c2 long, first long, near double, scored long"


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, error below 1.5e-7."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return 0.5 * (1 + np.sign(z) * erf)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def units(m: np.ndarray) -> np.ndarray:
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny)


def kth_distance(u: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Distance of each row to its k-th other direction in the sample; infinite where there are fewer."""
    gap = np.sqrt(np.maximum(0, 2 - 2 * u @ sample.T))
    gap[gap < 1e-6] = np.inf
    return np.partition(gap, k - 1, axis=1)[:, k - 1] if gap.shape[1] >= k else np.full(len(u), np.inf)


class Hashes:
    """Projections of every table, from a seed; their slot width and cells, fitted to a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, n_classes: int, k: int):
        self.sample, self.k, half = sample, k, sample[: len(sample) // 2]
        probe = sample[-256:]
        whole, part = kth_distance(probe, sample, k), kth_distance(probe, half, k)
        known = np.isfinite(part) & np.isfinite(whole)
        #: The k-th distance shrinks by this much when the rows double; so it is carried on from the sample to all rows,
        #: with care: what pass 1 finds corrects a distance that is too large, but none that is too small.
        shrink = float(np.clip(np.median(whole[known] / part[known]), 0.95, 1.0)) if known.any() else 1.0
        self.carry = shrink ** max(0.0, float(np.log2(max(1, n_classes) / len(sample))))
        middle = float(np.median(whole[np.isfinite(whole)])) * self.carry if np.isfinite(whole).any() else 1.0
        self.width = float(np.clip(1.5 * middle, 0.5, 1.5))
        self.reach = int(np.ceil(3.5 / self.width))
        self.base = 2 * self.reach + 1
        self.coarse = 0
        while self.base ** (self.coarse + 1) <= min(CELLS, n_classes // LEAST_CELL):
            self.coarse += 1
        rng = np.random.default_rng(SEED)
        self.a = rng.standard_normal((TABLES, sample.shape[1], PROJECTIONS))
        self.b = rng.uniform(0, self.width, (TABLES, PROJECTIONS))
        self.draws = rng.standard_normal((DRAWS, PROJECTIONS))

    def slots(self, x: np.ndarray) -> np.ndarray:
        """Slot numbers 0 to base - 1; the outermost are open."""
        return (np.clip(np.floor(x / self.width), -self.reach, self.reach) + self.reach).astype(np.int64)

    def cell(self, slots: np.ndarray) -> np.ndarray:
        return slots[:, : self.coarse] @ (self.base ** np.arange(self.coarse, dtype=np.int64))

    def place(self, u: np.ndarray, t: int) -> np.ndarray:
        return u @ self.a[t] + self.b[t]

    def chances(self, x: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Log chance that a neighbour at the distance lies in each slot of each projection: queries, projections, slots."""
        edge = (np.arange(-self.reach, self.reach) + 1) * self.width
        up = normal_cdf((edge[None, None, :] - x[:, :, None]) / np.maximum(distance, 1e-6)[:, None, None])
        whole = np.concatenate([np.zeros((*x.shape, 1)), up, np.ones((*x.shape, 1))], axis=2)
        return np.log(np.maximum(np.diff(whole, axis=2), 1e-30))

    def least(self, x: np.ndarray, distance: np.ndarray, log: np.ndarray, chance: float) -> np.ndarray:
        """The log chance down to which buckets are visited."""
        at = self.slots(x[:, None, :] + distance[:, None, None] * self.draws[None])
        drawn = np.take_along_axis(log, at.transpose(0, 2, 1), axis=2).sum(axis=1)
        return np.quantile(drawn, 1 - chance, axis=1, method="lower")

    def cells(self, log: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        """Per query the cells that may hold a visited bucket."""
        best = log[:, self.coarse :].max(axis=2).sum(axis=1)[:, None]
        for j in reversed(range(self.coarse)):
            best = (best[:, :, None] + log[:, j][:, None, :]).reshape(len(log), -1)
        return [np.flatnonzero(b) for b in best >= least[:, None] - 1e-4]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, v and two halves of a digest of the direction."""
    import xxhash

    for batch in batches:
        v = batch.column(1)
        m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        near = np.round(units(m), 13) + 0.0 if len(v) else m
        keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(r.tobytes()), np.int64) for r in near], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["vec_id", "v", "k1", "k2"])


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (common[0]["n"] if common else 0))
    return rows.mapInArrow(_keyed, f"vec_id long, v {dict(rows.dtypes)['v']}, k1 long, k2 long")


def best_of(s: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k + 1 largest of every row; of those that tie for the last place, k + 1 with the least ``first``."""
    seen = s > -np.inf
    kth = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)][:, None] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
    low = np.where(kth > -np.inf, kth, -9.0)
    r, c = np.nonzero(seen & (s > low + TIE))
    tr, tc = np.nonzero(seen & (np.abs(s - low) <= TIE))
    order = np.lexsort((first[tc], tr))
    tr, tc = tr[order], tc[order]
    kept = np.arange(len(tr)) - np.searchsorted(tr, tr) <= k
    return np.concatenate([r, tr[kept]]), np.concatenate([c, tc[kept]])


class Search:
    """asked: query_id, its vector and class; heads: ids of every class; found: classes that may be among a query's nearest."""

    def __init__(self, vectors: DataFrame, k: int, every: int, id_column: str, vector_column: str):
        ship(vectors.sparkSession)
        rows = saved(usable(vectors, id_column, vector_column).dropDuplicates(["vec_id", "k1", "k2"]), "vectors")
        self.k, self.kind = k, dict(rows.dtypes)["v"]
        place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
        self.heads = saved(rows.withColumn("place", place).where(F.col("place") <= k + 1), "vector-heads")
        self.asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", F.col("k1").alias("q1"), F.col("k2").alias("q2"))
        self.classes = self.heads.where("place = 1").select("k1", "k2", F.col("vec_id").alias("first"), "v")
        n = self.classes.count()
        sample = self.classes.orderBy("k1", "k2").limit(max(256, min(SAMPLE, n // 4))).select("v").toPandas()
        if n:
            self._search(Hashes(units(matrix(sample.v)), n, k))
        else:
            self.found = vectors.sparkSession.createDataFrame([], FOUND)

    def _search(self, hashes: Hashes) -> None:
        self.hashes, k = hashes, self.k

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(bound=kth_distance(units(matrix(pdf.v)), hashes.sample, k) if len(pdf) else np.zeros(0))

        def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                u = units(matrix(pdf.v)) if len(pdf) else None
                for t in range(TABLES if len(pdf) else 0):
                    yield pd.DataFrame({"t": np.int32(t), "cell": hashes.cell(hashes.slots(hashes.place(u, t))).astype(np.int32), "k1": pdf.k1, "k2": pdf.k2, "first": pdf["first"], "v": pdf.v})

        wanted = self.classes.join(self.asked.select(F.col("q1").alias("k1"), F.col("q2").alias("k2")).distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "v")
        self.queries = saved(wanted.mapInPandas(bound, f"k1 long, k2 long, v {self.kind}, bound double"), "queries")
        self.blocks = pieces_for(self.queries.count(), QUERY_BLOCK)
        m = saved(self.classes.mapInPandas(members, f"t int, cell int, k1 long, k2 long, first long, v {self.kind}"), "hash-members")
        #: One row per cell: at most TABLES * CELLS of them.
        self.parts = saved(m.groupBy("t", "cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")), "hash-cells")
        self.members = m.join(F.broadcast(self.parts), ["t", "cell"]).withColumn("part", F.pmod("k1", "parts").cast("int")).drop("parts")

        found = self._probe(self.queries.withColumn("guess", F.col("bound") * hashes.carry), FIRST)
        near = self._kth(found).withColumn("guess", F.least("reached", F.col("bound") * hashes.carry))
        found = found.unionByName(self._probe(near.select(*self.queries.columns, "guess"), CHANCE, hashes.carry))
        missed = saved(self._kth(found).where("reached is null or reached > bound + 1e-9").select(*self.queries.columns, F.lit(1.0).alias("guess")), "queries-missed")
        self.n_missed = missed.count()
        self.found = found.unionByName(self._probe(missed, None)) if self.n_missed else found

    def _kth(self, found: DataFrame) -> DataFrame:
        """The queries with the distance of the k-th class found, null if there are fewer."""
        others = found.where("q1 <> c1 or q2 <> c2").groupBy("q1", "q2", "c1", "c2").agg(F.max("near").alias("near"))
        place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("near")))
        kth = others.withColumn("place", place).where(F.col("place") <= self.k).where(F.col("place") == self.k)
        reached = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("near"))).alias("reached")
        return self.queries.join(kth.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), reached), ["k1", "k2"], "left")

    def _probe(self, queries: DataFrame, chance: float | None, carry: float | None = None) -> DataFrame:
        """Classes found in visited buckets; without a chance in all rows (by the first table). With ``carry`` the
        buckets that pass 1 has visited are left out."""
        hashes, k = self.hashes, self.k

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                u, d = units(matrix(pdf.v)) if len(pdf) else None, np.minimum(pdf.guess.to_numpy(float), 2.0)
                for t in range((TABLES if chance else 1) if len(pdf) else 0):
                    x = hashes.place(u, t)
                    log = hashes.chances(x, d)
                    least = hashes.least(x, d, log, chance) if chance else np.full(len(x), -1e9)
                    cells, old, done = hashes.cells(log, least), d, np.full(len(x), np.inf)
                    if carry:
                        old = np.minimum(pdf.bound.to_numpy(float) * carry, 2.0)
                        done = hashes.least(x, old, hashes.chances(x, old), FIRST)
                    yield pd.DataFrame({"t": np.int32(t), "cells": cells, "least": least, "guess": d, "done": done, "old": old, "k1": pdf.k1, "k2": pdf.k2, "v": pdf.v})

        def reached(u: np.ndarray, t: int, hot: np.ndarray, distance: pd.Series, least: pd.Series) -> np.ndarray:
            """Queries by buckets: whether the bucket's chance is high enough."""
            log = hashes.chances(hashes.place(u, t), distance.to_numpy()).reshape(len(u), -1).astype(np.float32)
            return log @ hot.T >= least.to_numpy()[:, None] - 1e-4

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({c: np.zeros(0, float if c == "near" else np.int64) for c in ("q1", "q2", "c1", "c2", "first", "near", "scored")})]
            if not len(left) or not len(right):
                return out[0]
            t = int(right.t.iloc[0])
            w = units(matrix(right.v))
            slots, bucket = np.unique(hashes.slots(hashes.place(w, t)), axis=0, return_inverse=True)
            order = np.argsort(bucket, kind="stable")
            w, right, ends = w[order], right.iloc[order], np.cumsum(np.bincount(bucket.ravel(), minlength=len(slots)))
            hot = np.zeros((len(slots), PROJECTIONS * hashes.base), np.float32)
            np.put_along_axis(hot, slots + hashes.base * np.arange(PROJECTIONS), 1, axis=1)
            first, key = right["first"].to_numpy(), right[["k1", "k2"]].to_numpy()
            for i in range(0, len(left), 256):
                some = left.iloc[i : i + 256]
                u = units(matrix(some.v))
                visited = reached(u, t, hot, some.guess, some.least)
                if carry:
                    visited &= ~reached(u, t, hot, some.old, some.done)
                s, low = np.full((len(u), len(w)), -np.inf), 0
                for b, high in enumerate(ends):
                    who = np.flatnonzero(visited[:, b])
                    if len(who):
                        s[who, low:high] = u[who] @ w[low:high].T
                    low = high
                r, c = best_of(s, first, k)
                scored = np.zeros(len(r), np.int64)
                one, at = np.unique(r, return_index=True)
                scored[at] = (s[one] > -np.inf).sum(axis=1)
                q = some[["k1", "k2"]].to_numpy()[r]
                out.append(pd.DataFrame({"q1": q[:, 0], "q2": q[:, 1], "c1": key[c, 0], "c2": key[c, 1], "first": first[c], "near": s[r, c], "scored": scored}))
            return pd.concat(out)

        q = queries.repartition(max(8, self.blocks), "k1").mapInPandas(visits, f"t int, cells array<int>, least double, guess double, done double, old double, k1 long, k2 long, v {self.kind}")
        q = q.withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(self.parts), ["t", "cell"])
        q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod("k1", F.lit(self.blocks)).cast("int")).drop("parts")
        if self.blocks > 1:  # a cell goes only to the blocks of queries that visit it
            q = saved(q, "hash-visits")
            seen = q.select(F.col("t").alias("vt"), F.col("cell").alias("vc"), F.col("block").alias("for_block")).distinct()
            m = self.members.join(seen, (F.col("t") == F.col("vt")) & (F.col("cell") == F.col("vc"))).drop("vt", "vc")
        else:
            m = self.members.withColumn("for_block", F.lit(0))
        key = ["t", "cell", "part", "block"]
        return saved(q.groupBy(*key).cogroup(m.groupBy(*key[:3], "for_block")).applyInPandas(score, FOUND), "hash-found")

    def nearest(self) -> DataFrame:
        merged = self.found.groupBy("q1", "q2", "c1", "c2").agg(F.max("near").alias("near"), F.min("first").alias("first"))
        place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc(F.round("near", 12)), "first"))
        best = merged.withColumn("place", place).where(F.col("place") <= self.k + 1).select("q1", "q2", F.col("c1").alias("k1"), F.col("c2").alias("k2"))
        pairs = best.join(self.heads.select("k1", "k2", "vec_id", F.col("v").alias("w")), ["k1", "k2"]).join(self.asked, ["q1", "q2"]).where("vec_id <> query_id")
        v, w = (_wide(c, self.kind) for c in ("v", "w"))
        out = pairs.select("query_id", "vec_id", (_dot(v, w) / F.sqrt(_dot(v, v) * _dot(w, w))).alias("score")).dropDuplicates(["query_id", "vec_id"])
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")

    def scored(self) -> DataFrame:
        """q1, q2 and the rows that were scored for the query, those scored again by another table or pass counted again."""
        return self.found.groupBy("q1", "q2").agg(F.sum("scored").alias("scored"))


def _wide(column: str, kind: str) -> Column:
    """Double parts; those of double vectors are scaled, for their squares may overflow."""
    if kind == "array<float>":
        return F.transform(column, lambda x: x.cast("double"))
    most = F.array_max(F.transform(column, lambda x: F.abs(x)))
    return F.transform(column, lambda x: x / most)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``."""
    return Search(vectors, k, every, id_column, vector_column).nearest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
