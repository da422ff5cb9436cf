"""Exact nearest neighbours by cosine with a pivot index.

Vectors are taken at unit length, where cosine order is distance order. Every corpus row belongs to its nearest pivot and
stands in the pivot's ball by its distance; runs of ``SHELL`` rows in that order are shells. By the triangle inequality
no row of a shell with distances [low, high] is nearer to a query at distance d from the pivot than max(d - high, low - d).
A query looks into its ``FIRST`` nearest shells by that bound, which gives a distance that its k-th neighbour does not
exceed, and then into every shell whose bound does not exceed that. All others are safe to leave out, ties included.

The corpus is shuffled into a bucketed table of packed shells and once more into bundles of shells, whatever the number of
queries. For the first look queries move to ``FIRST`` shells. Where nothing can be left out every query meets every
shell, so the second look moves nothing: written packs of queries meet written bundles in a Cartesian product, which reads
both where they are. A task holds its packs and the best k rows of their queries, and bundles stream past it in at most
``PARTS`` parts, so at most ``PARTS`` x k rows per query leave it. Similarities are looked through in single precision,
with a margin above its error, and what may be among the best is scored again in double precision.
Pivots (at most ``PIVOTS``) and one row of bounds per shell (at most about ``SHELLS`` + ``PIVOTS``, for shells grow with the
corpus) go to all tasks. A ball of any size is many shells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import bucketed, saved
from ..session import ship
from .position import numbered

PIVOTS, SHELL, SHELLS, FIRST, PACK, BUCKETS, SLACK = 1024, 2048, 65_536, 2, 1024, 64, 1e-6
#: Queries of a pack and corpus rows of a bundle in the second look; parts of the corpus; pairs scored at a time.
SWEPT, BUNDLE, PARTS, PAIRS = 4096, 16_384, 8, 65_536


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a column of equally long lists."""
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def pivots(corpus: DataFrame, n: int, rounds: int = 6) -> np.ndarray:
    """About the square root of n directions, settled on a sample of at most four times as many rows."""
    wanted = int(min(PIVOTS, max(1, round(n**0.5))))
    sample = corpus.orderBy(F.xxhash64("id"), "id").limit(4 * wanted).select("vector").toPandas()
    if not len(sample):
        return np.zeros((0, 0))
    m = unit(np.array(sample.vector.tolist(), np.float64).reshape(len(sample), -1))
    m = np.unique(m[np.abs(m).sum(axis=1) > 0], axis=0)
    at = np.random.default_rng(42).permutation(len(m))[:wanted]
    centres = m[at]
    for _ in range(rounds):
        if not len(centres):
            break
        own = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        kept = np.abs(sums).sum(axis=1) > 0
        centres = unit(sums[kept])
    return centres


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def _placed(batches: Iterator[pa.RecordBatch], centres) -> Iterator[pa.RecordBatch]:
    """id, vector at unit length, ball and distance; rows of no length are in a ball of their own, -1."""
    for batch in batches:
        if not batch.num_rows:
            continue
        m = unit(matrix(batch.column("vector")))
        none = np.abs(m).sum(axis=1) == 0
        ball, r = np.full(len(m), -1), np.zeros(len(m))
        if len(centres.value):
            d = distance(m, centres.value)
            ball = np.where(none, -1, d.argmin(axis=1))
            r = np.where(none, 0, d[np.arange(len(m)), np.maximum(ball, 0)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(ball, pa.int64()), pa.array(r)], ["id", "vector", "ball", "r"])


class PivotIndex:
    """shells: shell, ids, rows (packed); bounds of every shell; pivots. ``corpus``: id, vector."""

    def __init__(self, corpus: DataFrame, shell: int = SHELL):
        spark = ship(corpus.sparkSession)
        corpus = corpus.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
        self.n = corpus.count()
        self.pivots = spark.sparkContext.broadcast(pivots(corpus, self.n))
        placed = corpus.mapInArrow(partial(_placed, centres=self.pivots), "id long, vector array<double>, ball long, r double")
        rows = numbered(placed, [F.col(c) for c in ("ball", "r", "id")])
        key = F.shiftleft("ball", 34) + F.floor(F.col("position") / max(shell, -(-self.n // SHELLS)))
        # one list of flat numbers per shell, in order of ids; a shell has a bounded number of rows
        sorted_ = F.array_sort(F.collect_list(F.struct("id", "vector")))
        packed = rows.withColumn("shell", key).groupBy("shell").agg(sorted_.alias("x"), F.first("ball").alias("ball"), F.min("r").alias("low"), F.max("r").alias("high"))
        packed = packed.select("shell", F.col("x.id").alias("ids"), F.flatten("x.vector").alias("rows"), "ball", "low", "high", F.size("x").alias("n"))
        self.shells = bucketed(packed, "shell", BUCKETS, "shells")
        self._bundles = None
        bounds = self.shells.select("shell", "ball", "low", "high", "n").toPandas().sort_values("shell")  # bounded by SHELLS and PIVOTS
        self.bounds = spark.sparkContext.broadcast({c: bounds[c].to_numpy() for c in bounds.columns})

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, similarity of the k nearest and some more."""
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
        # one small file of queries would be one task; written, for what makes the queries would run in every step below
        asked = saved(asked.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "pivot-asked")
        first = self._visit(asked.withColumn("reach", F.lit(None).cast("double")), k)
        best = first.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("similarity"), asc=False), k, 1).alias("s"))  # at most FIRST x k
        kth = F.when(F.size("s") == 1, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s")[0]))).otherwise(F.lit(2.0))
        reach = saved(best.select("query_id", kth.alias("reach")), "pivot-reach")
        return self._sweep(asked.join(reach, "query_id"), k)

    def bundles(self) -> DataFrame:
        """bundle, shells: shells that follow one another, about ``BUNDLE`` rows together; made once."""
        if self._bundles is None:
            held = self.bounds.value
            place = (np.cumsum(held["n"]) - held["n"]) // BUNDLE
            known = self.shells.sparkSession.createDataFrame(list(zip(held["shell"].tolist(), place.tolist())), "shell long, bundle long")
            rows = self.shells.join(F.broadcast(known), "shell").repartition(max(1, len(np.unique(place))), "bundle")
            self._bundles = saved(rows.groupBy("bundle").agg(F.collect_list(F.struct("ball", "low", "high", "ids", "rows")).alias("shells")), "pivot-bundles")
        return self._bundles

    def _sweep(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best rows of each part of the corpus for every query (query_id, vector, reach) that lie within its reach."""
        n = max(1, -(-queries.count() // SWEPT))
        packed = queries.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(n))).repartition(n, "pack").groupBy("pack").agg(F.collect_list(F.struct("query_id", "reach", "vector")).alias("x"))
        packs = saved(packed.select("pack", F.col("x.query_id").alias("asked"), F.col("x.reach").alias("reach"), F.flatten("x.vector").alias("numbers")), "pivot-packs")
        met = self.bundles().coalesce(PARTS).crossJoin(packs.hint("shuffle_replicate_nl"))
        return met.mapInArrow(partial(_swept, k=k, centres=self.pivots), "query_id long, id long, similarity double")

    def visits(self, queries: DataFrame) -> DataFrame:
        """query_id, vector, shell, n: shells that queries look into; without a reach the first ones, with one the others."""
        return queries.select("query_id", "vector", "reach").mapInArrow(partial(_visits, centres=self.pivots, bounds=self.bounds), "query_id long, vector array<double>, shell long, n long")

    def _visit(self, queries: DataFrame, k: int) -> DataFrame:
        packs = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // PACK))))
        packed = self.visits(queries).groupBy("shell", packs.alias("pack")).agg(F.collect_list(F.struct("query_id", "vector")).alias("x"))
        packed = packed.select(F.col("shell").alias("at"), F.col("x.query_id").alias("asked"), F.flatten("x.vector").alias("numbers"))
        met = packed.join(self.shells.select("shell", "ids", "rows"), F.col("at") == F.col("shell")).select("asked", "numbers", "ids", "rows")
        return met.mapInArrow(partial(_scored, k=k), "query_id long, id long, similarity double")


def _visits(batches: Iterator[pa.RecordBatch], centres, bounds) -> Iterator[pa.RecordBatch]:
    shells, p = bounds.value, centres.value
    n_shells = len(shells["shell"])
    for batch in batches:
        if not batch.num_rows or not n_shells:
            continue
        q = unit(matrix(batch.column("vector")))
        d = distance(q, p) if len(p) else np.zeros((len(q), 1))
        reach = batch.column("reach").to_numpy(zero_copy_only=False).astype(float)
        for i in range(len(q)):
            own = d[i][np.maximum(shells["ball"], 0)]
            low = np.maximum(0, np.maximum(own - shells["high"], shells["low"] - own))
            low = np.where((shells["ball"] < 0) | (np.abs(q[i]).sum() == 0), 0, low)
            near = np.arange(n_shells)
            if np.isnan(reach[i]) and n_shells > FIRST:
                near = np.flatnonzero(low <= np.partition(low, FIRST - 1)[FIRST - 1])
            order = near[np.lexsort((shells["shell"][near], np.where(shells["ball"] < 0, 3, own)[near], low[near]))]
            at = order[:FIRST] if np.isnan(reach[i]) else order[FIRST:][low[order[FIRST:]] <= reach[i] + SLACK]
            if len(at):
                ids, vectors = batch.column("query_id").slice(i, 1), batch.column("vector").slice(i, 1)
                same = pa.array(np.zeros(len(at), np.int64))
                yield pa.RecordBatch.from_arrays([ids.take(same), vectors.take(same), pa.array(shells["shell"][at]), pa.array(shells["n"][at].astype(np.int64))], ["query_id", "vector", "shell", "n"])


def _scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of a shell for each query; of what ties at the cut the smallest ids."""
    for batch in batches:
        for asked, numbers, ids, rows in zip(*(batch.column(c) for c in ("asked", "numbers", "ids", "rows"))):
            asked, ids = (x.values.to_numpy() for x in (asked, ids))
            q, m = unit(numbers.values.to_numpy().reshape(len(asked), -1)), rows.values.to_numpy().reshape(len(ids), -1)
            s, n = q @ m.T, min(k, len(ids))
            kth = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero(s >= kth - 1e-12)
            order = np.lexsort((ids[j], np.abs(s[i, j] - kth[i, 0]) <= 1e-12, i))
            i, j = i[order], j[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < n
            i, j = i[kept], j[kept]
            yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(ids[j]), pa.array(s[i, j])], ["query_id", "id", "similarity"])


class _Best:
    """The k best rows so far of every query of a pack."""

    def __init__(self, asked: np.ndarray, reach: np.ndarray, numbers: np.ndarray, k: int):
        self.asked, self.reach, self.k = asked, reach, k
        self.q = unit(numbers.reshape(len(asked), -1))
        self.single, self.zero = self.q.astype(np.float32), np.abs(self.q).sum(axis=1) == 0
        self.margin = (self.q.shape[1] + 16) * 6e-8  # above the error of an inner product of unit vectors in single precision
        # nothing that lies farther than the k-th row of the first look is wanted
        self.least = 1 - reach * reach / 2 - 1e-9
        self.ids, self.s = np.zeros((len(asked), k), np.int64), np.full((len(asked), k), -np.inf)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def within(self, ball: int, low: float, high: float, own: np.ndarray) -> np.ndarray:
        """Queries that a shell may hold a neighbour of."""
        if ball < 0:
            return np.arange(len(self.q))
        return np.flatnonzero((np.maximum(own - high, low - own) <= self.reach + SLACK) | self.zero)

    def look(self, at: np.ndarray, ids: np.ndarray, m: np.ndarray, single: np.ndarray) -> None:
        """Score the queries ``at`` with rows in order of their ids."""
        s = (self.single if len(at) == len(self.q) else self.single[at]) @ single.T
        i, j = np.divmod(np.flatnonzero(s >= (self.least[at] - self.margin).astype(np.float32)[:, None]), len(ids))
        many = np.bincount(i, minlength=len(at)) > 8 * self.k
        few = ~many[i]
        i, j = i[few], j[few]
        for x in range(0, len(i), PAIRS):
            self.take(at[i[x : x + PAIRS]], ids[j[x : x + PAIRS]], np.einsum("ij,ij->i", self.q[at[i[x : x + PAIRS]]], m[j[x : x + PAIRS]]))
        many = at[many]
        for x in range(0, len(many), 256):
            some, n = many[x : x + 256], min(self.k, len(ids))
            s = self.q[some] @ m.T
            kth = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero(s > kth + 1e-12)
            self.take(some[i], ids[j], s[i, j])
            i, j = np.nonzero(np.abs(s - kth) <= 1e-12)
            first = np.arange(len(i)) - np.searchsorted(i, i) < self.k  # of what ties at the cut the smallest ids
            self.take(some[i[first]], ids[j[first]], s[i[first], j[first]])

    def take(self, at: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        near = s >= self.least[at] - 1e-12
        if near.any():
            self.new.append((at[near], ids[near], s[near]))

    def merge(self) -> None:
        if not self.new:
            return
        at, ids, s = (np.concatenate(x) for x in zip(*self.new))
        self.new = []
        old = np.unique(at)
        at, ids, s = np.concatenate([at, np.repeat(old, self.k)]), np.concatenate([ids, self.ids[old].ravel()]), np.concatenate([s, self.s[old].ravel()])
        order = np.lexsort((ids, -np.round(s, 12), at))
        at, ids, s = at[order], ids[order], s[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        self.ids[at[kept], place[kept]], self.s[at[kept], place[kept]] = ids[kept], s[kept]
        self.least = np.maximum(self.least, self.s[:, -1] - 1e-12)


def _swept(batches: Iterator[pa.RecordBatch], k: int, centres) -> Iterator[pa.RecordBatch]:
    """Packs of queries against bundles of shells, in any order; the best rows of each pack at the end."""
    packs, last, shells = {}, None, []
    for batch in batches:
        for i in range(batch.num_rows):
            bundle, pack = batch.column("bundle")[i].as_py(), batch.column("pack")[i].as_py()
            if pack not in packs:
                packs[pack] = _Best(*(batch.column(c)[i].values.to_numpy() for c in ("asked", "reach", "numbers")), k)
            if bundle != last:
                last, shells = bundle, list(_unpacked(batch.column("shells")[i].values))
            best, balls = packs[pack], sorted({max(x[0], 0) for x in shells})
            own = distance(best.q, centres.value[balls]) if len(centres.value) else np.zeros((len(best.q), len(balls)))
            for ball, low, high, ids, m, single in shells:
                at = best.within(ball, low, high, own[:, balls.index(max(ball, 0))])
                if len(at):
                    best.look(at, ids, m, single)
            best.merge()
    for best in packs.values():
        i, j = np.nonzero(best.s > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(best.asked[i]), pa.array(best.ids[i, j]), pa.array(best.s[i, j])], ["query_id", "id", "similarity"])


def _unpacked(shells: pa.StructArray) -> Iterator[tuple]:
    for ball, low, high, ids, rows in zip(*(shells.field(c) for c in ("ball", "low", "high", "ids", "rows"))):
        ids = ids.values.to_numpy().copy()
        m = rows.values.to_numpy().reshape(len(ids), -1).copy()
        yield ball.as_py(), low.as_py(), high.as_py(), ids, m, m.astype(np.float32)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """query_id, id, similarity, rank of the k best per query; ties to smaller ids."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)
