"""k-means for many (k, seed) models at once: one scan of the rows advances all of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .pivots import matrix, unit

#: Rows that starting points are drawn from; scans that move centres; movement below which a model stands still; tasks
#: whose sums are added up together.
SAMPLE, ROUNDS, STILL, TASKS_ADDED = 10_000, 17, 1e-4, 256


def start(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each drawn by its squared distance to those before."""
    draw = np.random.default_rng([seed, k])
    centres = [sample[draw.integers(len(sample))]]
    gap = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(k, len(sample)):
        total = gap.sum()
        at = draw.integers(len(sample)) if total <= 0 else min(len(sample) - 1, int(np.searchsorted(np.cumsum(gap), draw.random() * total)))
        centres.append(sample[at])
        gap = np.minimum(gap, ((sample - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row, the first of equal ones, and the squared distance."""
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
    own = d.argmin(axis=1)
    return own, np.maximum(0, d[np.arange(len(x)), own])


def _sums(batches: Iterator[pa.RecordBatch], models, units: bool) -> Iterator[pa.RecordBatch]:
    """Per model of this task's rows: sums of the rows (of their directions, if ``units``) by cluster, sizes and cost."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch.column("vector"))
        summed = unit(x) if units else x
        for number, centres in models.value.items():
            own, cost = nearest(x, centres)
            hot = np.zeros((len(x), len(centres)))
            hot[np.arange(len(x)), own] = 1
            part = np.column_stack([hot.T @ summed, hot.sum(axis=0), hot.T @ cost])
            total[number] = total.get(number, 0) + part
    if total:
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * len(total), pa.int32()), pa.array(list(total), pa.int32()), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))], ["task", "model", "sums"]
        )


def _scan(rows: DataFrame, models: dict[int, np.ndarray], units: bool = False) -> dict[int, np.ndarray]:
    """Sums of every model over all rows, from one scan; only one row per model reaches the driver."""
    held = rows.sparkSession.sparkContext.broadcast(models)
    parts = rows.select("vector").mapInArrow(partial(_sums, models=held, units=units), "task int, model int, sums array<double>")

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": [0], "model": pdf.model[:1], "sums": [np.sum(pdf.sums.tolist(), axis=0)]})

    kind = "task int, model int, sums array<double>"
    some = parts.groupBy("model", F.expr(f"task div {TASKS_ADDED}")).applyInPandas(added, kind)
    got = some.groupBy("model").applyInPandas(added, kind).toPandas()
    held.destroy()
    return {int(m): np.array(s).reshape(len(models[int(m)]), -1) for m, s in zip(got.model, got.sums)}


def fits(vectors: DataFrame, ks: list[int], seeds: list[int], rounds: int = ROUNDS) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """Centres and cost (sum of squared distances) of every (k, seed). ``vectors``: id, vector. Models that stand still take
    no further part; each round is one scan for all others, and one more scan gives the costs. A cluster that loses all
    its rows keeps its centre."""
    ship(vectors.sparkSession)
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(sample):
        return {}
    points = np.array(sample.vector.tolist(), np.float64)
    names = [(k, s) for k in ks for s in seeds]
    centres = {i: start(points, k, s) for i, (k, s) in enumerate(names)}
    moving = dict(centres)
    for _ in range(rounds):
        if not moving:
            break
        for i, sums in _scan(rows, moving).items():
            n = sums[:, -2:-1]
            new = np.where(n > 0, sums[:, :-2] / np.maximum(n, 1), centres[i])
            moved = np.sqrt(((new - centres[i]) ** 2).sum(axis=1)).max()
            centres[i] = new
            moving[i] = new
            if moved <= STILL:
                del moving[i]
    costs = _scan(rows, centres)
    return {name: (centres[i], float(costs[i][:, -1].sum())) for i, name in enumerate(names)}


def _silhouettes(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    total: dict[int, float] = {}
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch.column("vector"))
        u, n = unit(x), n + batch.num_rows
        for number, (centres, sums, sizes) in models.value.items():
            own, _ = nearest(x, centres)
            far = np.where(sizes > 0, 1 - u @ sums.T / np.maximum(sizes, 1), np.inf)
            at = np.arange(len(x))
            a = far[at, own] * sizes[own] / np.maximum(sizes[own] - 1, 1)
            far[at, own] = np.inf
            b = far.min(axis=1)
            s = np.where((sizes[own] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            total[number] = total.get(number, 0.0) + float(s.sum())
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values())), pa.array([n] * len(total), pa.int64())], ["model", "s", "n"])


def silhouettes(vectors: DataFrame, models: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette by cosine distance of every model, over all rows, from two scans for all of them."""
    rows = vectors.select(F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    sums = _scan(rows, models, units=True)
    held = rows.sparkSession.sparkContext.broadcast({i: (models[i], s[:, :-2], s[:, -2]) for i, s in sums.items()})
    got = rows.mapInArrow(partial(_silhouettes, models=held), "model int, s double, n long").groupBy("model").agg((F.sum("s") / F.sum("n")).alias("s")).collect()
    return {r.model: r.s for r in got}


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, cluster of the nearest centre."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(nearest(matrix(batch.column("vector")), held.value)[0].astype(np.int32))], ["id", "cluster"])

    return vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null").mapInArrow(own, "id long, cluster int")
