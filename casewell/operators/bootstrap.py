"""Percentile bootstrap in one pass: every row takes part in every replicate as often as a Poisson draw says (Poisson
bootstrap), and draws are stable hashes of row and replicate. So a row needs no other row, sums merge, tasks can be
repeated, and the same draws can be made in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_bucket
from ..session import ship

#: A prime below 2^31, and factors of the hash.
PRIME, ROW, REPLICATE, BASE, LINE = (1 << 31) - 1, 1_103_515_245, 1_220_703_125, 362_437, 69_069
#: A hash at or above the k-th bound draws at least k + 1 times.
BOUNDS = [int(PRIME * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(9)]


def row_key(id_column: str, seed: int = 42) -> Column:
    return stable_bucket(F.concat(F.lit(f"boot:{seed}:"), F.col(id_column).cast("string")), PRIME)


def draws(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each row (by key) is in each replicate."""
    h = (keys[:, None] * ROW + replicates[None, :] * REPLICATE + BASE) % PRIME
    h = (h * h % PRIME * h % PRIME + h * LINE % PRIME) % PRIME
    return np.searchsorted(np.array(BOUNDS), h, "right")


def draws_sql(key: str, replicate: str) -> str:
    """The same in SQL."""
    h = f"(({key} * {ROW} + {replicate} * {REPLICATE} + {BASE}) % {PRIME})"
    hash_ = f"((((({h} * {h}) % {PRIME}) * {h}) % {PRIME} + ({h} * {LINE}) % {PRIME}) % {PRIME})"
    return "(" + " + ".join(f"CASE WHEN {hash_} >= {b} THEN 1 ELSE 0 END" for b in BOUNDS) + ")"


def _sums(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    names = None
    for whole in batches:
        names = whole.schema.names[2:]
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            w = draws(batch.column(0).to_numpy(), np.arange(replicates)).astype(np.float64)
            parts = np.array(batch.column(1).to_pylist(), object)
            m = np.column_stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))])
            for part in dict.fromkeys(parts):
                own = parts == part
                total[part] = total.get(part, 0) + m[own].T @ w[own]
    for part, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array([part] * replicates), *map(pa.array, sums)], ["replicate", "part", *names])


def replicate_sums(rows: DataFrame, id_column: str, measures: dict[str, Column], part: Column | None = None, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """replicate, part and the drawn sum of every measure. Parts (such as classes) are few; a row that stands in several
    parts keeps its draws. Each task sends one row per replicate and part."""
    ship(rows.sparkSession)
    part = F.lit("") if part is None else part.cast("string")
    flat = rows.select(row_key(id_column, seed).alias("key"), part.alias("part"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in measures.items()))
    sums = flat.mapInArrow(partial(_sums, replicates=replicates), "replicate long, part string, " + ", ".join(f"{n} double" for n in measures))
    return sums.groupBy("replicate", "part").agg(*(F.sum(n).alias(n) for n in measures))


def interval(rows: DataFrame, values: DataFrame, level: float = 0.95) -> DataFrame:
    """n, low, high: percentiles of ``values`` (value, one row per replicate; null ones do not count). No rows: NaN."""
    low = (1 - level) / 2
    ends = values.agg(F.percentile("value", F.array(F.lit(low), F.lit(1 - low))).alias("p"))
    n = rows.agg(F.count("*").alias("n"))
    nan = F.lit(float("nan"))
    return n.join(F.broadcast(ends), F.lit(True)).select("n", F.coalesce(F.col("p")[0], nan).alias("low"), F.coalesce(F.col("p")[1], nan).alias("high"))


def ratio_ci(rows: DataFrame, id_column: str, over: Column, under: Column | None = None, replicates: int = 2000, level: float = 0.95, empty: float | None = None, seed: int = 42) -> DataFrame:
    """Interval of sum(over) / sum(under), or of the mean of ``over``; a replicate without ``under`` has the value ``empty``."""
    sums = replicate_sums(rows, id_column, {"over": over, "under": F.lit(1) if under is None else under}, None, replicates, seed)
    value = F.when(F.col("under") != 0, F.col("over") / F.col("under")).otherwise(F.lit(empty).cast("double"))
    return interval(rows, sums.select(value.alias("value")), level)


def macro_f1_ci(rows: DataFrame, id_column: str, gold: str = "gold", pred: str = "pred", replicates: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval of the mean F1 over all labels of the whole table: a class that a replicate misses counts 0."""
    sides = F.explode(F.array(F.struct(F.col(gold).alias("label"), (F.col(gold) == F.col(pred)).cast("int").alias("hit")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("hit"))))
    flat = rows.select(id_column, sides.alias("x"))
    sums = replicate_sums(flat, id_column, {"hit": F.col("x.hit"), "sides": F.lit(1)}, F.col("x.label"), replicates, seed)
    f1 = F.when(F.col("sides") > 0, 2 * F.col("hit") / F.col("sides")).otherwise(0.0)
    return interval(rows, sums.groupBy("replicate").agg(F.avg(f1).alias("value")), level)
