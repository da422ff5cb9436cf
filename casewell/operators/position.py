"""Exact global positions without a single task: ranges, counts per range, offsets."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place from 0 in a total order. Rows are range-partitioned and sorted, so a row's place is its
    place in its range plus the rows of the ranges before; only one count per range reaches the driver."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    placed = saved(spread.withColumn("range_", F.shiftright("at_", 33)), "positions")
    counts = sorted(placed.groupBy("range_").agg(F.count("*").alias("n")).collect())
    offsets = [(r.range_, o) for r, o in zip(counts, accumulate((r.n for r in counts), initial=0))]
    known = rows.sparkSession.createDataFrame(offsets, "range_ long, offset_ long")
    place = F.col("offset_") + F.col("at_").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(known), "range_").withColumn(name, place).select(*rows.columns, name)


def running_sum(rows: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows up to each in a total order: sums run inside ranges of the order,
    and one total per range reaches the driver."""
    placed = saved(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "running")
    totals = sorted(placed.groupBy("range_").agg(F.sum(amount).alias("n")).collect())
    offsets = [(r.range_, o) for r, o in zip(totals, accumulate((r.n for r in totals), initial=0))]
    known = rows.sparkSession.createDataFrame(offsets, "range_ int, offset_ long")
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(known), "range_").withColumn(name, F.col("offset_") + F.sum(amount).over(inside)).select(*rows.columns, name)
