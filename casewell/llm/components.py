"""Connected components of an edge table by alternating large and small stars; nothing is collected.

The least neighbour of a node is a minimum, aggregated before the shuffle. It comes back to the node's edges by a join on
the node, but for hubs (more than ``LEAST`` edges and more than one in ``HUBS`` of all edge ends): those are at most
``HUBS`` rows, which are broadcast, so no task gets all edges of one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

HUBS, LEAST = 4096, 256


def _star(edges: DataFrame, small: bool, n_edges: int) -> DataFrame:
    """Hang every node's larger (large star) or smaller (small star) neighbours on the least one; ``edges`` has at most ``n_edges`` rows."""
    both = edges if small else edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    hub = F.col("n") > max(LEAST, 2 * n_edges // HUBS)
    known = both.join(F.broadcast(least.where(hub).select("a", F.col("m").alias("hub"))), "a", "left")
    joined = known.where("hub is null").select("a", "b").join(least.where(~hub).select("a", "m"), "a")
    joined = joined.unionByName(known.where("hub is not null").select("a", "b", F.col("hub").alias("m")))
    if small:
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    else:
        hung = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, name: str, most_rounds: int = 40) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (columns a, b: long)."""
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    told = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")]
    edges = saved(edges, name)
    before = edges.agg(*told).first()
    for _ in range(most_rounds):
        # a star has no more edges than it is made from
        edges = saved(_star(saved(_star(edges, False, before.n), name), True, before.n), name)
        now = edges.agg(*told).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
