"""Stratified sampling of a labelling set: three strata drawn in turn, without loops over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_bucket
from ..scratch import saved
from .position import numbered


def quotas(target: int, adversarial: float = 0.15, rare: float = 0.25) -> tuple[int, int, int]:
    """Rows of the adversarial, rare and proportional strata; halves round to even."""
    a, r = round(target * adversarial), round(target * rare)
    return a, r, target - a - r


def stratified_sample(pool: DataFrame, target: int = 150, seed: int = 42) -> DataFrame:
    """thread_id, cluster, stratum, rank. pool: thread_id (text), cluster, tags (array).
    Tags are computed once and written. Of a cluster no more than its first 2 * ``target`` rows in rank order can be
    drawn, besides adversarial rows; the strata are places among those candidates."""
    n_adv, n_rare, n_prop = quotas(target)
    rank = stable_bucket(F.concat(F.lit(f"golden:{seed}:"), F.col("thread_id")), 1_000_000_000)
    rows = saved(pool.select("thread_id", "cluster", F.size("tags").alias("n_tags"), rank.alias("rank")), "sample-pool")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("total", F.sum("size").over(Window.partitionBy(F.lit(1))))  # one row per cluster
    adv = rows.where("n_tags > 0").orderBy(F.desc("n_tags"), "rank", "thread_id").limit(n_adv).withColumn("adv", F.lit(True))
    in_cluster = Window.partitionBy("cluster").orderBy("rank", "thread_id")
    near = rows.withColumn("near", F.row_number().over(in_cluster)).where(F.col("near") <= 2 * target).drop("near").withColumn("adv", F.lit(False))
    near = near.unionByName(adv).groupBy("thread_id", "cluster", "n_tags", "rank").agg(F.max("adv").alias("adv")).join(sizes, "cluster")
    near = near.withColumn("stratum", F.when(F.col("adv"), "adversarial"))

    def drawn(near: DataFrame, stratum: str, n: int, order: list, among=F.lit(True)) -> DataFrame:
        """The first n rows, in the given order, that are in no stratum yet; n is at most the size of the sample."""
        first = near.where(F.col("stratum").isNull() & among).orderBy(*order).limit(n).select("thread_id", F.lit(stratum).alias("drawn"))
        return saved(near.join(F.broadcast(first), "thread_id", "left").withColumn("stratum", F.coalesce("stratum", "drawn")).drop("drawn"), "sample-drawn")

    def placed(near: DataFrame) -> DataFrame:
        """place: in the cluster, among rows that are in no stratum yet."""
        return near.withColumn("place", F.row_number().over(Window.partitionBy("cluster", F.col("stratum").isNull()).orderBy("rank", "thread_id")))

    near = drawn(placed(near), "rare", n_rare, [(F.col("place") > 1).cast("int"), "size", "cluster", "rank", "thread_id"])
    quota = F.greatest(F.lit(1), F.bround(n_prop * F.col("size") / F.col("total")).cast("int"))
    large = [F.desc("size"), "cluster", "rank", "thread_id"]
    near = drawn(placed(near), "proportional", n_prop, large, F.col("place") <= quota)
    near = drawn(near, "proportional", target - near.where("stratum is not null").count(), large)
    return near.where("stratum is not null").select("thread_id", "cluster", "stratum", "rank")


def position_folds(rows: DataFrame, id_column: str, k: int = 5) -> DataFrame:
    """fold by stable hash of the id: no global order is needed."""
    return rows.withColumn("fold", stable_bucket(F.concat(F.lit("fold:"), F.col(id_column).cast("string")), k).cast("int"))


def row_folds(rows: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """fold: the row's position in the order, modulo k; exact, and without a task that holds all rows."""
    return numbered(rows, [F.col(c) for c in order], "position").withColumn("fold", (F.col("position") % k).cast("int")).drop("position")
