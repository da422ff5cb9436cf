"""Curation: ordered drop reasons, first copy of each text, reproducible splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import stable_bucket
from ..scratch import saved
from .position import numbered


def with_reason(rows: DataFrame, message: str, reply: str | None = None) -> DataFrame:
    """``rows`` with drop_reason: the first reason to drop a row, before copies are looked at; null keeps it. Tokens and
    shares are projections of their own, so a text is scanned once for them."""
    text = F.col(message)
    judged = rows.withColumn("tokens_", T.function_words(text)).withColumns({"english_": T.share_of(F.col("tokens_"), T.ENGLISH), "foreign_": T.share_of(F.col("tokens_"), T.FOREIGN)})
    reason = F.when(~T.is_usable(text), "unusable_customer_message").when(~T.judged_english(text, F.col("english_"), F.col("foreign_")), "not_english")
    reason = reason if reply is None else reason.when(F.trim(T.filled(F.col(reply))) == "", "empty_brand_reply")
    return judged.withColumn("drop_reason", reason).drop("tokens_", "english_", "foreign_")


def near_dup_first(rows: DataFrame, message: str, order: list[Column]) -> DataFrame:
    """The first row of every dedupe key in the given order."""
    place = F.row_number().over(Window.partitionBy("dedupe_key_").orderBy(*order))
    return rows.withColumn("dedupe_key_", T.dedupe_key(F.col(message))).withColumn("place_", place).where("place_ <= 1").drop("place_", "dedupe_key_")


def curation_cascade(rows: DataFrame, message: str, order: list[Column], reply: str | None = None) -> DataFrame:
    """Every row with drop_reason; copies are judged only among rows that nothing else drops. ``order`` tells rows apart.
    The first row of a key is a minimum, aggregated before the shuffle: no key's rows are sorted in one task."""
    judged = with_reason(rows, message, reply).withColumn("order_", F.struct(*order))
    judged = saved(judged.withColumn("key_", F.when(F.col("drop_reason").isNull(), T.dedupe_key(F.col(message)))), "curation")
    firsts = judged.where("key_ is not null").groupBy("key_").agg(F.min("order_").alias("first_"), F.count("*").alias("n_")).where("n_ > 1")
    marked = judged.join(firsts.drop("n_"), "key_", "left")  # null keys meet nothing
    again = F.col("first_").isNotNull() & (F.col("order_") != F.col("first_"))
    return marked.withColumn("drop_reason", F.when(again, "near_duplicate").otherwise(F.col("drop_reason"))).select(*rows.columns, "drop_reason")


def hash_split(rows: DataFrame, id_column: str, pool: int = 6) -> DataFrame:
    """bucket, split: ``pool`` of 100 buckets are the golden pool."""
    rows = rows.withColumn("bucket", stable_bucket(F.concat(F.lit("split:"), F.col(id_column).cast("string")), 100))
    return rows.withColumn("split", F.when(F.col("bucket") < pool, "golden_pool").otherwise("history"))


def devtest_split(rows: DataFrame, id_column: str, dev: float = 0.40) -> DataFrame:
    bucket = stable_bucket(F.concat(F.lit("devtest:"), F.col(id_column).cast("string")), 100)
    return rows.withColumn("devtest", F.when(bucket < int(dev * 100), "dev").otherwise("test"))


def split_scan(rows: DataFrame, split: str) -> DataFrame:
    return rows.where(F.col("split") == split)


def labelled_rows(rows: DataFrame, split: str | None = None) -> DataFrame:
    kept = rows.where((F.coalesce("intent", F.lit("")) != "") & (F.coalesce("action", F.lit("")) != ""))
    return kept if split is None else kept.where(F.col("split") == split)


def replies_present(rows: DataFrame, without: str = "trivial_always_escalate") -> DataFrame:
    return rows.where((F.trim(F.coalesce("reply", F.lit(""))) != "") & (F.col("system") != without))


def length_band_sample(rows: DataFrame, message: str, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of more than 40 and fewer than 240 characters, in hash order."""
    order = stable_bucket(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 1_000_000_000)
    return rows.where(F.length(message).between(41, 239)).orderBy(order, id_column).limit(n)


def corpus_summary(judged: DataFrame) -> DataFrame:
    """family, key, n: raw and kept counts, dropped by reason, kept by split (columns drop_reason, split)."""
    row = lambda family, key: F.struct(F.lit(family).alias("family"), key.alias("key"))
    kept = F.col("drop_reason").isNull()
    marks = F.array(
        row("total", F.lit("raw")), F.when(kept, row("total", F.lit("kept"))),
        F.when(~kept, row("dropped", F.col("drop_reason"))), F.when(kept, row("split", F.col("split"))),
    )
    return judged.select(F.explode(F.array_compact(marks)).alias("m")).groupBy("m.family", "m.key").agg(F.count("*").alias("n"))


def leakage_check(rows: DataFrame, golden: DataFrame, id_column: str) -> DataFrame:
    """Violations by check, all zero on sound data: shared ids, golden rows outside the pool, splits that do not recompute."""
    history, pool = (split_scan(rows, s).select(id_column).distinct() for s in ("history", "golden_pool"))
    again = hash_split(rows.withColumnRenamed("split", "stored").drop("bucket"), id_column)
    counts = [
        ("shared_ids", history.join(pool, id_column, "left_semi")),
        ("golden_outside_pool", golden.select(id_column).distinct().join(pool, id_column, "left_anti")),
        ("split_not_reproduced", again.where(F.col("stored") != F.col("split"))),
    ]
    parts = [found.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, found in counts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def todo_anti(rows: DataFrame, done: DataFrame, keys: list[str], prefix: str, cap: int) -> DataFrame:
    """Rows not done yet, in hash order, at most ``cap``."""
    order = stable_bucket(F.concat_ws(":", F.lit(prefix), *(F.col(k).cast("string") for k in keys)), 1_000_000_000)
    return rows.join(done.select(*keys), keys, "left_anti").orderBy(order, *keys).limit(cap)


def stable_order(rows: DataFrame, prefix: str, keys: list[str], n: int | None = None) -> DataFrame:
    """Rows with order_, the hash that they are shuffled by; with ``n`` the first n in that order, without it every row with
    its ``place`` from 1."""
    rows = rows.withColumn("order_", stable_bucket(F.concat_ws(":", F.lit(prefix), *(F.col(k).cast("string") for k in keys)), 1_000_000_000))
    if n:
        return rows.orderBy("order_", *keys).limit(n)
    return numbered(rows, [F.col("order_"), *map(F.col, keys)], "place").withColumn("place", F.col("place") + 1)
