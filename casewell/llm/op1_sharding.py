"""Operator 1, sharding: vector bin packing of groups of equal texts by bytes, tokens and rows.

A group goes whole to the shard where the dot product of its vector (each part as a share of one
shard) with the shard's residual capacity is highest. Groups heavier than one part in 256 of a
shard are at most 3 * shards * 256, a proven bound: they are placed first, on the driver. All
lighter groups are dealt by hash to packs of about 32,768 groups; every pack holds its share of
what the heavy groups left free and is packed by the same rule, heaviest first, in one task. Only
a group heavier than a whole shard is split, by hash of its rows' places in the file and identifiers.

Defined results: law ``bytes``; size is UTF-8 bytes plus 16 (null text: 16); null texts are one
group, empty texts another; repeated rows each get a slot; an empty table gives no rows; other
columns are ignored. Slots number each shard's rows from 0 without gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_text, n_bytes, n_words, pieces_for, saved, ship, table, text_key, text_of, with_row_id

SHARDS, HEAVY, PACK, BUCKET = 40, 256, 32_768, 16_384
#: The law is ``bytes``: they count this much more than tokens and rows.
FAVOUR = np.array([3.0, 1.0, 1.0])


def place(weights: np.ndarray, residual: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The bin of each item (rows of ``weights``, heaviest first in any part); ``residual`` is used up."""
    w, left, out = weights / scale * FAVOUR, residual / scale * FAVOUR, np.empty(len(weights), np.int32)
    order = np.argsort(-w.max(axis=1), kind="stable")
    for i in order:
        v = w[i]
        k = int((left @ v).argmax())
        left[k] -= v
        out[i] = k
    return out


def shard(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    spark = ship(docs.sparkSession)
    rows = with_row_id(docs.select("doc_id", "text"))
    light = saved(rows.select("doc_id", F.xxhash64("row_no", "file_no", "doc_id").alias("place"), (n_bytes(text_of()) + 16).alias("size"), n_words(text_of()).alias("tokens"), crc32_text().alias("text_crc32"), text_key().alias("key")), "shard-rows")
    n, size, tokens = light.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
    if not n:
        return light.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    totals = np.array([size, max(1, tokens), n], float)
    capacity = totals / n_shards
    groups = light.groupBy("key").agg(F.sum("size").alias("w_bytes"), F.sum("tokens").alias("w_tokens"), F.count("*").alias("w_rows"))
    share = F.greatest(*(F.col(c) / F.lit(float(x)) for c, x in zip(("w_bytes", "w_tokens", "w_rows"), capacity)))
    heavy = groups.where(share > 1 / HEAVY).withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(share).cast("int")))
    heavy = saved(heavy, "shard-heavy")
    # pieces of split groups weigh what their rows weigh; at most 3 * n_shards * (HEAVY + 1) rows reach the driver
    cut = light.join(F.broadcast(heavy.where("n_pieces > 1").select("key", "n_pieces")), "key").withColumn("piece", F.pmod("place", "n_pieces").cast("int"))
    cut = cut.groupBy("key", "piece").agg(F.sum("size").alias("w_bytes"), F.sum("tokens").alias("w_tokens"), F.count("*").alias("w_rows"), F.first("n_pieces").alias("n_pieces"))
    whole = heavy.where("n_pieces = 1").withColumn("piece", F.lit(0))
    items = whole.select(*cut.columns).unionByName(cut).toPandas()
    items = items.assign(hex=items.key.map(bytes.hex)).sort_values(["hex", "piece"]).reset_index(drop=True)
    vectors = items[["w_bytes", "w_tokens", "w_rows"]].to_numpy(float)
    bins = place(vectors, np.tile(capacity, (n_shards, 1)), capacity)
    taken = np.zeros((n_shards, 3))
    np.add.at(taken, bins, vectors)
    free, rest = np.tile(capacity, (n_shards, 1)) - taken, totals - vectors.sum(axis=0)
    plan = spark.createDataFrame(
        [(bytes(k), int(p), int(m), int(b)) for k, p, m, b in zip(items.key, items.piece, items.n_pieces, bins)], "key binary, piece int, n_pieces int, shard int"
    )

    n_packs = pieces_for(n, PACK)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf[["w_bytes", "w_tokens", "w_rows"]].to_numpy(float)
        part = w.sum(axis=0) / np.maximum(rest, 1)
        order = np.lexsort((pdf.key.map(bytes.hex).to_numpy(), -w[:, 0]))
        turned = np.roll(np.arange(n_shards), int(pdf.pack.iloc[0]))  # ties fall on other shards in other packs
        got = turned[place(w[order], (free * part)[turned], np.maximum(capacity * part, 1e-9))]
        return pd.DataFrame({"key": pdf.key.to_numpy()[order], "shard": got.astype(np.int32)})

    packs = groups.where(share <= 1 / HEAVY).withColumn("pack", F.pmod(F.xxhash64("key"), F.lit(n_packs)).cast("int"))
    light_plan = packs.groupBy("pack").applyInPandas(pack, "key binary, shard int")

    pieces = plan.select("key", "n_pieces").distinct()
    tagged = light.join(F.broadcast(pieces), "key", "left").withColumn("piece", F.pmod("place", "n_pieces").cast("int"))
    one = tagged.where("n_pieces is not null").join(F.broadcast(plan.drop("n_pieces")), ["key", "piece"]).drop("piece", "n_pieces")
    many = tagged.where("n_pieces is null").drop("piece", "n_pieces").join(light_plan, "key")
    placed = saved(one.select(*light.columns, "shard").unionByName(many.select(*light.columns, "shard")), "shard-placed")

    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("place", "key"), F.lit(pieces_for(n, BUCKET * n_shards // 8))).cast("int"))
    counts = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "key", "place"))
    return placed.withColumn("rn", within).join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rn") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
