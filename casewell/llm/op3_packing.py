"""Operator 3, conflict-constrained best-fit packing of documents into sequences of a fixed capacity.

Bins are kept in order of residual capacity and carry two bitmaps: the sources and the duplicate
clusters they hold. A document goes to the tightest bin that fits and holds neither its source nor its
cluster: the search starts at the first bin that fits and goes on to the next larger residual until a
compatible one is found; only if there is none a bin is opened. Documents come largest first. Longer
documents are cut: whole pieces fill bins of their own, the rest is packed.

Rows are dealt by a hash of their place in the file to packs of about ``PACK`` rows, so a source or a
cluster with a third of all rows is spread over all packs; a pack is packed in one task.

The query measures documents in words; the pipeline's stage in tokens of a vocabulary, which operator 10 counts.

Defined results: size is the number of words (or a given column); null and empty texts have size 0 and
take no room but a place; null sources and null clusters conflict with nothing; repeated rows are
packed each (as copies they share no bin); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filed, n_words, pieces_for, saved, ship, table, text_of, with_row_id
from .op10_token_counts import with_tokens

CAPACITY, PACK = 2048, 8192


class Bins:
    """Bins in residual order, with a bitmap of sources and one of clusters each."""

    def __init__(self, most: int, n_sources: int, n_clusters: int):
        self.residual, self.ids, self.n = np.zeros(most, np.int64), np.zeros(most, np.int64), 0
        self.sources = np.zeros((most, n_sources // 64 + 1), np.uint64)
        self.clusters = np.zeros((most, n_clusters // 64 + 1), np.uint64)

    @staticmethod
    def _free(bitmap: np.ndarray, bins: np.ndarray, k: int) -> np.ndarray:
        return bitmap[bins, k >> 6] & np.uint64(1 << (k & 63)) == 0

    def tightest(self, need: int, source: int, cluster: int) -> int:
        """Place in the order of the tightest compatible bin, or -1."""
        at, step = int(np.searchsorted(self.residual[: self.n], need)), 16
        while at < self.n:
            bins = self.ids[at : min(self.n, at + step)]
            ok = np.ones(len(bins), bool)
            if source >= 0:
                ok &= self._free(self.sources, bins, source)
            if cluster >= 0:
                ok &= self._free(self.clusters, bins, cluster)
            k = int(ok.argmax())
            if ok[k]:
                return at + k
            at, step = at + len(bins), step * 4
        return -1

    def put(self, need: int, source: int, cluster: int, capacity: int) -> tuple[int, int]:
        """Bin and offset of a document."""
        at = self.tightest(need, source, cluster)
        if at < 0:
            bin_, left = self.opened, capacity
            self.opened += 1
        else:
            bin_, left = int(self.ids[at]), int(self.residual[at])
            self.residual[at : self.n - 1] = self.residual[at + 1 : self.n]
            self.ids[at : self.n - 1] = self.ids[at + 1 : self.n]
            self.n -= 1
        k = int(np.searchsorted(self.residual[: self.n], left - need))
        self.residual[k + 1 : self.n + 1] = self.residual[k : self.n].copy()
        self.ids[k + 1 : self.n + 1] = self.ids[k : self.n].copy()
        self.residual[k], self.ids[k] = left - need, bin_
        self.n += 1
        if source >= 0:
            self.sources[bin_, source >> 6] |= np.uint64(1 << (source & 63))
        if cluster >= 0:
            self.clusters[bin_, cluster >> 6] |= np.uint64(1 << (cluster & 63))
        return bin_, capacity - left

    opened = 0


def pack_rows(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, size, bin, offset) of every piece; source and cluster are numbers, -1 conflicts with nothing."""
    whole, rest = size // capacity, size % capacity
    whole -= (rest == 0) & (size > 0)
    rest = size - whole * capacity
    bins, out = Bins(len(size) + 1, int(source.max(initial=0)) + 1, int(cluster.max(initial=0)) + 1), []
    for row in np.argsort(-rest, kind="stable"):
        bin_, offset = bins.put(int(rest[row]), int(source[row]), int(cluster[row]), capacity)
        out.append((int(row), int(whole[row]), int(rest[row]), bin_, offset))
    free = bins.opened
    for row in np.flatnonzero(whole):
        for piece in range(int(whole[row])):
            out.append((int(row), piece, capacity, free, 0))
            free += 1
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, size: Column | None = None, cluster: Column | None = None, unit: str = "n_words") -> DataFrame:
    """doc_id, piece, size (named ``unit``), bin, offset; without ``cluster`` equal texts are one duplicate cluster.
    ``size`` and ``cluster`` are computed from the columns of ``docs``."""
    ship(docs.sparkSession)
    size = n_words(text_of()) if size is None else size.cast("long")
    cluster = F.xxhash64("text") if cluster is None else cluster.cast("long")
    cluster = F.when(F.col("text").isNotNull() & (F.length("text") > 0), cluster)
    held = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size.alias("size"), cluster.alias("cluster")).alias("held")
    rows = saved(with_row_id(filed(docs).select(held)).select("file_no", "row_no", "held.*"), "packing-rows")
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("row_no", "file_no"), F.lit(pieces_for(rows.count(), PACK))))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "file_no", "row_no"], ascending=[False, True, True]).reset_index(drop=True)
        source = pd.factorize(pdf.source)[0]  # null: -1
        cluster = np.where(pdf.cluster.notna() & pdf.cluster.duplicated(keep=False), pd.factorize(pdf.cluster)[0], -1)
        cluster = np.where(cluster >= 0, np.unique(cluster, return_inverse=True)[1], -1)  # numbers of repeated clusters only
        got = pd.DataFrame(pack_rows(pdf["size"].to_numpy(), source, cluster, capacity), columns=["row", "piece", "size", "bin", "offset"])
        doc_id = pdf.doc_id.astype("Int64").to_numpy()[got.row] if pdf.doc_id.isna().any() else pdf.doc_id.astype("int64").to_numpy()[got.row]
        got.insert(0, "doc_id", pd.array(doc_id, "Int64"))
        got["bin"] += int(pdf.pack.iloc[0]) << 32
        return got.drop(columns="row")

    out = rows.groupBy("pack").applyInPandas(packed, "doc_id long, piece long, size long, bin long, offset long")
    return out.withColumnRenamed("size", unit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of ``docs`` by their tokens; rows of one document (its repeats in the mix) are one duplicate cluster."""
    import public_tokenizers

    counted = with_tokens(docs.select("doc_id", "text", "source"), public_tokenizers.path("piece_bpe_32k.model"))
    light = counted.select("doc_id", F.substring("text", 1, 1).alias("text"), "source", "n_tokens")  # the text is needed no more, but whether there is one
    return pack(saved(light, "packing-tokens"), size=F.col("n_tokens"), cluster=F.col("doc_id"), unit="n_tokens")
