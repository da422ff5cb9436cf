"""Operator 2, token-ID output: every document's ids in sorted-string-table shards.

One range shuffle by identifier; each task encodes its documents with the library's vocabulary,
streams them into one file of the shared folder and returns one manifest row. Positions are the
running sum over manifest rows (one per file), so nothing passes through the driver.

Defined results: null text is an empty document (only the end id); a null identifier sorts first and can be
looked up as null; repeated identifiers are kept, ordered by a hash of their text (they may fill several files); an empty table gives no files and no
rows; other columns are ignored. Files are complete or absent: a task writes under a name of its
own and renames at the end, so a lost executor or a repeated task leaves one whole file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, saved, ship, table, text_of, with_row_id

MANIFEST = "shard int, file string, n_docs long, n_ids long, first_id long, last_id long"
#: Documents in a file: about the table's rows over 256, within these bounds.
LEAST_DOCS, MOST_DOCS = 512, 16384
#: Most tasks that read files; each reads its files one after another.
READERS = 65_536


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from .sstable import Writer
    from .word_encoder import word_encoder

    encoder, shard = word_encoder(vocabulary), TaskContext.get().partitionId()
    uri, writer, ids_seen = f"{folder}/shard-{shard:08d}.cwsst", None, []
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc_id, encoded in zip(ids, encoder.encode_many(texts)):
            writer = writer or Writer(uri, 4 if encoder.wide else 2)
            writer.add(doc_id, np.append(encoded, np.array([end_id], encoder.dtype)))
        ids_seen = (ids_seen[:1] or ids[:1]) + ids[-1:]
    if writer:
        n_docs, n_ids = writer.close()
        row = {"shard": shard, "file": uri, "n_docs": n_docs, "n_ids": n_ids, "first_id": ids_seen[0], "last_id": ids_seen[-1]}
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))


def write_tables(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the files; returns their manifest with ``start``, the ids in all files before."""
    spark = ship(docs.sparkSession)
    folder = folder or new_folder(spark, "token-tables")
    rows = docs.select("doc_id").count()
    n = max(1, -(-rows // min(MOST_DOCS, max(LEAST_DOCS, -(-rows // 256)))))
    # the rows of one identifier are told apart, so that many of them are several ranges
    placed = with_row_id(docs.select("doc_id", text_of().alias("text"))).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), "h", "row_no", "file_no"]
    sorted_docs = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = saved(sorted_docs.mapInArrow(partial(_write_shard, folder=folder, vocabulary=vocabulary, end_id=end_id), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read_shards(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    from .sstable import Reader

    for batch in batches:
        for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            for doc_id, ids in Reader(file):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.tolist()))
                start += len(ids)
                if len(rows) == 4096:
                    yield _rows(rows, digest)
                    rows = []
            if rows:
                yield _rows(rows, digest)


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_tables(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Documents from the files: ids, or with ``digest`` their crc32 as little-endian 32-bit integers."""
    last = "ids_crc32 long" if digest else "ids array<long>"
    files = manifest.select("file", "start").repartition(max(1, min(READERS, manifest.count())))
    return files.mapInArrow(partial(_read_shards, digest=digest), f"doc_id long, start long, n_tokens long, {last}")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of the wanted identifiers: a binary search among the files' first and last identifiers chooses files, all those
    that can hold one and no others; Bloom filter and index choose a block."""

    def find(batches):
        from .sstable import Reader

        for batch in batches:
            files: dict[str, Reader] = {}
            for doc_id, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = files.get(file) or files.setdefault(file, Reader(file))
                found = reader.get(doc_id)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    def choose(batches):
        first, last, shards = held.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            # files are in order of identifiers: those that reach up to one, up to those that start at or before it
            low, high = np.searchsorted(last, ids, "left"), np.searchsorted(first, ids, "right")
            n = np.maximum(0, high - low)
            row = np.repeat(np.arange(len(ids)), n)
            at = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(shards[at].astype(np.int64))], ["wanted", "shard"])

    ranges = manifest.select(F.col("shard").cast("long").alias("shard"), "file", "first_id", "last_id")
    # two identifiers and a number per file, so as many rows as there were writing tasks, whatever the identifiers are
    bounds = ranges.where("last_id is not null").select("shard", F.coalesce("first_id", F.lit(-(1 << 63))).alias("first"), "last_id").orderBy("shard").toPandas()
    held = manifest.sparkSession.sparkContext.broadcast((bounds["first"].to_numpy(np.int64), bounds["last_id"].to_numpy(np.int64), bounds["shard"].to_numpy(np.int64)))
    asked = wanted.select(F.col("doc_id").cast("long").alias("wanted")).distinct()
    hits = asked.where("wanted is not null").mapInArrow(choose, "wanted long, shard long").join(ranges.select("shard", "file"), "shard").select("wanted", "file")
    if not asked.where("wanted is null").isEmpty():
        hits = hits.unionByName(ranges.where("first_id is null").select(F.lit(None).cast("long").alias("wanted"), "file"))
    return hits.repartition("file").mapInArrow(find, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_tables(manifest, digest=True)
