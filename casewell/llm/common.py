"""Helpers shared by the training-data operators: table reading, scratch tables, word counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder as scratch_dir
from ..session import ship

#: A word is a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/casewell/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to a table in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = ship(df.sparkSession)
    place = new_folder(spark, name)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def text_key(column: str = "text") -> Column:
    """16 bytes that equal texts share; null has its own."""
    return F.coalesce(F.unhex(F.md5(F.col(column))), F.lit(b"null"))


def crc32_text(column: str = "text") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("binary")), F.lit(0)).cast("long")


def pieces_for(rows: int, per_piece: int) -> int:
    return max(1, -(-rows // per_piece))


def slices(batch, column: int, most: int = 8 << 20):
    """Parts of an Arrow batch whose texts in ``column`` have about ``most`` bytes at most; a longer text is alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


def filed(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is a scan of files, whose rows have a lasting place; else the same rows, written and read."""
    from pyspark.errors import AnalysisException

    try:
        docs.select("_metadata.file_path")
        return docs
    except AnalysisException:
        return saved(docs, "rows")


def _row_id() -> list[Column]:
    return [F.xxhash64("_metadata.file_path").alias("file_no"), F.col("_metadata.row_index").alias("row_no")]


def with_row_id(docs: DataFrame) -> DataFrame:
    """``docs`` with columns file_no and row_no that tell its rows apart, repeated ones too; the same in every scan."""
    return filed(docs).select("*", *_row_id())


def carried(docs: DataFrame) -> DataFrame:
    """file_no, row_no and doc: all columns of ``docs`` in a struct, where their names clash with no others."""
    return filed(docs).select(*_row_id(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def replaced(docs: DataFrame, new: dict[str, Column]) -> list[Column]:
    """The columns of ``docs`` out of ``doc``, some of them replaced."""
    return [new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]


def chars_of(docs: DataFrame, text: Column) -> dict[str, Column]:
    """A new n_chars for a new text, where the table has one."""
    return {"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {}
