"""Written tables in the shared checkpoint folder: cut lineage where a plan is iterated."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A machine's own folder is taken only where that is unset and the session is
    local, as in tests: executors of a cluster could not read it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (place or f"file://{tempfile.gettempdir()}/casewell-scratch-{os.getuid()}").rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    return written_as(df, name, df.schema)


def written_as(df: DataFrame, name: str, schema: StructType) -> DataFrame:
    """The same rows, written and read back under a schema that stores the same fields."""
    place = f"{folder(df.sparkSession)}/casewell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(schema).parquet(place)


def bucketed(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """The same rows in a table that is dealt to buckets by a column and sorted in them: joins on that column that use as
    many partitions do not move it again."""
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    place = f"{folder(df.sparkSession)}/casewell/{table}"
    df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", place).saveAsTable(table)
    return df.sparkSession.table(table)
