"""Readers and writers: message logs, JSON-lines threads, vectors, class tables, recorded responses, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_message_log(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV log with header, of the declared columns. Texts may hold line feeds in quotes, so that a file is read by one
    task; logs whose texts hold none (``write_message_log`` can write such) are split at any line: ``multi_line`` False."""
    raw = spark.read.schema(schemas.LOG_FILE).options(header=True, multiLine=multi_line, escape='"', enforceSchema=True).csv(path)
    text = F.col("text") if multi_line else _unbroken(F.col("text"), back=True)
    parent = F.col("in_response_to_tweet_id").cast("long")
    return raw.select(F.col("tweet_id").alias("id"), F.col("author_id").alias("author"), (F.lower("inbound") == "true").alias("inbound"), parent.alias("parent"), "created_at", text.alias("text"))


def _unbroken(text: Column, back: bool = False) -> Column:
    """The text on one line: line feeds and returns as backslash and letter, a backslash as two; and back."""
    if not back:
        return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    held = F.replace(text, F.lit("\\\\"), F.lit("\x00"))  # no text file holds a zero character
    return F.replace(F.replace(F.replace(held, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\x00"), F.lit("\\"))


def write_message_log(log: DataFrame, path: str, one_line: bool = True) -> None:
    """The log as CSV with the reader's columns; with ``one_line`` every row is one line, so files can be split."""
    text = _unbroken(F.col("text")) if one_line else F.col("text")
    rows = log.select(F.col("id").alias("tweet_id"), F.col("author").alias("author_id"), F.col("inbound").cast("string").alias("inbound"), "created_at", text.alias("text"), F.lit(None).cast("string").alias("response_tweet_id"), F.col("parent").cast("double").alias("in_response_to_tweet_id"))
    rows.write.options(header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def scan_structure(log: DataFrame) -> DataFrame:
    """The four structural columns; the reader prunes the rest."""
    return log.select("id", "author", "inbound", "parent")


def scan_text_for_ids(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, created_at and text of the wanted ids."""
    return log.select("id", "created_at", "text").join(wanted.select("id").distinct(), "id", "left_semi")


def write_json_lines(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = schemas.THREAD) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def put_vectors(known: DataFrame, new: DataFrame) -> DataFrame:
    """The vector table with the missing keys added, the first of each."""
    fresh = new.select("key", "vector").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    return known.select("key", "vector").unionByName(fresh)


def taxonomy_dim(classes: DataFrame) -> DataFrame:
    """The class table, checked: no name twice, and a class ``other``."""
    twice = classes.groupBy("name").count().where("count > 1").select("name").limit(5).collect()
    if twice:
        raise ValueError(f"names appear twice: {[r.name for r in twice]}")
    if not classes.where("name = 'other'").limit(1).count():
        raise ValueError("there is no class 'other'")
    return classes


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSE).json(path)


def report_rows(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Rows rendered as lines of a text table, by falling metric; missing text is empty, a missing metric 0."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("0" if c == by else "")) for c in columns]
    metric: Column = F.coalesce(F.col(by).cast("double"), F.lit(0.0))
    ordered = rows.orderBy(F.desc(metric), *columns)
    return ordered.select(F.concat_ws(" | ", *cells).alias("line"))


def append_audit(record: DataFrame, path: str) -> None:
    """One more record of a final scoring run."""
    record.coalesce(1).write.mode("append").json(path)


def write_by_system(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("system").parquet(path)


def multi_system_scan(spark: SparkSession, path: str) -> DataFrame:
    """Outputs of all systems; the folder names tag the rows."""
    return spark.read.parquet(path)
