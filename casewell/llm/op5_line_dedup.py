"""Operator 5, line dedup: a segment-partition edit join over lines, in DataFrame expressions only.

A line of at least ``WORDS`` words and ``CHARS`` code points is removed if an equal line, or one
within ``EDITS`` edits (insert, delete, replace), stands earlier in the table: in order of doc_id
(null last), then of rows and lines. Other lines stay. Equal lines are one entry, its first
occurrence.

Edit join: lines are cut into ``EDITS`` + 1 segments; two lines within ``EDITS`` edits share one of
the shorter line's segments, at a position that depends on its number and on the length difference
(multi-match-aware selection). A line has keys (hash of substring, length, segment number) for its own
segments and for every substring that may match a segment of a line shorter by up to ``EDITS``. Keys
that only one line has are dropped by a map-side aggregation. Lines that share a key are compared by
length and banded edit distance inside arrays of at most two blocks of ``BLOCK`` lines; a key with
more lines is cut in blocks with one row per pair of blocks, so candidates are never rows of pairs.

Defined results: null and empty texts have one empty line, which stays; repeated rows repeat earlier
lines, so theirs are removed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, carried, chars_of, filed, replaced, saved, table, text_of, with_row_id

WORDS, CHARS, EDITS, BLOCK, SMALL = 5, 24, 2, 96, 250_000


def selections(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every substring of a line that may equal a segment of a line not longer."""
    return [(d, i, s) for d in range(edits + 1) for i in range(edits + 1) for s in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)]


OWN = [k for k, (d, _, s) in enumerate(selections()) if d == 0 and s == 0]


def segment_keys(line: Column) -> Column:
    keys, n = [], EDITS + 1
    for d, i, s in selections():
        length = F.length(line) - d
        base, rest = F.floor(length / n), length % n
        start = i * base + F.greatest(F.lit(0), i - (n - rest))
        size = base + F.when(i >= n - rest, 1).otherwise(0)
        keys.append(F.xxhash64(F.substring(line, (start + s + 1).cast("int"), size.cast("int")), length.cast("int"), F.lit(i)))
    return F.array(*keys)


def joined_small(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a written table of two longs or so a row: by broadcast if it has at most ``SMALL`` rows (about 10 MB), else as Spark chooses."""
    return rows.join(F.broadcast(small) if small.count() <= SMALL else small, on)


#: At least WORDS words, found without counting the rest of the line.
ENOUGH = rf"^[\x20\x09-\x0D]*(?:{WORD}[\x20\x09-\x0D]+){{{WORDS - 1}}}[^\x20\x09-\x0D]"


class Lines:
    """docs: file_no, row_no, doc_id, n_lines, hashes of the text; lines: the place, hashes and keys of every line that may be removed."""

    def __init__(self, docs: DataFrame):
        rows = with_row_id(docs.select("doc_id", "text")).select("file_no", "row_no", "doc_id", text_of().alias("text"))
        self.docs = rows.select("file_no", "row_no", "doc_id", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("n_lines"), F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("t2"))
        fits = (F.length("line") >= CHARS) & F.col("line").rlike(ENOUGH)
        every = rows.select("file_no", "row_no", "doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(fits)
        hashed = [F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2")]
        # the keys are a projection of their own: a generator would compute shared parts of them again and again
        self.lines = saved(every.select("file_no", "row_no", "doc_id", "no", *hashed, segment_keys(F.col("line")).alias("keys")), "lines")
        self.text = every.select("line", *hashed)

    def occurrences(self) -> DataFrame:
        place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "file_no", "row_no", "no")
        return self.lines.select("file_no", "row_no", "no", "h", "h2", place.alias("place"))

    def similar(self, firsts: DataFrame) -> DataFrame:
        """h, h2 of distinct lines that have an earlier line within EDITS edits."""
        keys = self.lines.select("h", "h2", F.posexplode("keys").alias("k", "key"))
        shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max(F.col("k").isin(OWN)).alias("own"))
        shared = saved(shared.where("low <> high and own").select("key"), "line-keys")
        members = saved(joined_small(keys.select("h", "h2", "key"), shared, ["key"]).distinct(), "line-members")
        wanted = saved(members.select("h", "h2").distinct(), "line-wanted")
        texts = joined_small(self.text, wanted, ["h", "h2"]).dropDuplicates(["h", "h2"])
        texts = saved(texts.join(firsts.select("h", "h2", "place"), ["h", "h2"]), "line-texts")
        blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        cells = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("h", "h2"), "blocks").cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("h", "h2", "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
        filled = cells.join(texts, ["h", "h2"]).groupBy("key", "left", "right").agg(F.collect_list(F.struct("place", "h", "h2", "line", F.length("line").alias("n"))).alias("m"))
        near = lambda a, b: (b["place"] < a["place"]) & (F.abs(a["n"] - b["n"]) <= EDITS) & (F.levenshtein(a["line"], b["line"], EDITS) >= 0)
        found = F.filter("m", lambda a: F.exists("m", lambda b: near(a, b)))
        return filled.select(F.explode(F.transform(found, lambda a: F.struct(a["h"], a["h2"]))).alias("x")).select("x.h", "x.h2").distinct()

    def removed(self) -> DataFrame:
        """file_no, row_no, removed: the numbers of removed lines, of documents that lose any."""
        firsts = saved(self.occurrences().groupBy("h", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n")), "line-firsts")
        near = self.similar(firsts).withColumn("near", F.lit(True))
        known = firsts.join(near, ["h", "h2"], "left").where("n > 1 or near").select("h", "h2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
        hit = self.occurrences().join(saved(known, "line-known"), ["h", "h2"]).where(F.col("near") | (F.col("place") != F.col("first")))
        return hit.groupBy("file_no", "row_no").agg(F.array_sort(F.collect_list("no")).alias("removed"))

    def copies(self) -> DataFrame:
        """file_no, row_no of rows whose whole text stands in an earlier row."""
        place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "file_no", "row_no")
        rows = self.docs.select("file_no", "row_no", "t", "t2", place.alias("place"))
        firsts = saved(rows.groupBy("t", "t2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-copied")
        return joined_small(rows, firsts, ["t", "t2"]).where("place <> first").select("file_no", "row_no")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, with commas) of every document."""
    lines = Lines(table(spark, sf_dir, "documents"))
    rows = lines.docs.select("file_no", "row_no", "doc_id", "n_lines").join(lines.removed(), ["file_no", "row_no"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(F.transform(removed, lambda x: x.cast("string")), ",").alias("removed_lines"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with their removed lines taken out of text (n_chars follows). Of the documents that lose lines, those go
    of which no line with a word is left, and those whose whole text an earlier row has: that one keeps their other lines."""
    docs = filed(docs)
    lines = Lines(docs)
    copies = lines.copies().withColumn("copy", F.lit(True))
    removed = saved(lines.removed().join(copies, ["file_no", "row_no"], "left"), "line-removed")
    rows = carried(docs).join(removed, ["file_no", "row_no"], "left")
    left = F.array_join(F.filter(F.split("doc.text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    rows = rows.withColumn("left_text", F.when(F.col("removed").isNotNull(), left))
    rows = rows.where(F.col("removed").isNull() | (F.col("copy").isNull() & F.col("left_text").rlike(WORD)))
    text = F.coalesce("left_text", "doc.text")
    chars = {c: F.when(F.col("removed").isNull(), F.col("doc.n_chars")).otherwise(n) for c, n in chars_of(docs, text).items()}
    return rows.select(*replaced(docs, {"text": text} | chars))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, lines[i + 1] AS line, i AS no FROM (SELECT r, doc_id, lines, unnest(range(0, len(lines))) AS i FROM d)),
e AS (SELECT *, length(line) AS n, row_number() OVER (ORDER BY doc_id NULLS LAST, r, no) AS place FROM l
  WHERE length(line) >= {CHARS} AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {WORDS}),
f AS (SELECT line, n, min(place) AS place FROM e GROUP BY line, n),
s AS (SELECT DISTINCT a.line FROM f a JOIN (SELECT *, unnest(range(n - {EDITS}, n + {EDITS + 1})) AS m FROM f) b
  ON a.n = b.m AND b.place < a.place WHERE levenshtein(a.line, b.line) <= {EDITS}),
x AS (SELECT e.r, e.no FROM e JOIN f USING (line) LEFT JOIN s USING (line) WHERE s.line IS NOT NULL OR e.place <> f.place),
g AS (SELECT r, list(CAST(no AS INTEGER) ORDER BY no) AS removed FROM x GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
  coalesce(array_to_string(removed, ','), '') AS removed_lines FROM d LEFT JOIN g USING (r)
"""
