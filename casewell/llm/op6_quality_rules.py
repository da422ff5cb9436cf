"""Operator 6, quality rules: a threshold table compiled into one Spark projection, without user functions.

Each row of ``RULES`` is (name, metric, least, most); a bound of None does not apply. ``compile_rules``
turns the table into one boolean expression over the measured columns, so a rule is data, not code.

Defined results: null and empty texts have no words and fail the base rule; ratios over no words are
null and a null metric breaks no rule; repeated rows repeat; an empty table gives no rows; other
columns are ignored. No shuffle: everything is computed inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, WORD, table, text_of

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is was for that it on as with be by this are at from or an not have he "
    "le la les des de et un une est dans que pour en du qui au sur pas ne se "
    "der die das und ist nicht ein eine von mit den im zu auf sich dem es "
    "el los las del que y por con para una su al lo como"
).split()

WINDOW = 8

#: (name, metric, least, most)
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("not_too_long", "n_words", None, 100_000),
    ("word_length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "stop_word_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.3),
    ("line_words", "words_per_line", 1.5, None),
]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and every metric of ``RULES``, with the counts they come from."""
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select(
        "doc_id", "text",
        F.filter(F.split("text", BLANK), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    n_windows = F.size("words") - (WINDOW - 1)
    hashes = F.when(n_windows > 1, F.transform(F.sequence(F.lit(1), n_windows), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        hashes.alias("hashes"),
    )
    # windows found twice: equal neighbours after sorting; sorted only where a text has any
    some = F.size("hashes") > F.size(F.array_distinct("hashes"))
    rows = rows.withColumn("ranked", F.when(some, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
    marked = F.transform("ranked", lambda e, k: F.when(same(e, F.get("ranked", k - 1)) | same(e, F.get("ranked", k + 1)), e["i"]))
    rows = rows.withColumn("found", F.sort_array(F.array_compact(marked)))
    covered = F.aggregate(
        "found",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(a["end"], x)).alias("n"), (x + WINDOW).cast("long").alias("end")),
    )["n"]
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("n_stop_words") / words).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
        (F.col("n_words") / lines).alias("words_per_line"),
    )


def compile_rules(rules=RULES) -> dict[str, Column]:
    """Rule name to the condition that it is broken."""
    broken = {}
    for name, metric, least, most in rules:
        bounds = [F.col(metric) < least] if least is not None else []
        bounds += [F.col(metric) > most] if most is not None else []
        broken[name] = F.coalesce(F.array_contains(F.array(*bounds), True), F.lit(False))
    return broken


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """The counts, base_failed, kept and the names of broken rules."""
    rows, broken = measured(docs), compile_rules(rules)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in broken.items())))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), names.alias("broken_rules"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumn("broken_rules", F.array_join("broken_rules", ","))


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    blank = r"[\x20\x09-\x0D]+"
    checks = []
    for name, metric, least, most in RULES:
        parts = [f"{metric} < {least}"] if least is not None else []
        parts += [f"{metric} > {most}"] if most is not None else []
        checks.append(f"CASE WHEN coalesce({' OR '.join(parts)}, false) THEN '{name}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
a AS (SELECT *, list_filter(regexp_split_to_array(text, '{blank}'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM a WHERE len(words) >= 8),
h AS (SELECT r, i, words[i:i + 7] AS win FROM w),
f AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM f),
c AS (SELECT r, sum(least(8, i - coalesce(before, -8))) AS n FROM g GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop,
  coalesce(c.n, 0) AS n_repeat_words FROM a LEFT JOIN c USING (r)),
n AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio,
  n_stop / nullif(n_words, 0) AS stop_word_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
  n_words / nullif(n_lines, 0) AS words_per_line,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
o AS (SELECT *, list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL) AS broken_rules FROM n)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, array_to_string(broken_rules, ',') AS broken_rules,
  (NOT base_failed AND len(broken_rules) = 0) AS kept FROM o
"""


ORACLE_SQL = _sql()
