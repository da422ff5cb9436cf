"""The library's functions for SQL users: scalar functions and a table function, all built-in expressions, so a query that
calls them plans like one that spells them out. Pattern lists may be a user's own."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(pattern: str) -> str:
    return f"coalesce(message, '') RLIKE {quoted(T.any_case(pattern))}"


def first_of(patterns: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {found(p)} THEN {quoted(n)}" for n, p in patterns) + " END"


def all_of(patterns: list[tuple[str, str]]) -> str:
    return "array_compact(array(" + ", ".join(f"CASE WHEN {found(p)} THEN {quoted(n)} END" for n, p in patterns) + "))"


BUCKET = "CAST(CAST(conv(substr(sha2(key, 256), 1, 16), 16, 10) AS DECIMAL(20, 0)) % n AS BIGINT)"
DEDUPE = "sha1(trim(regexp_replace(regexp_replace(lower(coalesce(message, '')), '[^a-z0-9 ]', ''), ' +', ' ')))"


def register(spark: SparkSession, pii=None, hard=None, defects=None) -> list[str]:
    """Makes stable_bucket(key, n), dedupe_key(message), match_pii(message), match_hard_escalation(message),
    draft_defects(message) (a table of defect) and defect_names(message) (an array) known to the session; their names."""
    lists = {"match_pii": pii or T.PII, "match_hard_escalation": hard or T.HARD}
    made = {"stable_bucket": ("key STRING, n BIGINT", "BIGINT", BUCKET), "dedupe_key": ("message STRING", "STRING", DEDUPE)}
    made |= {name: ("message STRING", "STRING", first_of(patterns)) for name, patterns in lists.items()}
    made["defect_names"] = ("message STRING", "ARRAY<STRING>", all_of(defects or T.DEFECTS))
    for name, (takes, gives, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION draft_defects(message STRING) RETURNS TABLE (defect STRING) RETURN SELECT explode({all_of(defects or T.DEFECTS)})")
    return [*made, "draft_defects"]
