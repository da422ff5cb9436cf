"""Registered queries: a callable over the given tables, and its SQL for another engine where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def bucket_sql(key: str, n: int) -> str:
    """SQL of the stable bucket."""
    return f"CAST(CAST(concat('0x', substr(sha256({key}), 1, 16)) AS UBIGINT) % {n} AS BIGINT)"


def re2(pattern: str) -> str:
    """A pattern for an engine whose word classes are ASCII and that has no look-around."""
    pattern = pattern.replace(r"(?!URL\])", "")
    pattern = re.sub(r"\\b(?=[\w(\\\[])", r"(?:^|[^\\pL\\pN_])", pattern)
    pattern = pattern.replace(r"\b", r"(?:$|[^\pL\pN_])")
    pattern = re.sub(r"\[\\w", r"[\\pL\\pN_", pattern)
    return pattern.replace(r"\w", r"[\pL\pN_]").replace(r"\W", r"[^\pL\pN_]")


def matches_sql(text: str, pattern: str) -> str:
    return f"regexp_matches(replace({text}, '[URL]', ' '), '(?i){re2(pattern)}')"


def first_sql(text: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN {matches_sql(text, p)} THEN '{n}'" for n, p in patterns) + " END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
