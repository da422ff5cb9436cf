"""Stable hashes: the same in every session, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_bucket(key: Column, n: int) -> Column:
    """First eight bytes of SHA-256, big-endian unsigned, modulo n."""
    digits = F.substring(F.sha2(key.cast("string"), 256), 1, 16)
    return (F.conv(digits, 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("long")


def text_key(text: Column, model: str, dim: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dim)), text), 256)


def request_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the request as JSON with its fields in alphabetical order, nulls kept."""
    parts = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)
