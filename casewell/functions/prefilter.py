"""Cheap conditions that a text must meet to match a pattern, read off the pattern itself.

Every match of a pattern holds one of a set of strings (or a digit), found by walking its parse: of what must occur in
turn the longest, of alternatives all. Looking for plain strings in a text folded once is far cheaper than trying the
pattern at every place, so only texts that hold one of them run it. Patterns that give no such set always run.
"""

from __future__ import annotations

from functools import lru_cache
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT = "\\d"


def fold(text: Column) -> Column:
    """Lower case; with the letters that match an ASCII letter in any case besides its own two forms."""
    return F.lower(F.translate(text, "İıſK", "iisk"))


def _rank(found: frozenset[str]) -> tuple[float, int]:
    return min(0.5 if s == DIGIT else len(s) for s in found), -len(found)


def _required(items) -> frozenset[str] | None:
    """Strings of which every match of a sequence holds one."""
    found, run = [], ""

    def ended() -> None:
        nonlocal run
        if run:
            found.append(frozenset([run]))
        run = ""

    for op, value in items:
        if op is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if op is C.AT or op is C.ASSERT_NOT or op is C.ASSERT:
            continue  # no width
        ended()
        inner = None
        if op is C.SUBPATTERN:
            inner = _required(value[3])
        elif op is C.BRANCH:
            parts = [_required(branch) for branch in value[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            inner = _required(value[2])
            if inner and len(value[2]) == 1 and value[2][0][0] is C.LITERAL:
                inner = frozenset([next(iter(inner)) * min(value[0], 8)])
        elif op is C.IN and list(value) == [(C.CATEGORY, C.CATEGORY_DIGIT)]:
            inner = frozenset([DIGIT])
        if inner:
            found.append(inner)
    ended()
    return max(found, key=_rank, default=None)


@lru_cache(maxsize=256)
def required(pattern: str) -> frozenset[str] | None:
    """Strings of which every match, in any case, holds one (``DIGIT``: any digit); None if there are no such."""
    try:
        return _required(_parser.parse(pattern))
    except Exception:  # a pattern of another dialect: it always runs
        return None


def may_match(folded: Column, pattern: str) -> Column | None:
    """A condition on the folded text that every match of the pattern meets; None if there is none."""
    needed = required(pattern)
    if not needed:
        return None
    tests = [folded.rlike(r"(?U)\d") if s == DIGIT else folded.contains(s) for s in sorted(needed)]
    any_of = tests[0]
    for t in tests[1:]:
        any_of = any_of | t
    return any_of
