"""Operator 13 against exhaustive edits, a plain walk over conversations, and awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import engine, same

from casewell.llm import op13_conversation_repair as op13

GOOD = re.compile(r"(?:s?(?:ua)+)?")
STEP = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def exhaustive(turns, most=2):
    """Least (cost, audit) over every edit of every turn and up to ``most`` inserts in every gap."""
    found = None
    gaps = [g for n in range(most + 1) for g in itertools.product("ua", repeat=n)]
    options = []
    for initial, fault in turns:
        more = 5 if fault == "t" else 0
        own = [(2, "D", "")]
        if fault not in ("b", "d"):
            own += [(more, "K", initial), (1 + more, "R", "u"), (1 + more, "R", "a")]
        options.append(own)
    for before in itertools.product(gaps, repeat=len(turns) + 1):
        for edits in itertools.product(*options):
            cost, audit, left = 5 * len(before[0]), "I" * len(before[0]), "".join(before[0])
            for (c, e, i), gap in zip(edits, before[1:]):
                cost, audit, left = cost + c + 5 * len(gap), audit + e + "I" * len(gap), left + (i or "?" if e == "K" else i) + "".join(gap)
            if GOOD.fullmatch(left) and (found is None or (cost, audit) < found):
                found = cost, audit
    return found


def walk(turns):
    """The same turn by turn."""

    def closed(cells):
        for _ in range(3):
            for (p, letter), q in STEP.items():
                if letter != "s" and p in cells:
                    c = (cells[p][0] + 5, cells[p][1] + "I")
                    cells[q] = min(cells.get(q, c), c)
        return cells

    cells = closed({"B": (0, "")})
    for initial, fault in turns:
        new, more = {}, 5 if fault == "t" else 0

        def put(q, c, new=new):
            new[q] = min(new.get(q, c), c)

        for p, (cost, audit) in cells.items():
            put(p, (cost + 2, audit + "D"))
            if fault not in ("b", "d"):
                for (x, letter), q in STEP.items():
                    if x == p and letter == initial:
                        put(q, (cost + more, audit + "K"))
                    if x == p and letter != "s":
                        put(q, (cost + more + 1, audit + "R"))
        cells = closed(new)
    return min(cells[p] for p in "BA" if p in cells)


def parse(turns):
    cells = op13.turn_cells(np.array([i.encode() if i in ("s", "u", "a") else b"-" for i, _ in turns], "S1"), np.array([f.encode() for _, f in turns], "S1"))
    cost, audit = op13.best(op13.span_cells(cells, np.zeros(len(turns), np.int64)))
    return int(cost[0]), audit[0].decode()


def test_least_edits_equal_exhaustive_search():
    random.seed(5)
    for n in (1, 2, 3):
        for _ in range(25):
            turns = [(random.choice("suat"), random.choice(["", "", "b", "d", "t"])) for _ in range(n)]
            assert parse(turns) == exhaustive(turns) == walk(turns), turns


def test_spans_of_any_length_equal_a_walk():
    random.seed(6)
    for n in [1, 2, 3, 5, 7, 8, 9, 31, 64, 65, 200]:
        for _ in range(8):
            turns = [(random.choice("suuaaat"), random.choice(["", "", "", "", "b", "d", "t"])) for _ in range(n)]
            assert parse(turns) == walk(turns)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def expected(rows, spoil=damage):
    every = {r[0] for r in rows}
    convs = defaultdict(list)
    for r in spoil(rows):
        convs[r[0]].append(r[1:])
    out = {}
    for conv in every:
        turns = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            left = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit = walk(list(zip(initials, faults))) if turns else (0, "")
        left, k = [], 0
        letters = [(e, None if e == "I" else turns[(k := k + 1) - 1]) for e in audit]
        letters = [x for x in letters if x[0] != "D"]
        system = bool(letters) and letters[0][0] == "K" and letters[0][1][1][:1] == "s"
        for place, (e, t) in enumerate(letters):
            own = ["user", "assistant"][(place - system) % 2]
            left.append(f"{t[1] if e == 'K' else own}:{t[2] if t else ''}")
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def rows_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query_equals_plain_repair_of_every_conversation(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13.query(spark, d)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert rows_of(got) == expected(rows)
    same(got, engine(d).sql(op13.ORACLE_SQL).df())


@pytest.mark.parametrize("span", [1, 2, 7, 512])
def test_awkward_and_long_conversations(spark, span):
    random.seed(span)
    texts = ["Fine.", "cut off", "", None, "  \n", "Really?", "ünï 😀!", "x " * 20000 + "end."]
    rows = [(c, random.choice([None, *range(6)]), random.choice(["user", "assistant", "system", "tool", "", None, "useless"]), random.choice(texts)) for c in [1, 1, 2, 3, None] for _ in range(9)]
    rows += [(7, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(600)] + [(8, 5, "user", "Same.")] * 300 + [(9, t // 3, "user", "Same.") for t in range(90)] + [(10, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n long, mark string")
    turns, found = op13.repair(op13.damaged(docs), span)
    assert rows_of(op13.repair_digests(docs, turns, found)) == expected(rows)


def test_repaired_turns_are_an_output_and_follow_the_pattern(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", ""), (2, 0, "user", "Cut"), (3, 0, "user", "Alone.")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in op13.repaired(*op13.repair(conversations)).orderBy("conv_id", "place").collect():
        got[r.conv_id].append((r.edit, r.role, r.text))
    want = expected(rows, spoil=lambda rows: rows)
    for conv, turns in got.items():
        assert GOOD.fullmatch("".join(role[0] for _, role, _ in turns))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode()).hexdigest() == want[conv][-1]
    assert set(got) == {c for c, w in want.items() if w[6].strip("D")}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op13.repair_digests(none, *op13.repair(op13.damaged(none))).count() == 0
