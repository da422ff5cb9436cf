"""Operator 13, repair of conversation structure by weighted CYK parsing of spans.

Every turn is kept (0), given another role (1) or deleted (2; blank and repeated turns must be), and empty turns may be
put in anywhere (5), so that what is left reads ``(s?(ua)+)?``; a truncated turn that stays costs 5 more. The cheapest
way wins, and of equally cheap ones the least string of edit letters (D, I, K, R).

The grammar is in Chomsky normal form over pairs of places in the pattern (B nothing yet, S after a system turn, U after
a user turn, A after an assistant turn): a nonterminal ``pq`` derives the turns of a span that lead from p to q, by
``pq -> pr rq``, by one edited turn, or by inserted turns alone (the insertion closure, which surrounds every edited
turn). A cell of a span holds the least (cost, audit) of each nonterminal. Cells are combined bottom-up by span length:
1, 2, 4, 8, ... turns. One split per span is enough: two edits of a span with equal cost and nonterminal are never one
the beginning of the other (the longer one would hold more inserts), so the least of a concatenation is the
concatenation of the least, and with nonterminals for both ends of a span every split gives the same cell.

Conversations are not parsed as a whole in one task. Turns are range-partitioned by conversation and order, so a long
conversation lies over many tasks; each task sums up its runs of at most ``SPAN`` turns to cells and mergeable counts,
and the few cells of a conversation are combined after a shuffle. Only the digest of the repaired text, one chain by
definition, is made by streaming the turns of a conversation through one task, batch by batch, after its edits.

Defined results: turns are taken by turn (nulls first), then role, then text; null conv_id is a conversation of its own;
a null role or text is one space; a role whose first letter is not s, u or a (or that is empty) cannot be kept; identical
rows count as often as they stand there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, table

PLACES = "BSUA"
#: The pattern: from place, letter, to place.
STEPS = [("B", "s", "S"), ("B", "u", "U"), ("S", "u", "U"), ("U", "a", "A"), ("A", "u", "U")]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns of a run that a task sums up to one cell.
SPAN = 512
#: A cost that no edit has.
NEVER = 1 << 40
TEXT = r"[^\x20\x09-\x0D]"


def pairs() -> list[tuple[str, str]]:
    """Nonterminals: pairs of places of which the second can be reached from the first."""
    reach = {p: {p} for p in PLACES}
    for _ in PLACES:
        for p, _, q in STEPS:
            for r in PLACES:
                if p in reach[r]:
                    reach[r].add(q)
    return [(p, q) for p in PLACES for q in PLACES if q in reach[p]]


PAIRS = pairs()
AT = {x: k for k, x in enumerate(PAIRS)}
#: ``pq -> pr rq``: the rules of each nonterminal.
RULES = [[(AT[p, r], AT[r, q]) for r in PLACES if (p, r) in AT and (r, q) in AT] for p, q in PAIRS]
ENDS = [AT["B", "B"], AT["B", "A"]]

Cells = tuple[np.ndarray, np.ndarray]  # costs and audits (bytes), spans by nonterminals


def least(cost: np.ndarray, audit: np.ndarray, other_cost: np.ndarray, other_audit: np.ndarray) -> Cells:
    better = (other_cost < cost) | ((other_cost == cost) & (other_audit < audit))
    return np.where(better, other_cost, cost), np.where(better, other_audit, audit)


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of spans that follow one another, pair by pair."""
    costs, audits = [], []
    for rules in RULES:
        cost = audit = None
        for a, b in rules:
            c, t = left[0][:, a] + right[0][:, b], np.strings.add(left[1][:, a], right[1][:, b])
            cost, audit = (c, t) if cost is None else least(cost, audit, c, t)
        costs.append(np.minimum(cost, NEVER))
        audits.append(audit)
    cost = np.column_stack(costs)
    audit = np.where(cost < NEVER, np.column_stack(audits), b"")
    width = int(np.strings.str_len(audit).max(initial=1))
    return cost, audit.astype(f"S{max(1, width)}")


def _empty(n: int) -> Cells:
    """Cells of no turns and no inserts."""
    cost = np.full((n, len(PAIRS)), NEVER)
    cost[:, [AT[p, p] for p in PLACES]] = 0
    return cost, np.zeros((n, len(PAIRS)), "S1")


def closure() -> Cells:
    """What inserted turns alone can do."""
    cost, audit = _empty(1)
    for p, letter, q in STEPS:
        if letter in "ua":
            cost[0, AT[p, q]], audit[0, AT[p, q]] = INSERT, b"I"
    out = _empty(1)
    for _ in PLACES:
        out = combined(out, (cost, audit))
    return out


def turn_cells(initial: np.ndarray, fault: np.ndarray) -> Cells:
    """Cells of single turns: initials (s, u, a or anything else) and faults (b, d, t or none), as one byte each."""
    n = len(initial)
    cost, audit = np.full((n, len(PAIRS)), NEVER), np.zeros((n, len(PAIRS)), "S1")
    for p in PLACES:
        cost[:, AT[p, p]], audit[:, AT[p, p]] = DELETE, b"D"
    stays, more = (fault != b"b") & (fault != b"d"), np.where(fault == b"t", TRUNCATED, 0)
    for p, letter, q in STEPS:
        k, kept = AT[p, q], stays & (initial == letter.encode())
        if letter in "ua":
            cost[stays, k], audit[stays, k] = (REROLE + more)[stays], b"R"
        cost[kept, k], audit[kept, k] = (KEEP + more)[kept], b"K"
    around, n_around = closure(), np.zeros(n, np.int64)
    around = around[0][n_around], around[1][n_around]
    return combined(combined(around, (cost, audit)), around)


def span_cells(cells: Cells, owner: np.ndarray) -> Cells:
    """One cell per owner out of consecutive cells (owners are 0, 1, 2, ... in order), by span lengths 1, 2, 4, ..."""
    cost, audit = cells
    while len(owner) and (same := owner[1:] == owner[:-1]).any():
        first = np.concatenate([[True], ~same])
        place = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
        left = np.flatnonzero((place % 2 == 0) & np.concatenate([same, [False]]))
        alone = np.flatnonzero((place % 2 == 0) & ~np.concatenate([same, [False]]))
        joined = combined((cost[left], audit[left]), (cost[left + 1], audit[left + 1]))
        kept = np.concatenate([left, alone])
        order = np.argsort(kept, kind="stable")
        width = max(joined[1].itemsize, audit.itemsize)
        cost = np.concatenate([joined[0], cost[alone]])[order]
        audit = np.concatenate([joined[1].astype(f"S{width}"), audit[alone].astype(f"S{width}")])[order]
        owner = owner[kept[order]]
    return cost, audit


def best(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Cost and audit of whole conversations."""
    (cost, audit), (x, y) = cells, ENDS
    return least(cost[:, x], audit[:, x], cost[:, y], audit[:, y])


# ---- turns


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the crc32 of conv_id:turn decides."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def judged(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``n``, how often each stands there, its initial and the fault of its first copy (b blank,
    d duplicate, t truncated, or none). Further copies of a turn that is not blank are duplicates."""
    key = ["conv_id", "role", "mark"]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("mark", F.unhex(F.md5("text")))
    # where a (conversation, role, text) is first seen: at a null turn, else at its least
    first = rows.groupBy(*(F.col(c).alias(f"{c}_") for c in key)).agg(F.max(F.col("turn").isNull()).alias("at_null"), F.min("turn").alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]
    again = ~F.when(F.col("at_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    rows = rows.join(first, same).select("conv_id", "turn", "role", "text", "n", again.alias("again"))
    last = F.regexp_extract("text", rf"({TEXT})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "b").when(F.col("again"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    return rows.select("conv_id", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


ORDER = ["turn", "role", "text"]


def _order(*first: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*first, *ORDER)]


RUN = "conv_id long, part int, run long, blank long, duplicate long, truncated long, illegal long, initials string, turns array<long>, n_turns long, cost array<long>, audit array<string>"


def _runs(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Sums of consecutive turns of a conversation, at most ``span`` of them: counts, first and last initial and turn,
    cells. A turn's further copies are turns of their own."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.maximum(1, batch.column("n").to_numpy())
        conv, turn = batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist()
        initial = np.array([x.encode() if x in ("s", "u", "a") else b"-" for x in batch.column("initial").to_pylist()], "S1")
        fault = np.array([x.encode() for x in batch.column("fault").to_pylist()], "S1")
        start, total = 0, np.cumsum(n)
        for at in range(0, int(total[-1]) if len(n) else 0, 1 << 16):  # copies are laid out in bounded slices
            places = np.arange(at, min(at + (1 << 16), int(total[-1])))
            row = np.searchsorted(total, places, "right")
            copy = places > np.concatenate([[0], total])[row]
            letters, faults = initial[row], np.where(copy & (fault[row] != b"b"), b"d", fault[row])
            ids = [conv[k] for k in row.tolist()]
            change = np.array([True, *(x != y for x, y in zip(ids[1:], ids[:-1]))])
            begin = np.maximum.accumulate(np.where(change, np.arange(len(ids)), 0))
            owner = np.cumsum(change | ((np.arange(len(ids)) - begin) % span == 0)) - 1
            cost, audit = span_cells(turn_cells(letters, faults), owner)
            edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
            fine = np.isin(np.strings.add(letters[:-1], letters[1:]), [b"su", b"ua", b"au"])
            rows = []
            for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                f, own = faults[x:y], [turn[r] for r in dict.fromkeys(row[x:y].tolist())]
                known = [t for t in own if t is not None]
                rows.append((
                    ids[x], part, number + k, int((f == b"b").sum()), int((f == b"d").sum()), int((f == b"t").sum()), int((~fine[x : y - 1]).sum()), (letters[x] + letters[y - 1]).decode(),
                    [known[0], known[-1]] if known else [], len(set(known)), cost[k].tolist(), [a.decode() for a in audit[k]],
                ))
            number += len(rows)
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], SCHEMA)


SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("initials", pa.string()),
    ("turns", pa.list_(pa.int64())), ("n_turns", pa.int64()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())),
])
PARSED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations out of their runs, which come in order; cells of a conversation are combined as they come."""
    open_ = None

    def done(rows: list) -> pa.RecordBatch:
        cost, audit = best((np.concatenate([r["cell"][0] for r in rows]), np.concatenate([r["cell"][1].astype(f"S{max(x['cell'][1].itemsize for x in rows)}") for r in rows])))
        columns = [[r[c] for r in rows] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal")]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(cost), pa.array([a.decode() for a in audit])], [c.split()[0] for c in PARSED.split(", ")])

    def closed(rows: list) -> dict:
        owner = np.zeros(len(rows), np.int64)
        width = max(len(a) for r in rows for a in r["audit"]) or 1
        cells = (np.array([r["cost"] for r in rows]), np.array([[a.encode() for a in r["audit"]] for r in rows], f"S{width}"))
        out = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")} | {"conv_id": rows[0]["conv_id"], "cell": span_cells(cells, owner)}
        out["illegal"] += sum(x["initials"][-1] + y["initials"][0] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
        known = [r for r in rows if r["turns"]]
        n = sum(r["n_turns"] for r in known) - sum(x["turns"][1] == y["turns"][0] for x, y in zip(known, known[1:]))
        out["gaps"] = known[-1]["turns"][1] - known[0]["turns"][0] + 1 - n if known else 0
        return out

    for batch in batches:
        ready = []
        for conv, rows in groupby(batch.to_pylist(), key=lambda r: r["conv_id"]):
            rows = list(rows)
            if open_ and open_[0] == conv:
                open_[1].extend(rows)
                continue
            if open_:
                ready.append(closed(open_[1]))
            open_ = (conv, rows)
        if ready:
            yield done(ready)
    if open_:
        yield done([closed(open_[1])])


def parsed(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Per conversation: gaps, faults and illegal neighbours, cost and audit. ``turns`` as ``judged`` gives them."""
    rows = turns.select("conv_id", *ORDER, "n", "initial", "fault")
    spread = rows.repartitionByRange(*_order("conv_id")).sortWithinPartitions(*_order("conv_id"))
    runs = spread.select("conv_id", "turn", "n", "initial", "fault").mapInArrow(partial(_runs, span=span), RUN)
    return runs.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "run").mapInArrow(_parsed, PARSED)


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of every conversation, turn by turn; the row with its audit comes first."""
    audit, at, place, expected = "", 0, 0, "user"
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    for batch in batches:
        out = []

        def put(conv, edit, turn, role, text):
            nonlocal place, expected
            out.append((conv, place, edit, turn, role, text))
            place, expected = place + 1, "assistant" if role[:1] == "u" else "user"

        def inserted(conv):
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(conv, "I", None, expected, "")
                at += 1

        for r in batch.to_pylist():
            if r["audit"] is not None:
                audit, at, place, expected = r["audit"], 0, 0, "user"
                inserted(r["conv_id"])
                continue
            for _ in range(r["n"]):
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(r["conv_id"], edit, r["turn"], r["role"] if edit == "K" else expected, r["text"])
                inserted(r["conv_id"])
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], OUT)
                out.clear()
        yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], OUT)


OUT = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _streamed(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit row and then its turns in order, in one task each, never together in memory."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"))))
    rows = turns.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), *ORDER, "n")
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*_order("conv_id", "kind"))


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, edit (K, R, I), turn (null if inserted), role, text."""
    return _streamed(turns, found).mapInArrow(_repaired, REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = conv = None
    for batch in _repaired(batches):
        ready = []
        for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if digest:
                    ready.append((conv, digest.hexdigest()))
                digest, conv = hashlib.sha256(), c
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in ready], pa.int64()), pa.array([h for _, h in ready], pa.string())], ["conv_id", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) and, per conversation, what ``parsed`` finds; and the judged turns."""
    ship(conversations.sparkSession)
    turns = saved(judged(conversations), "turns")
    return turns, saved(parsed(turns, span), "parsed")


def repair_digests(original: DataFrame, turns: DataFrame, found: DataFrame) -> DataFrame:
    """One row per conversation of ``original``; those that have no turns left have zeros and an empty audit."""
    digests = _streamed(turns, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    out = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for k, other in enumerate((found, digests)):
        out = out.join(other.withColumnRenamed("conv_id", f"id{k}"), F.col("conv_id").eqNullSafe(F.col(f"id{k}")), "left")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_digests(rows, *repair(damaged(rows)))


def _plus(cell: str, cost: str, letter: str) -> str:
    return f"(lpad(CAST(CAST(substr({cell}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({cell}, 10) || '{letter}')"


def _into(letter: str, q: str, places: str) -> str:
    """The least cell of place ``q`` after one turn: it is deleted, or leads there from one of ``places``."""
    ways = [_plus(q, "2", "D"), *(f"CASE WHEN stays AND initial = '{letter}' THEN {_plus(p, 'more', 'K')} END" for p in places)]
    ways += [f"CASE WHEN stays THEN {_plus(p, 'more + 1', 'R')} END" for p in places if letter != "s"]
    return f"least({', '.join(ways)})"


#: The same by a walk over each conversation, turn by turn: cells of the four places as nine digits of cost and the audit.
ORACLE_SQL = rf"""WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
d1 AS (SELECT d0.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))),
  lambda x, y: xor(x // 256, t[xor(x, y) % 256 + 1])), 4294967295) % 20 AS kind FROM d0, crc),
d2 AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d1 WHERE kind <> 0),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
d3 AS (SELECT ids.g, turn, role, text, substr(role, 1, 1) AS initial, row_number() OVER w AS rn,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final, lag(substr(role, 1, 1)) OVER w AS before
  FROM d2 JOIN ids ON ids.conv_id IS NOT DISTINCT FROM d2.conv_id WINDOW w AS (PARTITION BY ids.g ORDER BY turn NULLS FIRST, role, text)),
d4 AS (SELECT *, CASE WHEN final = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY rn) > 1 THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM d3),
d5 AS (SELECT *, fault NOT IN ('b', 'd') AS stays, CASE fault WHEN 't' THEN 5 ELSE 0 END AS more FROM d4),
walk(g, rn, b, s, u, a) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), '000000005I', '000000010II' FROM d5 UNION ALL
  SELECT g, rn, b, s, u, least(a, {_plus('u', '5', 'I')}) FROM (SELECT g, rn, b, s, least(u, {_plus('b', '5', 'I')}, {_plus('s', '5', 'I')}, {_plus('a', '5', 'I')}) AS u, a FROM (
    SELECT g, d5.rn, {_plus('b', '2', 'D')} AS b, {_into('s', 's', 'b')} AS s, {_into('u', 'u', 'bsa')} AS u, {_into('a', 'a', 'u')} AS a FROM walk JOIN d5 USING (g) WHERE d5.rn = walk.rn + 1))),
best AS (SELECT g, arg_max(least(b, a), rn) AS x FROM walk GROUP BY g),
found AS (SELECT g, CAST(substr(x, 1, 9) AS BIGINT) AS cost, substr(x, 10) AS audit FROM best),
letters AS (SELECT g, i, substr(audit, i, 1) AS edit, length(replace(substr(audit, 1, i), 'I', '')) AS rn FROM (SELECT g, audit, unnest(range(1, length(audit) + 1)) AS i FROM found)),
l1 AS (SELECT l.g, l.i, l.edit, CASE l.edit WHEN 'I' THEN '' ELSE d5.text END AS text, d5.role, d5.initial, row_number() OVER (PARTITION BY l.g ORDER BY l.i) AS place FROM letters l LEFT JOIN d5 ON d5.g = l.g AND d5.rn = l.rn WHERE l.edit <> 'D'),
l2 AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS led FROM l1),
digests AS (SELECT g, sha256(string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', text), chr(10) ORDER BY place)) AS h FROM l2 GROUP BY g),
sums AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal FROM d5 GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256 FROM ids LEFT JOIN sums USING (g) LEFT JOIN found USING (g) LEFT JOIN digests USING (g)"""
