"""Operator 11, alignment of the tokens of two vocabularies by merge-path partitioning.

Every text is encoded by a byte-level vocabulary (A, of space + text) and a piece vocabulary (B, which adds that
space itself), so both cover the same bytes. A text is a chain of segments: chunks started by a space or a line
feed, where both vocabularies provably never join across it, else the whole text. The distinct segments that a worker has
not met yet are laid end to end on one byte axis, which gives two sorted lists of token ends. Merging them is cut by
diagonals: a binary search on each diagonal finds where the merge crosses it, so pieces have equal work whatever
the texts are, and none needs another. A piece emits the ends that both lists hold; an end whose two tokens fall on
either side of a diagonal is added at that border, and the groups (tokens between two common ends) that span
borders come out of the stitched list. Segments of a text follow one another, so do their groups.

A link is a pair of tokens that end together. How often a pair of ids is linked is counted over all texts by a
grouped sum; the table of pairs is bounded by the two vocabularies, not by the texts. It goes to the tasks by
broadcast while it has at most ``MOST_PAIRS`` rows (20 bytes each) and is joined by a shuffle beyond.

Defined results: texts that are null, empty, or whose tokens do not spell space + text (such as those that hold
U+2581) have no tokens; repeated rows repeat and count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, slices, table, text_of, with_row_id
from .op10_token_counts import MARK, piece_counter
from .word_encoder import Kept, byte_letters

#: Elements of a piece of the merge; segments that a worker keeps; rows of a pair table that is broadcast.
PIECE, KEPT, MOST_PAIRS = 4096, 300_000, 4_000_000
#: Blanks: a superset of what A calls one.
_S = r"[\s\x85᠎​﻿]"
#: A text is cut at its spaces unless one stands at an end or before another blank, and then at line feeds between no blanks.
UNCUT, BLANKS = re.compile(rf"^[ \n]| $| {_S}|{MARK}"), re.compile(rf"\n{_S}|{_S}\n|\n$")


def crossings(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted lists crosses every ``piece``-th diagonal: elements of a and of b before it. An
    element of a goes before its equal of b. One binary search per diagonal, all of them side by side."""
    d = np.minimum(np.arange(0, len(a) + len(b) + piece, piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = np.zeros(len(d), bool)
        before[open_] = a[mid[open_]] <= b[(d - mid - 1)[open_]]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that two strictly rising lists share."""
    at = np.searchsorted(b, a)
    i = np.flatnonzero(at < len(b))
    i = i[b[at[i]] == a[i]]
    return i, at[i]


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both hold, piece by piece, stitched at the borders."""
    x, y = crossings(a, b, piece)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x0, y0, x1, y1 in zip(x[:-1], y[:-1], x[1:], y[1:]):
        i, j = overlaps(a[x0:x1], b[y0:y1])
        found_a.append(i + x0)
        found_b.append(j + y0)
        if x1 and y1 < len(b) and a[x1 - 1] == b[y1]:  # the border parts two tokens that end together
            found_a.append(np.array([x1 - 1]))
            found_b.append(np.array([y1]))
    return np.concatenate(found_a), np.concatenate(found_b)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = {c: bytes([i]) for i, c in byte_letters().items()}
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = b"".join(letters.get(c, c.encode()) for c in name)
        counter = piece_counter(b_path)
        self.b, self.by_chunk = counter.library, counter.by_chunk
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.b.vocab_size())
        ]
        self.a_size, self.b_size = (np.array([len(x) for x in spelling], np.int64) for spelling in (self.a_bytes, self.b_bytes))
        self.text = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.kept = Kept(None, KEPT)

    def spells(self, wanted: list[bytes], ids: list[list[int]], spelling: list[bytes]) -> list[bool]:
        """Whether the tokens of each segment spell it; one comparison where all do."""
        if b"".join([spelling[i] for part in ids for i in part]) == b"".join(wanted) and all(sum([len(spelling[i]) for i in part]) == len(w) for part, w in zip(ids, wanted)):
            return [True] * len(wanted)
        return [b"".join([spelling[i] for i in part]) == w for part, w in zip(ids, wanted)]

    def segments(self, texts: list[str], whole: bool = False) -> list[tuple[int, int, str, bytes] | None]:
        """Of each segment: tokens of A and of B, groups, codes of its links; None if its tokens do not spell it. A segment
        follows a space unless it starts with a line feed; a ``whole`` text always follows one."""
        inner = [not whole and t[0] == "\n" for t in texts]
        ids_a = [e.ids for e in self.a.encode_batch_fast([t if i else " " + t for t, i in zip(texts, inner)], add_special_tokens=False)]
        ids_b = [ids[1:] if i else ids for ids, i in zip(self.b.encode(texts, num_threads=1), inner)]
        wanted = [(t if i else " " + t).encode() for t, i in zip(texts, inner)]
        good = [x and y for x, y in zip(self.spells(wanted, ids_a, self.a_bytes), self.spells(wanted, ids_b, self.b_bytes))]
        flat = [np.fromiter((i for part, ok in zip(ids, good) if ok for i in part), np.int64) for ids in (ids_a, ids_b)]
        i, j = common_ends(np.cumsum(self.a_size[flat[0]]), np.cumsum(self.b_size[flat[1]]))
        codes = (flat[0][i] << 32 | flat[1][j]).tobytes()
        i, j, out, at, from_a, from_b, text = (i + 1).tolist(), (j + 1).tolist(), [], 0, 0, 0, self.text
        for a, b, ok in zip(ids_a, ids_b, good):
            if not ok:
                out.append(None)
                continue
            groups, p, q, first, n_a, n_b = [], 0, 0, at, len(a), len(b)
            while p < n_a:  # a segment's last tokens end together, so its groups are whole
                p1, q1 = i[at] - from_a, j[at] - from_b
                left = text[a[p]] if p1 == p + 1 else ",".join([text[k] for k in a[p:p1]])
                right = text[b[q]] if q1 == q + 1 else ",".join([text[k] for k in b[q:q1]])
                groups.append(f"{left}|{right}")
                p, q, at = p1, q1, at + 1
            from_a, from_b = from_a + n_a, from_b + n_b
            out.append((n_a, n_b, ";".join(groups), codes[8 * first : 8 * at]))
        return out

    def align(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray]]:
        """Of each text: tokens of A and of B, groups, codes (A id << 32 | B id) of its links."""
        out = [(0, 0, "", np.zeros(0, np.int64))] * len(texts)
        cut = [i for i, t in enumerate(texts) if t and self.by_chunk and not UNCUT.search(t)]
        if cut:
            marked = [t.replace("\n", " \n") if "\n" in t and not BLANKS.search(t) else t for t in map(texts.__getitem__, cut)]
            lists = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
            chunks = lists.flatten().dictionary_encode()
            names, which = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
            new = [c for c in names if c not in self.kept and c not in self.kept.old]
            self.kept.update(zip(new, self.segments(new)))
            entries = [self.kept[c] or (-1 << 60, 0, "", b"") for c in names]
            self.kept.trim()
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            n_a, n_b = (np.add.reduceat(np.array([e[k] for e in entries])[which], ends[:-1]).tolist() for k in (0, 1))
            groups, codes, which, ends = [e[2] for e in entries], [e[3] for e in entries], which.tolist(), ends.tolist()
            for i, x, y, start, end in zip(cut, n_a, n_b, ends[:-1], ends[1:]):
                if x > 0:
                    parts = which[start:end]
                    out[i] = (x, y, ";".join([groups[k] for k in parts]), np.frombuffer(b"".join([codes[k] for k in parts]), np.int64))
        done = set(cut)
        for i, t in enumerate(texts):
            if t and i not in done and (alone := self.segments([t], whole=True)[0]):
                out[i] = (*alone[:3], np.frombuffer(alone[3], np.int64))
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    made = aligner(a_path, b_path)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    for batch in batches:
        for part in slices(batch, 1, 4 << 20):
            got = made.align(part.column(1).to_pylist())
            pairs = [np.unique(g[3], return_counts=True) for g in got]
            ends = np.cumsum([0, *(len(p) for p, _ in pairs)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p[k] for p in pairs]).astype(np.int64))) for k in (0, 1)]
            links = [len(g[3]) for g in got]
            columns = [part.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)), pa.array([g[2].count("|") for g in got], pa.int64()), pa.array(links, pa.int64())]
            digests = pa.array([hashlib.sha256(g[2].encode()).hexdigest() if g[2] else "" for g in got], pa.string())
            groups = [pa.array([g[2] for g in got], pa.string())] if with_groups else []
            yield pa.RecordBatch.from_arrays([*columns, digests, *lists, *groups], names + ["groups"] * with_groups)


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, the id pairs of its links (A id << 32 | B id) with
    how often it holds each, and if wanted the groups themselves (``a1,a2|b1;a3|b2``)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    work = partial(_aligned, a_path=a_path, b_path=b_path, with_groups=with_groups)
    return rows.mapInArrow(work, ALIGNED + ", groups string" * with_groups)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links of all texts that hold it) and best (n is the largest of its B id)."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _looked_up(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    pair, n, best = known.value
    for batch in batches:
        pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
        at = np.searchsorted(pair, pairs.flatten().to_numpy())
        ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
        sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (times * best[at], times * n[at])]
        kept = [batch.column(c) for c in batch.schema.names[:6]]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.diff(s)) for s in sums)], [*batch.schema.names[:6], "n_best", "count_sum"])


def with_counts(aligned: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """``aligned`` (a written table, for it is read three times) with n_best and count_sum of every row."""
    spark = aligned.sparkSession
    counts = saved(pair_counts(aligned), "pairs")
    first = [f.name for f in aligned.schema.fields[:6]]
    if counts.count() <= most:
        rows = counts.toPandas().sort_values("pair")
        known = spark.sparkContext.broadcast((rows.pair.to_numpy(np.int64), rows.n.to_numpy(np.int64), rows.best.to_numpy(np.int64)))
        schema = ", ".join(f"{c} {t}" for c, t in aligned.dtypes[:6])
        return aligned.select(*first, "pairs", "times").mapInArrow(partial(_looked_up, known=known), f"{schema}, n_best long, count_sum long")
    rows = with_row_id(aligned)
    links = rows.select("file_no", "row_no", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("file_no", "row_no", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    held = links.join(counts, "pair").groupBy("file_no", "row_no").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.join(held, ["file_no", "row_no"], "left").select(*first, *zero)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = with_counts(saved(aligned, "aligned"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
