"""Operator 10, token counts with a whole-token shortcut.

The piece vocabulary merges by score and no piece holds a word-start mark after another character,
so a text's tokens are those of its space-started chunks one after another; a line feed is in no
piece, so it is one token and merges never cross it. Both facts, and which vocabulary strings
encode alone as one token, are proved once per worker against the vocabulary itself. Pre-tokens
among those strings count one; only the rest go to the library's merges, each distinct one once.

Defined results: null and empty texts have no tokens; texts with runs of spaces, spaces at an end
or the mark itself are counted whole by the library; repeated rows repeat; an empty table gives no
rows; other columns are ignored. No shuffle: every batch of a scan task is counted on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_bytes, ship, slices, table, text_of
from .word_encoder import Kept

MARK = "▁"


class PieceCounter:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        lib = self.library
        pieces = {i: lib.id_to_piece(i) for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        #: Proof that chunks are independent: a mark only starts a piece, a line feed is in none.
        self.by_chunk = all(MARK not in p.lstrip(MARK) and "\n" not in p for p in pieces.values())
        started = [p[1:] for p in pieces.values() if p[0] == MARK and MARK not in p[1:] and len(p) > 1 and " " not in p]
        inner = [p for p in pieces.values() if MARK not in p and " " not in p]
        #: Proof that a string encodes alone as one token, at a word's start or after a line feed.
        self.whole = {p for p, ids in zip(started, lib.encode(started)) if len(ids) == 1}
        self.whole_inner = {p for p, ids in zip(inner, lib.encode(["\n" + p for p in inner])) if len(ids) == 3}
        self.kept = Kept(self._count)

    def _count(self, chunk: str) -> int:
        """Tokens of a space-started chunk, split at its line feeds."""
        first, *rest = chunk.split("\n")
        n = (first in self.whole or len(self.library.encode(first))) if first else 1
        for part in rest:
            n += 1 + (not part or part in self.whole_inner or len(self.library.encode("\n" + part)) - 2) - (not part)
        return n

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        easy = [i for i, t in enumerate(texts) if t and self.by_chunk and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t]
        if easy:
            lists = pc.split_pattern(pa.array([texts[i] for i in easy], pa.large_string()), " ")
            chunks = lists.flatten().dictionary_encode()
            known = np.fromiter(map(self.kept.__getitem__, chunks.dictionary.to_pylist()), np.int64)
            self.kept.trim()
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            out[easy] = np.add.reduceat(known[chunks.indices.to_numpy()], starts)
        done = set(easy)
        for i in range(len(texts)):
            if i not in done and texts[i]:
                out[i] = len(self.library.encode(texts[i]))
        return out


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    counter = piece_counter(vocabulary)
    for batch in batches:
        for part in slices(batch, 2):
            n = counter.count(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", n_bytes(text_of()).alias("n_bytes"), text_of().alias("text"))
    counted = rows.mapInArrow(partial(_counted, vocabulary=vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _counted_rows(batches: Iterator[pa.RecordBatch], vocabulary: str, text: int) -> Iterator[pa.RecordBatch]:
    counter = piece_counter(vocabulary)
    for batch in batches:
        for part in slices(batch, text):
            n = counter.count(pc.fill_null(part.column(text), "").to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n)], [*part.schema.names, "n_tokens"])


def with_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` (none of whose columns is n_tokens) with the number of tokens of every text."""
    ship(docs.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(partial(_counted_rows, vocabulary=vocabulary, text=docs.columns.index("text")), f"{schema}, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
