"""Exact, cached encoding with a word-end byte-pair vocabulary of the tokenizers library.

The vocabulary drops white space and merges inside pre-tokens only, so the ids of a text are
the ids of its white-space chunks one after another. Each worker keeps the ids of chunks and
pre-tokens it has met and asks the library only for new ones. Texts outside the plain range
(where lower-casing, composition or the meaning of white space could depend on context)
are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Blank, printable ASCII, Latin letters without U+0130, general punctuation.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ɏ‐-‧]*")
#: The pre-token pattern of the vocabulary file, for plain lower-case texts.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")
KEPT = 400_000


class Kept(dict):
    """A cache of two generations: a missing key comes from the old one or is made; trim() ages the young one."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: printable bytes stay, the rest go to 256 and up."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = (b for b in range(256) if b not in set(stay))
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(moved)}


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.wide = self.library.get_vocab_size() > 0xFFFF
        self.dtype, self.code = ("<u4", "I") if self.wide else ("<u2", "H")
        self.letters = {chr(b): x for b, x in byte_letters().items()}
        self.merge = self.library.model.tokenize
        self.tokens = Kept(self._token)
        self.chunks = Kept(self._chunk)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _bytes(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token, from the library's merge model."""
        shown = token if token.isascii() else "".join(map(self.letters.__getitem__, token.encode().decode("latin-1")))
        return self._bytes([t.id for t in self.merge(shown)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._token(chunk)
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return self.tokens[chunk[:-1]] + self.tokens[chunk[-1]]
        return b"".join(map(self.tokens.__getitem__, PRETOKEN.findall(chunk)))

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every whole text. Chunks are split and told apart in columns; each distinct one is encoded once."""
        plain = [self.plain(t) for t in texts]
        lowered = pc.utf8_lower(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string()))
        lists = pc.utf8_split_whitespace(lowered)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
        words = lists.flatten().dictionary_encode()
        known = [self.chunks[w] if w else b"" for w in words.dictionary.to_pylist()]
        self.chunks.trim()
        self.tokens.trim()
        size = np.fromiter(map(len, known), np.int64, len(known)) // np.dtype(self.dtype).itemsize
        first = np.cumsum(size) - size
        ids, which = np.frombuffer(b"".join(known), self.dtype), words.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[bounds]
        fast = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        slow = lambda t: np.array(self.library.encode(t, add_special_tokens=False).ids, self.dtype)
        return [next(fast) if p else slow(t) for t, p in zip(texts, plain)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
