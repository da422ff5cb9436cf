"""Sorted-string-table files: documents by key in prefix-compressed blocks, sparse index, Bloom filter, footer.

Layout of a file (integers little-endian)::

    block*   zstd frame of entries: shared u8, rest u8, value length u32, rest of the key, value
    index    zstd frame, per block: key length u8, first key, offset u64, length u32, documents u32, ids u64
    bloom    probes u32, bits
    footer   index offset u64, length u32, bloom offset u64, length u32, documents u64, ids u64, id width u8, magic

Keys compare as bytes in the order of the identifiers (null first). A value holds the ids.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyarrow import fs

MAGIC = b"CWSST001"
FOOTER = struct.Struct("<QIQIQQB7x8s")
ENTRY, PLACE = struct.Struct("<BBI"), struct.Struct("<QIIQ")
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def bloom_bits(keys: list[bytes], n_bits: int) -> np.ndarray:
    """Bit numbers of every key, by double hashing."""
    h = np.array([xxhash.xxh3_128_intdigest(k) & ((1 << 128) - 1) for k in keys], object)
    a = np.array([x & 0xFFFFFFFFFFFFFFFF for x in h], np.uint64)
    b = np.array([x >> 64 for x in h], np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(n_bits)


def opened(uri: str):
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Takes (doc_id, ids) in key order; the file appears under its name only when it is complete."""

    def __init__(self, uri: str, width: int, block_bytes: int = 1 << 16):
        self.system, self.path = opened(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.part)
        self.width, self.block_bytes, self.press = width, block_bytes, zstandard.ZstdCompressor(level=1)
        self.block, self.size, self.last = [], 0, b""
        self.index, self.keys, self.n_ids, self.at = [], [], 0, 0
        self._open_block()

    def _open_block(self) -> None:
        self.block, self.size, self.last, self.first, self.docs, self.ids = [], 0, b"", None, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.astype(f"<u{self.width}").tobytes()
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        self.block += [ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        self.first = key if self.first is None else self.first
        self.last, self.size, self.docs, self.ids = key, self.size + len(value) + 16, self.docs + 1, self.ids + len(ids)
        self.keys.append(key)
        if self.size >= self.block_bytes:
            self._close_block()

    def _write(self, data: bytes) -> tuple[int, int]:
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at, len(data)

    def _close_block(self) -> None:
        if self.docs:
            at, length = self._write(self.press.compress(b"".join(self.block)))
            self.index.append(bytes([len(self.first)]) + self.first + PLACE.pack(at, length, self.docs, self.ids))
            self.n_ids += self.ids
        self._open_block()

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        self._close_block()
        index = self._write(self.press.compress(b"".join(self.index)))
        n_bits = max(64, BITS_PER_KEY * len(self.keys))
        bits = np.zeros(n_bits, np.uint8)
        if self.keys:
            bits[bloom_bits(self.keys, n_bits).ravel()] = 1
        bloom = self._write(struct.pack("<IQ", PROBES, n_bits) + np.packbits(bits).tobytes())
        self._write(FOOTER.pack(*index, *bloom, len(self.keys), self.n_ids, self.width, MAGIC))
        self.out.close()
        self.system.move(self.part, self.path)
        return len(self.keys), self.n_ids


class Reader:
    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        end = self.file.size()
        *where, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a table: {uri}")
        self.unpress, self.where = zstandard.ZstdDecompressor(), where
        self.firsts, self.places = [], []
        raw, at = self.unpress.decompress(self._read(*where[:2])), 0
        while at < len(raw):
            n = raw[at]
            self.firsts.append(raw[at + 1 : at + 1 + n])
            self.places.append(PLACE.unpack_from(raw, at + 1 + n))
            at += 1 + n + PLACE.size
        self.bloom = None

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, place) -> Iterator[tuple[int | None, np.ndarray]]:
        raw, at, key = self.unpress.decompress(self._read(*place[:2])), 0, b""
        while at < len(raw):
            shared, rest, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield id_of(key), np.frombuffer(raw, f"<u{self.width}", n // self.width, at)
            at += n

    def __iter__(self):
        for place in self.places:
            yield from self._block(place)

    def may_have(self, doc_id: int | None) -> bool:
        if self.bloom is None:
            raw = self._read(*self.where[2:])
            self.n_bits = struct.unpack_from("<IQ", raw)[1]
            self.bloom = np.unpackbits(np.frombuffer(raw, np.uint8, offset=12))
        return bool(self.bloom[bloom_bits([key_of(doc_id)], self.n_bits)[0]].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier: Bloom filter, binary search of the index, then a block or more."""
        if not self.firsts or not self.may_have(doc_id):
            return []
        key = key_of(doc_id)
        k, found = max(0, bisect.bisect_left(self.firsts, key) - 1), []
        while k < len(self.firsts) and self.firsts[k] <= key:
            found += [ids for x, ids in self._block(self.places[k]) if x == doc_id]
            k += 1
        return found
