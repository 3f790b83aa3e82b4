"""Vectorised word splitting over Arrow text columns.

A word is a maximal run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``);
UTF-8 continuation bytes are never white space, so bytes and code points agree.
Everything works on chunks of bounded size: one chunk holds a few megabytes of
text, or a single document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 2 << 20
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the offsets of each text; null counts as empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = raw_text(batch.column(text))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a chunk, in order.  ``first[d] : first[d + 1]`` are those of text ``d``."""

    n_docs: int
    flat: np.ndarray  # bytes of all words, white space left out
    off: np.ndarray  # offsets of the words in flat
    doc: np.ndarray  # text index of each word
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def array(self) -> pa.Array:
        off = pa.py_buffer(self.off.astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(self), [None, off, pa.py_buffer(self.flat)])

    def encode(self) -> tuple[np.ndarray, list[bytes]]:
        """Index of each word in the list of distinct words, and that list."""
        if not len(self):
            return np.zeros(0, np.int64), []
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends there."""
        lens = np.diff(self.off)
        begin = self.off[:-1] + np.arange(len(self))
        out = np.full(len(self.flat) + len(self), 32, np.uint8)
        keep = np.ones(len(out), bool)
        keep[begin + lens] = False
        out[keep] = self.flat
        return out.tobytes(), begin, begin + lens


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """Words of each text of a column; ``lower`` turns A-Z into a-z first."""
    raw, off = raw_text(column)
    n = len(off) - 1
    if not len(raw):
        return Words(n, raw, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    opens = np.zeros(len(raw) + 1, bool)  # a text begins here, or the end
    opens[off] = True
    black = ~white
    before = np.concatenate(([True], white[:-1]))
    after = np.concatenate((white[1:], [True]))
    begin = np.flatnonzero(black & (before | opens[:-1]))
    end = np.flatnonzero(black & (after | opens[1:])) + 1
    doc = np.searchsorted(off, begin, side="right") - 1
    flat = raw[black]
    if lower:
        flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
    return Words(n, flat, np.concatenate(([0], np.cumsum(end - begin))), doc, first)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each distinct word: an (n, 2) array."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), "<u8").reshape(-1, 2)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * MIX_A
    h = (h ^ (h >> np.uint64(33))) * MIX_B
    return h ^ (h >> np.uint64(33))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
