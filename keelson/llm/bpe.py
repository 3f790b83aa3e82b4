"""BPE encoding by an index of pair occurrences, and decoding.

The normaliser and the pre-tokeniser of a vocabulary cut a text into pieces; what this
module does is to merge inside them.  The distinct pieces of a part of a partition that
no earlier part had are laid end to end as byte symbols, linked to their neighbours, and
every pair that a merge names is mapped to all its positions.  The active ranks are then
applied in ascending order: all occurrences of a rank from left to right, each of which
ends the pairs on either side and enters the two new ones under their ranks.  A merge's
parts come from merges of lower rank (checked when a vocabulary is loaded), so a rank
once applied never becomes active again.

White space never joins tokens, so a word's ids are remembered and texts are put
together from their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .pieces import Cutter, byte_names
from .textops import chunks, split_words

MEMO_WORDS, MEMO_IDS = 300_000, 8_000_000  # what a task remembers; more is encoded again
AT_ONCE = 1 << 20  # bytes of pieces indexed together, or one piece
TOKENS = 1 << 19  # decoded together, or one row's
IDS = "doc_id long, ids array<int>"


class Merges:
    """The merges of a vocabulary, applied through an index of pair occurrences."""

    def __init__(self, model: dict):
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-pair vocabulary")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        names = byte_names()
        if missing := [n for n in names if n not in vocab or n + end not in vocab]:
            raise ValueError(f"no token for byte symbols {missing[:3]}")
        self._first = np.array([vocab[n] for n in names])
        self._last = np.array([vocab[n + end] for n in names])
        self._size = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made: dict[int, int] = {}
        self._rank: dict[int, int] = {}
        for r, (a, b, new) in enumerate(self._parts):
            if new in made:
                raise ValueError("two merges make one token")
            self._rank.setdefault(a * self._size + b, r)
            made[new] = r
        if any(made.get(x, -1) >= r for r, (a, b, _) in enumerate(self._parts) for x in (a, b)):
            raise ValueError("a merge comes before its parts")
        known = np.array(sorted(self._rank.items()), np.int64).reshape(-1, 2)
        self._keys, self._ranks = known[:, 0], known[:, 1]

    def apply(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(sizes + 1)  # a bound before each piece, and one after all
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        place = np.arange(len(flat)) + np.repeat(np.arange(1, len(pieces) + 1), sizes)
        start = np.full(int(end[-1]) + 1, -1, np.int64)
        start[place] = self._first[flat]
        last = end[sizes > 0] - 1
        start[last] = self._last[flat[np.searchsorted(place, last)]]
        key = np.where((start[:-1] >= 0) & (start[1:] >= 0), start[:-1] * self._size + start[1:], -1)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1) if len(self._keys) else np.zeros(len(key), np.int64)
        found = np.flatnonzero(self._keys[at] == key) if len(self._keys) else np.zeros(0, np.int64)
        rank = self._ranks[at[found]] if len(found) else found
        order = np.argsort(rank, kind="stable")
        active, cut = np.unique(rank[order], return_index=True)
        where = {r: x.tolist() for r, x in zip(active.tolist(), np.split(found[order], cut[1:]), strict=True)} if len(active) else {}
        symbol = np.array(self._merge(start.tolist(), where), np.int64)
        alive = symbol >= 0
        owner = np.repeat(np.arange(len(pieces)), sizes)
        return symbol[alive], np.bincount(owner[alive[place]], minlength=len(pieces))

    def _merge(self, symbol: list[int], where: dict[int, list[int]]) -> list[int]:
        """Apply the active ranks in ascending order; a symbol that is merged into the one before becomes negative."""
        after = list(range(1, len(symbol) + 1))
        before = list(range(-1, len(symbol) - 1))
        size, rank, parts = self._size, self._rank, self._parts
        active = list(where)
        heapify(active)
        while active:
            r = heappop(active)
            a, b, new = parts[r]
            for p in sorted(where.pop(r)):
                if symbol[p] != a:
                    continue
                q = after[p]
                if symbol[q] != b:
                    continue
                symbol[p], symbol[q] = new, -2
                right, left = after[q], before[p]
                after[p] = right
                before[right] = p
                for x, y, own in ((symbol[left], new, left), (new, symbol[right], p)):
                    if x >= 0 <= y and (s := rank.get(x * size + y)) is not None:
                        if s in where:
                            where[s].append(own)
                        else:
                            where[s] = [own]
                            heappush(active, s)
        return symbol


class _Encoder:
    """Ids of distinct words, remembered by word."""

    def __init__(self, path: str):
        self._cutter = Cutter(path)
        self._merges = Merges(self._cutter.model)
        self._clear()

    def _clear(self) -> None:
        self._word: dict[bytes, int] = {}
        self._piece: dict[bytes, list[int]] = {}
        self._pool, self._begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words, and where each number's ids begin and what they are, end to end."""
        new = [w for w in words if w not in self._word]
        if len(self._word) + len(new) > MEMO_WORDS or len(self._pool) > MEMO_IDS:
            self._clear()
            new = words
        if new:
            cut = self._cutter.cut(new)
            self._learn({p for pieces in cut for p in pieces if isinstance(p, bytes)} - self._piece.keys())
            ids, sizes = [], []
            for pieces in cut:
                n = len(ids)
                for p in pieces:
                    if isinstance(p, bytes):
                        ids += self._piece[p]
                    else:
                        ids.append(p)
                sizes.append(len(ids) - n)
            base = len(self._word)
            self._word.update(zip(new, range(base, base + len(new)), strict=True))
            self._pool = np.concatenate((self._pool, np.array(ids, np.int32)))
            self._begin = np.concatenate((self._begin, self._begin[-1] + np.cumsum(sizes)))
        return np.array([self._word[w] for w in words], np.int64), self._begin, self._pool

    def _learn(self, pieces: set[bytes]) -> None:
        some: list[bytes] = []
        size = 0
        for p in [*sorted(pieces), None]:
            if some and (p is None or size + len(p) > AT_ONCE):
                ids, n = self._merges.apply(some)
                ends = np.cumsum(n).tolist()
                flat = ids.tolist()
                self._piece.update({x: flat[a:b] for x, a, b in zip(some, [0, *ends[:-1]], ends, strict=True)})
                some, size = [], 0
            if p is not None:
                some.append(p)
                size += len(p)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _Encoder(path)
    for part in chunks(batches, "text"):
        words = split_words(part.column("text"))
        index, distinct = words.encode()
        number, begin, pool = encoder.table(distinct)
        own = number[index] if len(index) else index
        size = begin[own + 1] - begin[own]
        upto = np.append(0, np.cumsum(size))
        ids = pool[np.arange(upto[-1]) + np.repeat(begin[own] - upto[:-1], size)]
        lists = pa.ListArray.from_arrays(pa.array(upto[words.first].astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every text.

    ``path`` is a byte-pair vocabulary of the ``tokenizers`` library whose normaliser or
    pre-tokeniser drops white space.  Special strings inside a text become their special
    token, the library's default; nothing is added, cut or padded.  Null and empty texts
    have no ids; very long texts and words are encoded whole, with memory in proportion
    to the longest; repeated rows are each returned; null doc_ids stay; an empty table
    gives no rows; other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(partial(_encode, path=path), IDS)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    cutter = Cutter(path)
    names, decoder = pa.array(cutter.tokens, pa.string()), cutter.decoder
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy()[at:])
            some = batch.slice(at, max(1, int(np.searchsorted(upto, TOKENS, side="right"))))
            at += some.num_rows
            lists = some.column("ids")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            known = (flat >= 0) & (flat < len(names))
            token = names.take(pa.array(np.where(known, flat, 0).astype(np.int64)))
            known &= ~token.is_null().to_numpy(zero_copy_only=False)  # numbers without a token are left out
            owner = np.repeat(np.arange(len(n)), n)[known]
            off = np.append(0, np.cumsum(np.bincount(owner, minlength=len(n)))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(off), token.filter(pa.array(known)))
            text = pc.binary_join(tokens, " ") if decoder is None else pa.array([decoder.decode(x) for x in tokens.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(c for name, c in zip(some.schema.names, some.columns, strict=True) if name != "text"), text], [*(x for x in some.schema.names if x != "text"), "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text``, the decoded ``ids``, in place of a column of that name.

    Special tokens stay, and numbers without a token are left out.  A vocabulary without
    a decoder gives its tokens with a space between.  Null or no ids give an empty text.
    """
    kept = [f for f in encoded.schema.fields if f.name != "text"]
    return encoded.mapInArrow(partial(_decode, path=path), StructType([*kept, StructField("text", StringType())]))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast(LongType()).alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
