"""Katz scores of the corpus that the model learns from.

:func:`learn_and_score` gives what :func:`katz.train` and :func:`katz.score` give together,
from one exchange of the tokens instead of one for the counts and more for the look-ups.

1. Words are counted, and each task names the pairs of words that are frequent in its
   share.  Words with a class (see ``katz``) and named pairs, both bounded in number,
   travel with the tasks from here on.
2. Every other token is dealt out with its text's identity: by its pair, if both words
   have a class; by its history, if that has none; and by itself, if it has none (so
   where both have none, twice).  Whoever gets a bucket has all tokens of a word without
   a class, and knows its count, its pairs and their counts.  Each text gets back the sum
   of what its tokens there contribute, with tallies by count in place of the discounts,
   which nobody knows yet.
3. With the discounts and the backoff weights of classes, which are sums over buckets, a
   last pass adds what classes and named pairs contribute; backoff weights of other
   histories are joined by key where a token that training hasn't shown asks for them.

Buckets are ranges of hashed keys; what a task sends to one is a compressed block of
columns, so the exchange takes a few bytes a token.  No key is hot: a word without a
class has under ``katz.CLASS_SHARE`` of the tokens, a pair that isn't named under
``HOT_SHARE``.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import katz
from .katz import END, END_KEY, GT_ORDER, Lists, Unigrams, _found, _names, _tokens
from .scratch import drop, stored
from .textops import chunks, mixed, signed

HOT_SHARE = 1e-5
BUCKET_TOKENS = 3_000_000
HELD_TOKENS = 1_000_000  # that a task deals out together
PIECES = 8  # of a bucket, by key, worked on one after the other
SECTIONS = 5  # pairs of classes; history without a class, then next one with, without; next without a class, then history with, without
DOC, UNSEEN_CLASS, UNSEEN_KEY, CLASS, HISTORY, LOWER, COUNTS, NAMED, CLOSED = range(9)  # what a row of the reduced table says
FOUND = "what int, r int, a long, b long, k long, n long, x double, m array<long>, block binary"


def pack(arrays: list[np.ndarray]) -> bytes:
    """Columns of eight-byte numbers as one compressed block; bytes that are zero all along cost nothing."""
    import zstandard

    head, body = [struct.pack("<I", len(arrays))], []
    for x in arrays:
        planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8).T
        used = [k for k in range(8) if planes[k].any()]
        head.append(struct.pack("<QB", len(x), sum(1 << k for k in used)))
        body.append(planes[used].tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(block: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    (many,) = struct.unpack_from("<I", raw)
    at, out = 4 + 9 * many, []
    for k in range(many):
        n, used = struct.unpack_from("<QB", raw, 4 + 9 * k)
        x = np.zeros((n, 8), np.uint8)
        for j in range(8):
            if used >> j & 1:
                x[:, j] = np.frombuffer(raw, np.uint8, n, at)
                at += n
        out.append(x.view(np.uint64).ravel())
    return out


def _rises(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers; np.cumsum undoes it."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


def _pair_hash(hist: np.ndarray, next_: np.ndarray) -> np.ndarray:
    return signed(mixed(hist.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + next_.view(np.uint64)))


def _words_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0), and of the pairs that have half of ``HOT_SHARE`` of a task's tokens (kind 1)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        names = np.concatenate([keys[index] for keys, index in held])
        held.clear()
        word, n = np.unique(names, return_counts=True)
        pair, often = np.unique(_pair_hash(np.concatenate(([END_KEY], names[:-1])), names), return_counts=True)  # chunks end with the end
        keep = often >= max(1, HOT_SHARE / 2 * len(names))
        kind = np.repeat([0, 1], [len(word), keep.sum()]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((word, pair[keep]))), pa.array(np.concatenate((n, often[keep])))], ["kind", "key", "c"])

    for part in chunks(batches, "text"):
        words, index, keys = _tokens(part)
        own = np.full(len(words) + words.n_docs, len(keys))
        own[np.arange(len(words)) + words.doc] = index
        held.append((np.append(keys, END_KEY), own))
        size += len(own)
        if size > HELD_TOKENS:
            yield out()
            size = 0
    if size:
        yield out()


class _Classes:
    """What travels with the tasks: classes with their counts and probabilities, and named pairs."""

    def __init__(self, uni: Unigrams, keys: np.ndarray, counts: np.ndarray, named: np.ndarray):
        own = keys != END_KEY
        self.uni, self.named = uni, named
        self.lists = Lists(uni, keys, counts, keys[own])
        self.n = self.lists.n_classes
        self.c = np.zeros(self.n, np.int64)
        self.c[2:] = counts[own]
        self.c[END] = counts[~own].sum()
        self.log_p = uni.log10_p(self.c)
        self.keys = np.concatenate(([END_KEY, 0], keys[own]))
        self.bits = max(1, int(self.n * self.n).bit_length())

    def scrambled(self, code: np.ndarray) -> np.ndarray:
        """A bijection of pairs of classes that spreads them evenly."""
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << self.bits) - 1)

    def unscrambled(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))) & np.uint64((1 << self.bits) - 1)

    def tokens(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """History, word and text of each token of a chunk, ends included."""
        words, index, keys = _tokens(part)
        names = _names(words, index, keys, self.lists)
        return np.concatenate(([END], names[:-1])), names, np.repeat(np.arange(part.num_rows), words.per_doc + 1)

    def known(self, names: np.ndarray) -> np.ndarray:
        return (names >= 0) & (names < self.n)

    def find_named(self, hist: np.ndarray, next_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each pair of classes among the named pairs, and whether it is one."""
        return _found(self.named, _pair_hash(self.keys[hist], self.keys[next_]))


def _dealt(batches: Iterator[pa.RecordBatch], classes: _Classes, buckets: int) -> Iterator[pa.RecordBatch]:
    """``(bucket, block)``: the tokens of some millions at a time, by bucket."""
    held: list[tuple] = []
    size = turn = 0

    def out() -> pa.RecordBatch:
        first = np.cumsum([0, *(len(h[3]) for h in held)])
        hist, next_ = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        doc = np.concatenate([h[2] + f for h, f in zip(held, first, strict=False)])
        doc = doc.astype(np.int32)
        a, b, train = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
        held.clear()
        hc, wc = classes.known(hist), classes.known(next_)
        pairs = np.flatnonzero(hc & wc)
        number, named = classes.find_named(hist[pairs], next_[pairs])
        seen = named & train[doc[pairs]]
        name, at, n = np.unique(number[seen], return_index=True, return_counts=True)
        spot = pairs[seen][at]
        special = [name, n, hist[spot], next_[spot]]
        pairs = pairs[~named]
        picks = [pairs, *(np.flatnonzero(x) for x in (~hc & wc, ~hc & ~wc, hc & ~wc, ~hc & ~wc))]
        keys = [classes.scrambled(hist[pairs] * classes.n + next_[pairs])]
        keys += [hist[p].view(np.uint64) for p in picks[1:3]] + [next_[p].view(np.uint64) for p in picks[3:]]
        others = [np.zeros(0, np.int64)] + [next_[p] for p in picks[1:3]] + [hist[p] for p in picks[3:]]
        cuts = []
        for k in range(SECTIONS):
            order = np.argsort(keys[k], kind="stable")
            keys[k], picks[k] = keys[k][order], doc[picks[k]][order]
            others[k] = others[k][order] if k else others[k]
            bits = classes.bits if k == 0 else 64
            top = keys[k] >> np.uint64(max(0, bits - 32))
            cuts.append(np.searchsorted((top * np.uint64(buckets)) >> np.uint64(min(32, bits)), np.arange(buckets + 1)))
        rows, blocks = [], []
        for j in range(buckets):
            spans = [slice(c[j], c[j + 1]) for c in cuts]
            docs, inverse = np.unique(np.concatenate([p[s] for p, s in zip(picks, spans, strict=True)]), return_inverse=True)
            mine = j == turn % buckets and len(name)
            if not len(docs) and not mine:
                continue
            local = np.split(inverse, np.cumsum([s.stop - s.start for s in spans])[:-1])
            columns = [a[docs], b[docs], train[docs].astype(np.int64)]
            for k, s in enumerate(spans):
                columns += [_rises(keys[k][s]), others[k][s] if k else others[k], local[k]]
            rows.append(j)
            blocks.append(pack([*columns, *(special if mine else [np.zeros(0, np.int64)] * 4)]))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    for part in chunks(batches, "text"):
        a, b = (part.column(c).to_numpy() for c in ("_a", "_b"))
        held.append((*classes.tokens(part), a, b, ~part.column("_held").to_numpy(zero_copy_only=False)))
        size += len(held[-1][0])
        if size > HELD_TOKENS:
            yield out()
            size, turn = 0, turn + 1
    if size:
        yield out()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _grown(begin: np.ndarray, size: int) -> np.ndarray:
    """Number of the run that each row belongs to."""
    return np.repeat(np.arange(len(begin)), np.diff(np.append(begin, size)))


def _row_batch(what: int, size: int, **columns) -> pa.RecordBatch:
    types = {"what": pa.int32(), "r": pa.int32(), "a": pa.int64(), "b": pa.int64(), "k": pa.int64(), "n": pa.int64(), "x": pa.float64(), "m": pa.list_(pa.int64()), "block": pa.binary()}
    columns["what"] = np.full(size, what, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()], list(types))


class _Bucket:
    """All that one bucket says: see the module's step 2."""

    def __init__(self, classes: _Classes, blocks: list[bytes]):
        self.classes = classes
        parts = [unpack(x) for x in blocks]
        blocks.clear()
        first = np.cumsum([0, *(len(p[0]) for p in parts)])
        joined = lambda k: np.concatenate([p[k] for p in parts])
        self.a, self.b, self.train = signed(joined(0)), signed(joined(1)), joined(2).astype(bool)
        self.named = [signed(joined(3 + 3 * SECTIONS + k)) for k in range(4)]
        self.sections = []
        for k in range(SECTIONS):
            at = 3 + 3 * k
            key = np.concatenate([np.cumsum(p[at], dtype=np.uint64) for p in parts])
            doc = np.concatenate([p[at + 2].astype(np.int32) + np.int32(f) for p, f in zip(parts, first, strict=False)])
            self.sections.append((key, signed(joined(at + 1)), doc))
            for p in parts:
                p[at] = p[at + 1] = p[at + 2] = None
        n = len(self.a)
        self.score, self.base, self.known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        self.tally, self.closed = np.zeros((GT_ORDER, n)), np.zeros((GT_ORDER, n))  # by count; by least count of the history, from 2
        self.shown = np.zeros((GT_ORDER, classes.n), np.int64)  # of each class: pairs by count
        self.low, self.least = np.zeros(classes.n), np.full(classes.n, GT_ORDER + 1)
        self.counts = np.zeros(GT_ORDER + 2, np.int64)
        self.rows: list[pa.RecordBatch] = []
        self.held_seen: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc: np.ndarray, values: np.ndarray) -> None:
        self.score += np.bincount(doc, weights=values, minlength=len(self.a))

    def seen(self, doc: np.ndarray, n: np.ndarray, c: np.ndarray) -> None:
        """Tokens whose pair training has shown ``n`` times, of a history shown ``c`` times."""
        self.add(doc, np.log10(n / c))
        for r in range(1, GT_ORDER + 1):
            self.tally[r - 1] += np.bincount(doc[n == r], minlength=len(self.a))

    def unseen(self, what: int, doc: np.ndarray, hist: np.ndarray) -> None:
        if len(doc):
            self.rows.append(_row_batch(what, len(doc), a=self.a[doc], b=self.b[doc], k=hist))

    def count(self, n: np.ndarray) -> None:
        self.counts += np.bincount(np.minimum(n, GT_ORDER + 1), minlength=GT_ORDER + 2)

    def by_class(self, hist: np.ndarray, n: np.ndarray, p: np.ndarray) -> None:
        """Distinct pairs that training has shown, of histories with a class."""
        for r in range(1, GT_ORDER + 1):
            self.shown[r - 1] += np.bincount(hist[n == r], minlength=self.classes.n)
        self.low += np.bincount(hist, weights=p, minlength=self.classes.n)
        np.minimum.at(self.least, hist, n)
        self.count(n)

    def class_tokens(self, hist: np.ndarray, n: np.ndarray, doc: np.ndarray, log_p: np.ndarray) -> None:
        """Tokens after a class: seen, or unseen with their own probability and the class's backoff weight to come."""
        ok = n > 0
        self.seen(doc[ok], n[ok], self.classes.c[hist[ok]])
        self.add(doc[~ok], log_p[~ok])
        ask = ~ok & (self.classes.c[hist] > 0)
        self.unseen(UNSEEN_CLASS, doc[ask], hist[ask])
        other = ok & ~self.train[doc]
        self.held_seen.append((doc[other], hist[other]))

    def pairs(self, key: np.ndarray, _, doc: np.ndarray) -> None:
        """Tokens after a class that have one themselves."""
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        begin = _runs(key)
        n = np.add.reduceat(self.train[doc].astype(np.int64), begin)
        code = self.classes.unscrambled(key[begin]).astype(np.int64)
        hist, next_ = code // self.classes.n, code % self.classes.n
        ok = n > 0
        self.by_class(hist[ok], n[ok], 10 ** self.classes.log_p[next_[ok]])
        run = _grown(begin, len(key))
        self.class_tokens(hist[run], n[run], doc, self.classes.log_p[next_][run])

    def _sorted(self, key: np.ndarray, other: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((other, key))
        key, other, doc = key[order], other[order], doc[order]
        words, both = _runs(key), _runs(key, other)
        of_train = self.train[doc].astype(np.int64)
        return key, other, doc, words, both, np.add.reduceat(of_train, words), np.add.reduceat(of_train, both)

    def words(self, *rows: np.ndarray) -> None:
        """Tokens without a class, by themselves."""
        key, hist, doc, words, both, c, n = self._sorted(*rows)
        uni = self.classes.uni
        word, run = _grown(words, len(key)), _grown(both, len(key))
        self.base += np.bincount(doc, weights=uni.log10_base(c)[word], minlength=len(self.a))
        self.known += np.bincount(doc, weights=(c > 0)[word], minlength=len(self.a)).astype(np.int64)
        log_p = uni.log10_p(c)
        has_class = self.classes.known(hist)
        at = np.flatnonzero(has_class)
        self.class_tokens(hist[at], n[run[at]], doc[at], log_p[word[at]])
        rest = ~has_class & (n[run] == 0)
        self.add(doc[rest], log_p[word[rest]])
        h, ok = hist[both], (n > 0) & has_class[both]
        self.by_class(h[ok], n[ok], 10 ** log_p[word[both[ok]]])
        ok = (n > 0) & ~has_class[both]
        if ok.any():
            self.rows.append(_row_batch(LOWER, int(ok.sum()), k=h[ok], n=c[word[both[ok]]]))

    def histories(self, *rows: np.ndarray) -> None:
        """Tokens after a history without a class."""
        key, next_, doc, words, both, c, n = self._sorted(*rows)
        hist, run = _grown(words, len(key)), _grown(both, len(key))
        ok = n[run] > 0
        self.seen(doc[ok], n[run[ok]], c[hist[ok]])
        has_class = self.classes.known(next_)
        plain = ~ok & has_class
        self.add(doc[plain], self.classes.log_p[next_[plain]])
        ask = ~ok & (c[hist] > 0)
        self.unseen(UNSEEN_KEY, doc[ask], signed(key[ask]))
        of = hist[both]  # history of each pair
        least = np.full(len(words), GT_ORDER + 1)
        np.minimum.at(least, of[n > 0], n[n > 0])
        for q in range(2, GT_ORDER + 2):
            at = np.flatnonzero(ok & (least[hist] == q))
            self.closed[q - 2] += np.bincount(doc[at], weights=np.log10(c[hist[at]] / (c[hist[at]] + 1)), minlength=len(self.a))
        self.count(n[n > 0])
        wanted = np.zeros(len(words), bool)
        wanted[hist[ask]] = True
        if wanted.any():
            shown = np.stack([np.bincount(of[n == r], minlength=len(words)) for r in range(1, GT_ORDER + 1)], axis=1)
            low = (n > 0) & has_class[both]
            p = np.bincount(of[low], weights=10 ** self.classes.log_p[next_[both[low]]], minlength=len(words))
            self.rows.append(_row_batch(HISTORY, int(wanted.sum()), k=signed(key[words][wanted]), n=c[wanted], x=p[wanted], m=shown[wanted].tolist()))

    def reduced(self, back: int) -> Iterator[pa.RecordBatch]:
        for work, sections in ((self.pairs, [0]), (self.words, [3, 4]), (self.histories, [1, 2])):
            for piece in range(PIECES):
                rows = []
                for k in sections:
                    key, other, doc = self.sections[k]
                    at = np.flatnonzero((key & np.uint64(PIECES - 1)) == piece)
                    rows.append((key[at], other[at] if k else other, doc[at]))
                some = [np.concatenate(x) for x in zip(*rows, strict=True)]
                if len(some[0]):
                    work(*some)
                yield from self.rows
                self.rows = []
            for k in sections:
                self.sections[k] = None
        number, n, hist, next_ = self.named
        if len(number):
            yield _row_batch(NAMED, len(number), k=number, n=n, a=hist, b=next_)
        h = np.flatnonzero(self.low > 0)
        if len(h):
            yield _row_batch(CLASS, len(h), k=h, x=self.low[h], m=self.shown[:, h].T.tolist())
        r = np.flatnonzero(self.counts)
        yield _row_batch(COUNTS, len(r), k=r, n=self.counts[r])
        doc, hist = (np.concatenate(x) for x in zip(*self.held_seen, strict=True)) if self.held_seen else (np.zeros(0, np.int64),) * 2
        maybe = self.least[hist] > 1
        if maybe.any():
            yield _row_batch(CLOSED, int(maybe.sum()), a=self.a[doc[maybe]], b=self.b[doc[maybe]], k=hist[maybe])
        to = ((mixed(self.b.view(np.uint64)) >> np.uint64(32)) * np.uint64(back) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(back + 1))
        some = np.flatnonzero(np.diff(cuts))
        columns = [self.a, self.b, self.known, self.score, self.base, *self.tally, *self.closed]
        blocks = [pack([x[order[cuts[j] : cuts[j + 1]]] for x in columns]) for j in some]
        yield _row_batch(DOC, len(some), r=some, block=blocks)


def _reduce(batches: Iterator[pa.RecordBatch], classes: _Classes, back: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket."""
    bucket, blocks = None, []
    for batch in batches:
        for j, block in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
            if j != bucket and blocks:
                yield from _Bucket(classes, blocks).reduced(back)
                blocks = []
            bucket = j
            blocks.append(block.as_py())
    if blocks:
        yield from _Bucket(classes, blocks).reduced(back)


SUMS = "a long, b long, known long, base double, s double"


def _sum_batch(a, b, known, base, s) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a, b, known, base, s), types, strict=True)], ["a", "b", "known", "base", "s"])


def _returned(batches: Iterator[pa.RecordBatch], d: list[float]) -> Iterator[pa.RecordBatch]:
    """Sums by text, the discounts applied.  Rows arrive sorted by ``r``."""
    order = sum(x < 1 for x in d)

    def out(blocks: list[bytes]) -> pa.RecordBatch:
        a, b, known, *rest = (np.concatenate(x) for x in zip(*map(unpack, blocks), strict=True))
        score, base, *other = (x.view(np.float64) for x in rest)
        for r in range(GT_ORDER):
            score = score + other[r] * math.log10(d[r])
            if r + 2 > order:  # nothing of such a history is discounted
                score = score + other[GT_ORDER + r]
        at = np.lexsort((b, a))
        begin = _runs(a[at], b[at])
        total = lambda x: np.add.reduceat(x[at], begin)
        return _sum_batch(signed(a[at][begin]), signed(b[at][begin]), signed(total(known)), total(base), total(score))

    last, blocks = None, []
    for batch in batches:
        for r, block in zip(batch.column("r").to_pylist(), batch.column("block"), strict=True):
            if r != last and blocks:
                yield out(blocks)
                blocks = []
            last = r
            blocks.append(block.as_py())
    if blocks:
        yield out(blocks)


def _of_classes(batches: Iterator[pa.RecordBatch], log_back: np.ndarray, adjust: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.column("k").to_numpy()
        s = np.where(batch.column("what").to_numpy() == UNSEEN_CLASS, log_back[k], adjust[k])
        none = np.zeros(len(k))
        yield _sum_batch(batch.column("a"), batch.column("b"), none.astype(np.int64), none, s)


def _own(batches: Iterator[pa.RecordBatch], classes: _Classes, gain: np.ndarray, adjust: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per text: tokens, and what its classes and named pairs contribute."""
    base_of = classes.uni.log10_base(classes.c)
    for part in chunks(batches, "text"):
        hist, next_, doc = classes.tokens(part)
        n = part.num_rows
        train = ~part.column("_held").to_numpy(zero_copy_only=False)
        known = np.flatnonzero(classes.known(next_))
        base = np.bincount(doc[known], weights=base_of[next_[known]], minlength=n).astype(float)
        count = np.bincount(doc[known], weights=classes.c[next_[known]] > 0, minlength=n).astype(np.int64)
        hc = classes.known(hist)
        pairs = np.flatnonzero(hc & classes.known(next_))
        number, named = classes.find_named(hist[pairs], next_[pairs])
        score = np.bincount(doc[pairs[named]], weights=gain[number[named]], minlength=n).astype(float)  # of nothing: whole zeros
        hc[pairs[named]] = False
        late = np.flatnonzero(hc & train[doc])
        score += np.bincount(doc[late], weights=adjust[hist[late]], minlength=n)
        held = part.column("_held")
        tokens = np.bincount(doc, minlength=n)
        columns = [part.column("doc_id"), part.column("_a"), part.column("_b"), held, pa.array(tokens), pa.array(count), pa.array(base), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "held_out", "n_tokens", "known", "base", "s"])


def learn_and_score(docs: DataFrame, held: Column) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    The model of ``katz`` learns from the rows that aren't ``held`` and scores all.  Null
    and empty texts have the end alone; repeated rows are each counted and scored; null
    ids stay; an empty table gives no rows; other columns are not read.  Without training
    text every token is unseen and has probability 1.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(True)).alias("_held"))
    source = source.withColumns({"_a": F.coalesce("doc_id", F.lit(0)), "_b": F.xxhash64("text", F.col("doc_id").isNull(), "_held")})
    counted = source.where(~F.col("_held")).select("text").mapInArrow(_words_and_pairs, "kind int, key long, c long")
    table = stored(counted.groupBy("kind", "key").agg(F.sum("c").alias("c")), "words")
    uni = katz.unigrams(table.where("kind = 0").select("key", "c"))
    wanted = F.when(F.col("kind") == 0, (F.col("c") >= katz.CLASS_SHARE * uni.tokens) | (F.col("key") == END_KEY)).otherwise(F.col("c") >= HOT_SHARE / 2 * uni.tokens)
    often = table.where(wanted).orderBy("kind", "key").toArrow()  # 1 / CLASS_SHARE words and 2 / HOT_SHARE pairs at most
    drop(table)
    kind, keys, counts = (often.column(c).to_numpy() for c in ("kind", "key", "c"))
    classes = _Classes(uni, keys[kind == 0], counts[kind == 0], keys[kind == 1])
    buckets = 1 + uni.tokens // BUCKET_TOKENS
    dealt = source.mapInArrow(partial(_dealt, classes=classes, buckets=buckets), "bucket int, block binary")
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(partial(_reduce, classes=classes, back=buckets), FOUND), "reduced")
    rows = lambda what: found.where(F.col("what") == what)

    pairs = rows(NAMED).groupBy("k").agg(F.sum("n").alias("n"), F.first("a").alias("h"), F.first("b").alias("w")).toArrow()
    number, n, h, w = (pairs.column(c).to_numpy() for c in ("k", "n", "h", "w"))
    many = np.bincount(np.minimum(n, GT_ORDER + 1), minlength=GT_ORDER + 2)
    for r in rows(COUNTS).groupBy("k").agg(F.sum("n").alias("n")).collect():
        many[r["k"]] += r["n"]
    d = katz.discounts(many.tolist())
    lost = np.array([r * (1 - x) for r, x in enumerate(d, 1)])
    shown, low = np.zeros((classes.n, GT_ORDER)), np.zeros(classes.n)
    each = [F.sum(F.get("m", r)).alias(f"m{r}") for r in range(GT_ORDER)]
    sums = rows(CLASS).groupBy("k").agg(F.sum("x").alias("x"), *each).toArrow()
    at = sums.column("k").to_numpy()
    low[at] = sums.column("x").to_numpy()
    for r in range(GT_ORDER):
        shown[at, r] = sums.column(f"m{r}").to_numpy()
    np.add.at(low, h, 10 ** classes.log_p[w])
    few = n <= GT_ORDER
    np.add.at(shown, (h[few], n[few] - 1), 1)
    c = classes.c.astype(float)
    freed = shown @ lost
    full, none = 1 - low <= 1e-12, c == 0
    below = np.where(full, c - freed, np.where(freed > 0, c, c + 1))
    below[none] = 1
    back = np.where(full | none, 1.0, (1 - (c - freed) / below) / np.where(full, 1, 1 - low))
    adjust = np.where(none, 0.0, np.log10(np.where(none, 1, c) / below))
    gain = np.zeros(len(classes.named))
    gain[number] = np.log10(np.array([*d, 1.0])[np.minimum(n, GT_ORDER + 1) - 1] * n / below[h])

    own = source.mapInArrow(partial(_own, classes=classes, gain=gain, adjust=adjust), "doc_id long, a long, b long, held_out boolean, n_tokens long, known long, base double, s double")
    returned = rows(DOC).select("r", "block").repartition(buckets, "r").sortWithinPartitions("r").mapInArrow(partial(_returned, d=d), SUMS)
    late = rows(UNSEEN_CLASS).union(rows(CLOSED)).select("what", "a", "b", "k").mapInArrow(partial(_of_classes, log_back=np.log10(back), adjust=adjust), SUMS)
    histories = rows(HISTORY).select("k", F.col("n").alias("c"), F.col("x").alias("own"), sum((F.get("m", r) * float(lost[r]) for r in range(GT_ORDER)), F.lit(0.0)).alias("freed"))
    lower = rows(LOWER).join(histories.select("k"), "k", "left_semi").groupBy("k").agg(F.sum(F.pow(F.lit(10.0), uni.log10_p_of(F.col("n")))).alias("low"))
    under = F.when(F.col("freed") > 0, F.col("c")).otherwise(F.col("c") + 1)
    weight = (1 - (F.col("c") - F.col("freed")) / under) / (1 - F.col("own") - F.coalesce("low", F.lit(0.0)))
    weights = histories.join(lower, "k", "left").select("k", F.log10(weight).alias("s"))
    asked = rows(UNSEEN_KEY).select("a", "b", "k").join(weights, "k").select("a", "b", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "s")
    parts = returned.union(late).union(asked).select("a", "b", "known", "base", "s", F.lit(0).cast("long").alias("times"))
    mine = own.select("a", "b", "known", "base", "s", F.lit(1).cast("long").alias("times"), "doc_id", "held_out", "n_tokens")
    summed = mine.unionByName(parts, allowMissingColumns=True).groupBy("a", "b")
    summed = summed.agg(*(F.sum(x).alias(x) for x in ("known", "base", "s", "times")), *(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens")))
    mean = lambda x: F.round(F.col(x) / F.col("times"), 9)  # noqa: E731  # equal rows have equal scores
    once = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    out = summed.select("doc_id", "held_out", "n_tokens", F.round(F.col("known") / F.col("times")).cast("long").alias("n_known"), F.lit(uni.tokens).cast("long").alias("train_tokens"), mean("base").alias("base_score"), mean("s").alias("score"), once.alias("_once"))
    return out.drop("_once")
