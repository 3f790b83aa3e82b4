"""Near-dedup by shingle similarity.

Two texts are near copies if the sets of their ``WORDS``-word shingles (words lower-cased
in A-Z; of all words where there are fewer) have a Jaccard similarity of ``LEAST`` or
more.  Equal sets are one *member*, named by a hash of the set.  Members first meet by
their SimHash fingerprints: those at distance 2 or less, found in the cells of op2's pivot
distance table.  A pair of similarity 0.8 may be ten bits or more apart, where no cells
can be exact, so members also meet where one of ``BANDS`` groups of ``ROWS`` minima over
the set is equal, which for a pair of similarity s fails with probability
(1 - s**4)**24: 3 in a million at 0.8, none at 1.
What meets is verified on the sets themselves, so no pair below ``LEAST`` is linked.

Groups of ``SMALL`` members give all their pairs.  In a larger one the task that holds it
compares each member with those it isn't linked to yet and can be a near copy of by its
rarest shingles, so many copies of one text cost one comparison each and leave one link
each, and many pages of one template aren't compared at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import stored
from .simhash import BITS, near_links
from .textops import chunks, mixed, signed, split_words, word_hashes

WORDS, LEAST = 5, 0.8
BANDS, ROWS, SMALL = 24, 4, 48


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end, and the offsets of each text."""
    found = split_words(column, lower=True)
    if not len(found):
        return np.zeros(0, np.uint64), np.zeros(found.n_docs + 1, np.int64)
    index, distinct = found.encode()
    own = word_hashes(distinct)[:, 0][index]
    place = np.arange(len(found))
    stop = found.first[found.doc + 1]
    at = np.flatnonzero((place + words <= stop) | (place == found.first[found.doc]))
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        there = at + k < stop[at]
        h[there] = mixed(h[there] * np.uint64(0x9E3779B97F4A7C15) + own[at[there] + k])
    doc = found.doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=found.n_docs))))


def set_keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set; 0 for the empty one."""
    out = np.zeros(len(off) - 1, np.uint64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = mixed(np.add.reduceat(mixed(h), off[full]) + np.diff(off)[full].astype(np.uint64))
    return out


def bands(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Keys of the groups that each set without its empty ones belongs to: (sets, BANDS)."""
    start = off[:-1][np.diff(off) > 0]
    salt = np.random.default_rng(42).integers(0, 2**63, (BANDS * ROWS, 2), dtype=np.uint64)
    out = np.zeros((len(start), BANDS), np.uint64)
    for k, (a, b) in enumerate(salt):
        if len(start):
            least = np.minimum.reduceat((h ^ b) * (a | np.uint64(1)), start)
            at = k // ROWS
            out[:, at] = mixed(out[:, at] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(at))
    return out


def set_prints(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is 1 if it is in over half the shingles' hashes; 0 for the empty one."""
    n = np.diff(off)
    full = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(full):
        ones = np.zeros((len(full), BITS), np.int32)
        for k in range(BITS // 8):  # eight bits at a time, for memory
            byte = ((h >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
            ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(np.unpackbits(byte[:, None], axis=1, bitorder="little"), off[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets, neither empty."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        h, off = shingle_sets(part.column("text"))
        mine = bands(h, off)
        at = np.concatenate(([0], np.cumsum((np.diff(off) > 0) * BANDS)))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(mine.ravel())))
        numbers = [pa.array(signed(x)) for x in (set_keys(h, off), set_prints(h, off))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, lists], ["doc_id", "key", "fp", "bands"])


def _keyed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        h, off = shingle_sets(part.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(signed(h)))
        yield pa.RecordBatch.from_arrays([pa.array(signed(set_keys(h, off))), lists], ["key", "shingles"])


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
    """Band and columns of each run of rows of one band."""
    held: list[list] = []
    for batch in batches:
        band = batch.column("band").to_numpy()
        if not len(band):
            continue
        cut = [0, *(np.flatnonzero(band[1:] != band[:-1]) + 1).tolist(), len(band)]
        for s, e in zip(cut, cut[1:], strict=False):
            rows = [band[s], *(batch.column(x).slice(s, e - s).to_numpy(zero_copy_only=False) for x in names)]
            if held and held[-1][0] != rows[0]:
                yield [held[0][0], *(np.concatenate(x) if x[0].dtype != object else [v for y in x for v in y] for x in list(zip(*held, strict=True))[1:])]
                held = []
            held.append(rows)
    if held:
        yield [held[0][0], *(np.concatenate(x) if x[0].dtype != object else [v for y in x for v in y] for x in list(zip(*held, strict=True))[1:])]


def _met(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of small bands, and (band, member) with ``large`` of others.  Rows arrive sorted by (band, key)."""
    band, key = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(band: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1]))) if len(band) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(band)))
        many = np.repeat(size > small, size)
        pairs = [x for k in np.flatnonzero((size > 1) & (size <= small)) for x in combinations(key[begin[k] : begin[k] + size[k]].tolist(), 2)]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        large = np.repeat([True, False], [many.sum(), len(both)])
        arrays = [np.concatenate((band[many], both[:, 0])), np.concatenate((key[many], both[:, 1])), large]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["a", "b", "large"])

    for batch in batches:
        band = np.concatenate((band, batch.column("band").to_numpy()))
        key = np.concatenate((key, batch.column("key").to_numpy()))
        cut = int(np.searchsorted(band, band[-1])) if len(band) else 0
        yield out(band[:cut], key[:cut])
        band, key = band[cut:], key[cut:]
    yield out(band, key)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("left", "right"))
        near = np.array([similarity(x.view(np.uint64), y.view(np.uint64)) >= LEAST for x, y in zip(left, right, strict=True)], bool)
        yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(near)) for x in ("a", "b")], ["a", "b"])


class _Crowd:
    """The sets of one band, with an index of the shingles by which a near copy can be met.

    Shingles are ordered from the rarest in the band to the most frequent.  Two sets of
    similarity ``LEAST`` share one of the first ``n - ceil(LEAST * n) + 1`` of either, and
    after the first that they share enough have to be left in both.  Nothing else is
    compared, so pages that have a frequent template in common and little else don't meet.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets, n = sets, np.array([len(x) for x in sets], np.int64)
        _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.lexsort((code, often[code], owner))
        place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        reach = n - np.ceil(LEAST * n - 1e-9).astype(np.int64) + 1
        first = place < reach[owner]  # owners are in order
        code, owner, place = code[order][first], owner[first], place[first]
        _, code, often = np.unique(code, return_inverse=True, return_counts=True)
        shared = often[code] > 1
        code, owner, place = code[shared], owner[shared], place[shared]
        by_code = np.lexsort((owner, code))
        self.n, self.code, self.owner, self.rest = n, code[by_code], owner[by_code], n[owner[by_code]] - place[by_code]
        self.start = np.searchsorted(self.code, self.code)  # where the entries of an entry's shingle begin
        at = np.argsort(self.owner, kind="stable")
        self.entries = np.split(at, np.searchsorted(self.owner[at], np.arange(1, len(sets))))
        self.root = np.arange(len(sets))
        self.members: dict[int, list[int]] = {k: [k] for k in range(len(sets))}
        self.only = np.full(int(self.code.max(initial=-1)) + 1, -1)  # a set with the shingle, if all so far are of one root; else -2

    def join(self, a: int, b: int) -> None:
        a, b = sorted((int(self.root[a]), int(self.root[b])), key=lambda r: len(self.members[r]))
        self.root[self.members[a]] = b
        self.members[b] += self.members.pop(a)

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs of similarity ``LEAST`` that keep the components."""
        for k, own in enumerate(self.entries):
            for e in own:
                there = self.only[self.code[e]]
                if there == -1 or there >= 0 and self.root[there] == self.root[k]:
                    continue
                some = slice(self.start[e], e)
                other = self.owner[some]
                need = np.ceil(LEAST / (1 + LEAST) * (self.n[k] + self.n[other]) - 1e-9)
                near = other[(self.root[other] != self.root[k]) & (np.minimum(self.rest[some], self.rest[e]) >= need)]
                while len(near):
                    j = int(near[-1])
                    if similarity(self.sets[k], self.sets[j]) >= LEAST:
                        self.join(k, j)
                        yield k, j
                        near = near[self.root[near] != self.root[k]]
                    else:
                        near = near[:-1]
            for c in self.code[own]:
                there = self.only[c]
                self.only[c] = k if there == -1 or there >= 0 and self.root[there] == self.root[k] else -2


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that keep the components of each large band."""
    for _, member, sets in _runs(batches, ["key", "shingles"]):
        pairs = np.array(list(_Crowd([x.view(np.uint64) for x in sets]).links()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(member[pairs[:, k]], pa.int64()) for k in (0, 1)], ["a", "b"])


def pivot_pairs(members: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of members ``(key, fp)`` that keep all links of fingerprints within two bits, by the pivot table's cells.

    Members of one fingerprint meet its first; a text without words has no part in it.
    """
    some = members.where("key <> 0").select("key", "fp")
    heads = stored(some.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    same = some.join(heads, "fp").select(F.col("head").alias("a"), F.col("key").alias("b"))
    a, b = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"{x}_head")) for x in ("a", "b"))
    other = near_links(heads.select("fp")).join(a, "a").join(b, "b").select("a_head", "b_head")
    return same.union(other).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs`` with a doc_id.

    ``component_id`` is the least doc_id that links of similarity ``LEAST`` reach.  Texts
    without words (or null) are copies of each other.  Other columns are not read.
    """
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(source.mapInArrow(_sketches, "doc_id long, key long, fp long, bands array<long>"), "sketches")
    members = stored(sketches.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "members")
    dealt = members.select("key", F.explode("bands").alias("band")).repartition("band").sortWithinPartitions("band", "key")
    met = stored(dealt.mapInArrow(partial(_met, small=SMALL), "a long, b long, large boolean"), "met")
    pairs = stored(met.where("not large").select("a", "b").union(pivot_pairs(members)).distinct(), "pairs")
    crowds = met.where("large").select(F.col("a").alias("band"), F.col("b").alias("key"))
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(crowds.select("key")).distinct()
    texts = source.join(wanted.join(members, "key").select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(texts.mapInArrow(_keyed_sets, "key long, shingles array<long>").dropDuplicates(["key"]), "sets")
    left, right = (sets.select(F.col("key").alias(x), F.col("shingles").alias(y)) for x, y in (("a", "left"), ("b", "right")))
    links = pairs.join(left, "a").join(right, "b").mapInArrow(_verified, "a long, b long")
    crowded = crowds.join(sets, "key").select("band", "key", "shingles").repartition("band").sortWithinPartitions("band", "key")
    links = links.union(crowded.mapInArrow(_spanned, "a long, b long"))
    roots = stored(components(links), "roots")
    rooted = members.join(roots, members.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(heads, "root").select("key", "component_id")
    return sketches.join(labels, "key").select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component holds a smaller doc_id; all columns stay.

    Rows with a null doc_id have no place in that order and stay.
    """
    gone = near_copies(docs).where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
