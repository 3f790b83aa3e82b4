"""SimHash near-dedup through pivot distance tables.

Every text gets a 64-bit fingerprint.  A *pivot table* holds, for each distinct
fingerprint, its Hamming distances to 65 references: zero, and for each of eight
8-bit blocks the all-ones word and the seven non-trivial Walsh words of that block.
A reference of one block differs from zero only there, so the difference of two
distances is a coordinate of that block alone, and eight of them determine it.

Two fingerprints at distance 2 or less differ in two blocks at most: on six blocks
all coordinates are equal.  Rows are therefore dealt by the coordinates of six
blocks, once for each of the 28 choices; what meets in such a cell is discarded by
the largest coordinate difference (a distance of d moves no coordinate by more than
d) and survivors are verified on the bits.  A cell fixes 48 of 64 bits, so it never
holds more than 65,536 distinct fingerprints, whatever the input.  Only links to the
first member of each cluster within a cell leave it, never all pairs, and pairs that
are known to be linked are not verified again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import stored
from .textops import chunks, signed, split_words

BITS, BLOCKS, MAX_DISTANCE = 64, 8, 2
CELL_MASK = 31  # the last bits of a cell's key number its choice of open blocks
TABLE_ROWS, PAIR_ROWS, HELD_ROWS = 4_096, 1 << 17, 65_536  # rows, pairs and members that a task holds together
SEED = 42


def references() -> np.ndarray:
    """The 65 references: zero, then eight for each block of eight bits."""
    walsh = []
    for r in range(1, 8):
        walsh.append(sum(1 << i for i in range(8) if bin(i & r).count("1") % 2))
    local = [0xFF, *walsh]
    return np.array([0, *(w << (8 * b) for b in range(BLOCKS) for w in local)], np.uint64)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to all references: (n, 65), one byte each."""
    return np.bitwise_count(prints[:, None] ^ references()[None, :]).astype(np.int8)


def block_keys(table: np.ndarray) -> np.ndarray:
    """One 64-bit key for the eight coordinates of each block: (n, 8).  Equal keys, equal coordinates."""
    own = (table[:, 1:] - table[:, :1]).astype(np.int64).reshape(-1, BLOCKS, 8) + 8  # 0 to 16 each
    return own @ (np.int64(17) ** np.arange(8, dtype=np.int64))


def _cell_keys(table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    keys = block_keys(table).astype(np.uint64)
    for cell, left_out in enumerate(combinations(range(BLOCKS), MAX_DISTANCE)):
        h = np.full(len(keys), cell, np.uint64)
        for b in range(BLOCKS):
            if b not in left_out:
                h = (h ^ keys[:, b]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        yield cell, (h & ~np.uint64(CELL_MASK)) | np.uint64(cell)


def fingerprints_of(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """SimHash of each text: words lower-cased in A-Z, shingles with repeats, XXH64 with seed 42."""
    words = split_words(column, lower=True)
    out = np.zeros(words.n_docs, np.uint64)
    if not len(words):
        return out
    text, begin, end = words.spaced()
    n = words.per_doc
    doc = words.doc
    at = np.flatnonzero((np.arange(len(words)) + shingle <= words.first[doc + 1]) | (np.arange(len(words)) == words.first[doc]))
    last = np.minimum(at + shingle, words.first[doc[at] + 1]) - 1
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(text[s:e], SEED) for s, e in zip(begin[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
    full = np.flatnonzero(n)
    starts = np.searchsorted(doc[at], full)
    count = np.diff(np.append(starts, len(at)))
    ones = np.zeros((len(full), BITS), np.int64)
    for k in range(BITS // 8):  # eight bits at a time, for memory
        byte = ((hashes >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(np.unpackbits(byte[:, None], axis=1, bitorder="little"), starts, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        prints = pa.array(signed(fingerprints_of(part.column("text"), shingle)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), prints], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row for each row of ``docs``; a text without words (or null) has fingerprint 0."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(partial(_fingerprint_batches, shingle=shingle), "doc_id long, fp long")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(prints), TABLE_ROWS):
            some = prints[at : at + TABLE_ROWS]
            for _, keys in _cell_keys(pivot_table(some)):
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(signed(some))], ["cell", "fp"])


def _verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each pair is linked: first by the largest coordinate difference, then by the bits."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), TABLE_ROWS):
        u, v = x[at : at + TABLE_ROWS], y[at : at + TABLE_ROWS]
        near = np.abs(pivot_table(u) - pivot_table(v)).max(axis=1) <= MAX_DISTANCE
        near[near] = np.bitwise_count(u[near] ^ v[near]) <= MAX_DISTANCE
        out[at : at + TABLE_ROWS] = near
    return out


def _block_near() -> np.ndarray:
    """Which values of one block (256, 256) no coordinate of that block tells apart by more than the distance."""
    local = pivot_table(np.arange(256, dtype=np.uint64))[:, :9]  # to zero and to the eight words of the block
    return (np.abs(local[:, None] - local[None]) <= MAX_DISTANCE).all(axis=2)


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of each pair; ``root`` is the least member of each, in place."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root[:] = up


def _links_of_cells(cells: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole cells, rows sorted by (cell, fp): each linked member, to the least of its component in the cell.

    A cell leaves two blocks open.  Members with the same higher one are a *group*.
    Groups that a coordinate of that block tells apart are never paired; pairs of
    members are discarded by the coordinates of the lower block, then by the whole
    table.  ``PAIR_ROWS`` pairs are looked at together, whatever the cell holds.
    """
    open_ = np.array(list(combinations(range(BLOCKS), MAX_DISTANCE)), np.uint64)[cells & CELL_MASK]
    byte = lambda k: ((prints >> (open_[:, k] * np.uint64(8))) & np.uint64(255)).astype(np.int64)
    low, high = byte(0), byte(1)
    near = _block_near()
    begin = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (high[1:] != high[:-1]))))
    size = np.diff(np.append(begin, len(cells)))
    root = np.arange(len(cells))
    for shift in range(len(begin)):  # 255 at most: a cell has 256 groups
        g = np.arange(len(begin) - shift)
        same = cells[begin[g]] == cells[begin[g + shift]]
        if not same.any():
            break
        g = g[same & near[high[begin[g]], high[begin[g + shift]]] & (size[g] * size[g + shift] > (shift == 0))]
        upto = np.cumsum(size[g] * size[g + shift])
        at = 0
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIR_ROWS, side="right")))
            some = g[at:to]
            at = to
            n = size[some] * size[some + shift]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(size[some + shift], n)
            x, y = np.repeat(begin[some], n) + k // wide, np.repeat(begin[some + shift], n) + k % wide
            few = np.flatnonzero((x < y) & near[low[x], low[y]])
            few = few[root[x[few]] != root[y[few]]]  # the rest is known to be linked
            few = few[_verified(prints[x[few]], prints[y[few]])]
            _merge(root, x[few], y[few])
    linked = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
    return prints[linked], prints[root[linked]]


def _linked_within(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted distinct fingerprints that differ in two blocks at most, as one cell."""
    spread = int(np.bitwise_or.reduce(members ^ members[0]))
    differ = {b for b in range(BLOCKS) if spread >> (8 * b) & 255}
    cell = next(k for k, blocks in enumerate(combinations(range(BLOCKS), MAX_DISTANCE)) if differ <= set(blocks))
    return _links_of_cells(np.full(len(members), cell), members)


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (cell, fp); a cell may span batches, but holds 65,536 rows at most."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def links(cells: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        x, y = _links_of_cells(cells, prints)
        pairs = np.unique(np.stack([x, y], axis=1)[x != y], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(signed(pairs[:, 0].copy())), pa.array(signed(pairs[:, 1].copy()))], ["a", "b"])

    for batch in batches:
        held.append((batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
        size += batch.num_rows
        if size < HELD_ROWS:
            continue
        cells, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(cells, cells[-1]))
        if cut:
            yield links(cells[:cut], prints[:cut])
        held, size = [(cells[cut:], prints[cut:])], len(cells) - cut
    if size:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: links within distance 2 that keep all components, from distinct fingerprints ``fp``."""
    dealt = prints.mapInArrow(_dealt, "cell long, fp long")
    ordered = dealt.repartition("cell").sortWithinPartitions("cell", "fp")
    return ordered.mapInArrow(_cell_links, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Texts whose fingerprints differ in two bits or fewer are linked; ``component_id``
    is the least doc_id that can be reached.  Null and empty texts have fingerprint 0
    and link like any other; a null doc_id keeps its row and is ignored in the minimum
    (null if no other is reached); repeated rows are each returned; an empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = stored(components(near_links(least.select("fp"))), "roots")
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(heads, "root").select("fp", "component_id")
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` without the rows whose component holds a smaller doc_id; all columns stay.

    Rows with a null doc_id have no place in that order and stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), shingle)
    gone = found.where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
