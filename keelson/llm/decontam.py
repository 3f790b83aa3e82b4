"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Every passage of every training text is a query.  Impacts are BM25 weights divided by
the item's own full score, so a score is the share of the item's weight that a passage
holds, and one threshold serves all items.  Passages are two neighbouring blocks of
words, each as long as the longest item of a length class, so any item lies within one
passage.

Passages of a chunk are searched together, each by the steps of block-max WAND.  Terms
of little weight are set aside; they count by the most that they give any item.  The
sum of the other terms' largest impacts bounds a passage's score; where that reaches the
threshold, the sums of their largest impacts within each block of ``BLOCK`` postings
bound the score of the items there; and only in blocks that reach it are items scored in
full.  No item above the threshold is missed.  Each hit is then verified by its words in
order: enough 3-word runs of the item's question and of its answer have to stand in the
passage.

Items are indexed in shards of bounded size, each sent to the tasks with the function;
a benchmark of several shards costs a pass over the texts for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import chunks, split_words

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.6, 0.5
ANSWER_SHARE, RUN = 0.3, 3
SHARD_BYTES, SHARD_ITEMS = 16 << 20, 50_000
BLOCK = 4  # items
SHORTEST_CLASS = 64  # words
AT_ONCE = 2_000_000  # block maxima summed together
LIGHT = 0.1  # what light terms may give an item together
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def term(word: bytes) -> bytes:
    """A lower-cased word without the punctuation around it."""
    return word.strip(EDGES)


def terms_of(text: str | None) -> list[bytes]:
    column = pa.array([text], pa.string())
    words = split_words(column, lower=True)
    index, distinct = words.encode()
    plain = [term(w) for w in distinct]
    return [plain[k] for k in index.tolist() if plain[k]]


def runs(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = max(1, min(n, len(words)))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


@dataclass
class Index:
    """Items of one length class."""

    span: int  # words in a block of text
    items: list[int]
    words: list[list[bytes]]
    ids: dict[bytes, int] = field(default_factory=dict)
    weights: list[dict[int, float]] = field(default_factory=list)  # by item: term -> impact
    most: np.ndarray | None = None  # by term: its largest impact
    heavy: np.ndarray | None = None  # by term: not set aside
    light_sum: float = 0.0  # the most that terms set aside give an item
    first: np.ndarray | None = None  # by term: where its blocks begin in the next two
    block: np.ndarray | None = None
    block_max: np.ndarray | None = None

    def build(self, df: dict[bytes, int], n_items: int, mean_length: float) -> Index:
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for k, words in enumerate(self.words):
            length = K1 * (1 - B + B * len(words) / mean_length)
            w = {t: np.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + length) for t, tf in Counter(words).items()}
            total = sum(w.values())
            for t, x in w.items():
                postings.setdefault(t, []).append((k, float(x / total)))
        self.ids = {t: k for k, t in enumerate(sorted(postings))}
        self.weights = [{} for _ in self.words]
        self.most = np.zeros(len(self.ids))
        self.heavy = np.ones(len(self.ids), bool)
        first, block, block_max = [0], [], []
        for t, k in self.ids.items():
            best: dict[int, float] = {}
            for item, x in postings[t]:
                self.weights[item][k] = x
                best[item // BLOCK] = max(best.get(item // BLOCK, 0.0), x)
            self.most[k] = max(best.values())
            block += best
            block_max += best.values()
            first.append(len(block))
        self.first, self.block, self.block_max = np.array(first), np.array(block, np.int64), np.array(block_max)
        given = np.zeros(len(self.words))
        for t in sorted(self.ids, key=lambda t: (-len(postings[t]), t)):  # the most frequent first
            at, x = zip(*postings[t], strict=True)
            given[list(at)] += x
            if given.max() > LIGHT:
                break
            self.light_sum = float(given.max())
            self.heavy[self.ids[t]] = False
        return self

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all that reach the threshold, from distinct pairs sorted by passage."""
        terms_of: dict[int, set[int]] = {}
        out = []
        need = threshold - self.light_sum - 1e-9
        strong = self.heavy[term]
        p, t = passage[strong], term[strong]
        bound = np.bincount(p, weights=self.most[t]) if len(p) else np.zeros(0)
        open_ = bound[p] >= need if len(p) else np.zeros(0, bool)
        p, t = p[open_], t[open_]
        n = self.first[t + 1] - self.first[t]
        n_blocks = -(-len(self.items) // BLOCK)
        ends = np.flatnonzero(np.append(p[1:] != p[:-1], True)) + 1 if len(p) else np.zeros(0, np.int64)
        total = np.cumsum(n)
        at = 0
        while at < len(p):  # whole passages, as many as fit
            done = total[at - 1] if at else 0
            to = int(ends[np.searchsorted(ends, at, side="right")])  # one at least
            to = max(to, int(np.append(0, ends)[np.searchsorted(total[ends - 1], done + AT_ONCE, side="right")]))
            some = slice(at, to)
            row = np.repeat(np.arange(at, to), n[some])
            entry = np.arange(len(row)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + self.first[t[row]]
            cell, inverse = np.unique(p[row] * n_blocks + self.block[entry], return_inverse=True)
            best = np.bincount(inverse, weights=self.block_max[entry])
            for c in cell[best >= need].tolist():
                d, b = divmod(c, n_blocks)
                if d not in terms_of:
                    low, high = np.searchsorted(passage, (d, d + 1))
                    terms_of[d] = set(term[low:high].tolist())
                for item in range(b * BLOCK, min(b * BLOCK + BLOCK, len(self.items))):
                    score = sum(x for k, x in self.weights[item].items() if k in terms_of[d])
                    if score >= threshold:
                        out.append((d, item, score))
            at = to
        return out

    def verified(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        """Share of the runs of the item's question and of its answer that the passage holds."""
        words = self.words[item]
        cut = len(words) - max(1, round(ANSWER_SHARE * len(words))) if len(words) > 1 else 0
        have = {n: runs(passage, n) for n in (1, 2, 3)}
        share = []
        for side in (words[:cut], words[cut:]):
            wanted = runs(side, RUN)
            n = min(RUN, len(side))
            share.append(len(wanted & have[n]) / len(wanted) if wanted else 1.0)
        return share[0], share[1]


def build_shards(bench: DataFrame) -> list[list[Index]]:
    """Indexes of ``bench(item_id, text)`` by shard and length class; items without words are left out."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    count, total = bench.agg(F.count("*"), F.sum(size)).first()
    shards = max(1, -(-count // SHARD_ITEMS), -(-(total or 0) // SHARD_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    counted = bench.select("text").mapInArrow(_item_terms, "term binary, n long, length long")
    stats = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    sums = stats.where("term is null").first()
    out = []
    for k in range(shards):
        rows = bench.where(part == k).select("item_id", "text").orderBy("item_id", "text").collect()
        own = [(r["item_id"], terms_of(r["text"])) for r in rows]
        own = [(i, w) for i, w in own if w]
        if not own:
            continue
        wanted = stats.where("term is not null")
        if shards > 1:
            have = bench.where(part == k).select("text").mapInArrow(_item_terms, "term binary, n long, length long").select("term").distinct()
            wanted = wanted.join(have, "term", "left_semi")
        df = {bytes(r["term"]): r["n"] for r in wanted.select("term", "n").collect()}
        classes: dict[int, list[tuple[int, list[bytes]]]] = {}
        for i, w in own:
            span = SHORTEST_CLASS
            while span < len(w):
                span *= 2
            classes.setdefault(span, []).append((i, w))
        out.append([Index(span, [i for i, _ in x], [w for _, w in x]).build(df, sums["n"], sums["length"] / sums["n"]) for span, x in sorted(classes.items())])
    return out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct term of an item; with a null term, the item itself and its length."""
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            words = terms_of(text)
            if words:
                rows += [(t, 1, 0) for t in set(words)] + [(None, 1, len(words))]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["term", "n", "length"])


def find_leaks(part: pa.RecordBatch, indexes: list[Index], threshold: float) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    """(row, item) of a chunk -> best score, overlaps of question and answer, first word of the passage."""
    words = split_words(part.column("text"), lower=True)
    index, distinct = words.encode()
    found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    if not len(words):
        return found
    plain = [term(w) for w in distinct]
    blank = np.array([not t for t in plain], bool)
    keep = np.flatnonzero(~blank[index])  # words that are punctuation alone don't count
    doc, index = words.doc[keep], index[keep]
    first = np.searchsorted(doc, np.arange(words.n_docs + 1))
    place = np.arange(len(doc)) - first[doc]
    for ix in indexes:
        code = np.array([ix.ids.get(t, -1) for t in plain], np.int64)[index]
        blocks = -(-np.diff(first) // ix.span)
        base = np.concatenate(([0], np.cumsum(blocks)))
        block = base[doc] + place // ix.span
        owner = np.repeat(np.arange(words.n_docs), blocks)
        hit = np.flatnonzero(code >= 0)
        at, term_ids = block[hit], code[hit]
        starts = np.ones(len(owner), bool)
        starts[1:] = owner[1:] != owner[:-1]
        inner = ~starts[at]  # a block also belongs to the passage that begins one before
        size = len(ix.ids)
        pairs = np.unique(np.concatenate((at * size + term_ids, (at[inner] - 1) * size + term_ids[inner])))
        for b, item, score in ix.search(pairs // size, pairs % size, threshold):
            d = int(owner[b])
            low = int(first[d] + (b - base[d]) * ix.span)
            high = int(min(low + 2 * ix.span, first[d + 1]))
            question, answer = ix.verified(item, [plain[k] for k in index[low:high].tolist()])
            if question >= OVERLAP and answer >= OVERLAP:
                key = (d, ix.items[item])
                found[key] = max(found.get(key, (0.0, 0.0, 0.0, 0)), (score, question, answer, low - int(first[d])))
    return found


def _leaks(batches: Iterator[pa.RecordBatch], indexes: list[Index], threshold: float) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        ids = part.column("doc_id").to_pylist()
        rows = [(ids[d], item, *x) for (d, item), x in sorted(find_leaks(part, indexes, threshold).items())]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_word"])


def leaks(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap, passage_word)`` for every leak.

    One row for each row of ``docs`` and item of ``bench`` that it holds, with the best
    passage.  Null and empty texts and items hold nothing; items with the same text are
    each reported; repeated rows of ``docs`` give repeated rows; a null doc_id stays
    null; empty tables give no rows; other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_word long"
    found = [source.mapInArrow(partial(_leaks, indexes=ix, threshold=threshold), schema) for ix in build_shards(items)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def _clean(batches: Iterator[pa.RecordBatch], indexes: list[Index], threshold: float) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        leaky = {d for d, _ in find_leaks(part, indexes, threshold)}
        yield part.filter(pa.array([k not in leaky for k in range(part.num_rows)], pa.bool_()))


def without_leaks(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that hold no item of ``bench``; all columns stay."""
    for indexes in build_shards(bench.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        docs = docs.mapInArrow(partial(_clean, indexes=indexes, threshold=threshold), docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
