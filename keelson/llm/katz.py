"""Katz backoff language model of order 2 over words, in partitioned tables.

Training counts are exact and complete: a table of all words and a table of all pairs
of neighbouring words, whatever their counts.  The end of a text is a word, and as a
history stands for the beginning.  Counts up to ``GT_ORDER`` are discounted by
Good-Turing (Katz's form), and what a history loses goes to the words it has not shown,
in proportion to their own probability; the backoff weight is computed from the sums
over exactly the seen ones, so every history sums to 1.

A word is named by its 64-bit key; one with a share of ``CLASS_SHARE`` or more of the
training tokens (so there are 100,000 at most) has a small number instead, its class.
That only decides where it is looked up: classes travel with the tasks, and a pair that
holds another word is dealt by that word, which is never hot.

The recursion ``P(w|h) = d c(hw) / c(h)`` if seen, else ``a(h) P(w)``, is taken apart
for scoring: each token gives ``log a(h) + log P(w)``, and a seen pair adds a correction
``G(h, w)`` that turns this into the first form.  Words and pairs with a share of
``LIST_SHARE`` or more (a million at most) are looked up in lists that travel with the
tasks; all others meet their table rows by key, where by construction no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop, stored
from .textops import chunks, signed, split_words, word_hashes

CLASS_SHARE, LIST_SHARE, GT_ORDER = 1e-5, 1e-6, 5
END, RARE = 0, 1  # classes: the end, as a history the beginning; what training has not shown
END_KEY = int(word_hashes([b" "])[0, 0].astype(np.int64))  # no word holds a space
GATHER = 2_000_000  # tokens that a task counts together


def discounts(n: list[int], order: int = GT_ORDER) -> list[float]:
    """Katz's factors for counts 1 to ``order``; ``n[r]`` is how many entries have count r (r to order + 1).

    Where the counts of counts are too thin for that order a lower one is taken (the
    rest undiscounted), and below order 1 half a count is taken off each.
    """
    for k in range(order, 0, -1):
        if min(n[1 : k + 2], default=0) <= 0:
            continue
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return d + [1.0] * (order - k)
    return [(r - 0.5) / r for r in range(1, order + 1)]


@dataclass
class Unigrams:
    """Word probabilities as a function of the training count."""

    tokens: int
    types: int
    d: list[float]
    unseen: float  # mass of all words that training has not shown
    scale: float

    def log10_p(self, c: np.ndarray) -> np.ndarray:
        factor = np.array([1.0, *self.d])[np.minimum(c, len(self.d))]
        factor = np.where(c > len(self.d), 1.0, factor)
        with np.errstate(divide="ignore"):
            return np.where(c > 0, np.log10(factor * c * self.scale / max(1, self.tokens)), np.log10(self.unseen))

    def log10_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def log10_p_of(self, c: Column) -> Column:
        factor = F.when(c > len(self.d), 1.0)
        for r, x in enumerate(self.d, 1):
            factor = factor.when(c == r, x)
        return F.when(c > 0, F.log10(factor * c * self.scale / max(1, self.tokens))).otherwise(float(np.log10(self.unseen)))

    def log10_base_of(self, c: Column) -> Column:
        return F.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


@dataclass
class Lists:
    """What travels with the tasks, all sorted by key."""

    unigrams: Unigrams
    keys: np.ndarray  # words with a share of LIST_SHARE, and the end
    counts: np.ndarray
    class_keys: np.ndarray  # words with a class
    log_backoff: np.ndarray | None = None  # by history class
    key_backoff: np.ndarray | None = None  # by place in keys
    pair_codes: np.ndarray | None = None
    pair_gain: np.ndarray | None = None

    @property
    def n_classes(self) -> int:
        return len(self.class_keys) + 2


@dataclass
class Model:
    lists: Lists
    words: DataFrame  # key, c, b (log10 of the backoff weight)
    gains: DataFrame  # code, n, g


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _tokens(part: pa.RecordBatch) -> tuple:
    """Words of a chunk as indexes, the keys of distinct words, and the text of each word."""
    words = split_words(part.column("text"), lower=True)
    index, distinct = words.encode()
    keys = signed(np.ascontiguousarray(word_hashes(distinct)[:, 0])) if distinct else np.zeros(0, np.int64)
    return words, index, keys


def _summed(rows: Iterator[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Add up (key, count) arrays, some millions of rows at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        key, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names)

    for key, n in rows:
        held.append((key, n))
        size += len(key)
        if size > GATHER:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in chunks(batches, "text"):
            _, index, keys = _tokens(part)
            n = np.bincount(index, minlength=len(keys))
            yield np.append(keys, END_KEY), np.append(n, part.num_rows)

    return _summed(rows(), ["key", "c"])


def _names(words, index: np.ndarray, keys: np.ndarray, lists: Lists) -> np.ndarray:
    """Class or else key of every token of a chunk, texts end to end, each with its end."""
    at, there = _found(lists.class_keys, keys)
    own = np.where(there, at + 2, keys)
    out = np.full(len(words) + words.n_docs, END, np.int64)
    out[np.arange(len(words)) + words.doc] = own[index]
    return out


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of one 64-bit value, as Spark's xxhash64 chains it over columns."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = (seed + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _pair_codes(names: np.ndarray, n_classes: int) -> np.ndarray:
    """One number for each token with the one before: exact and not negative for two classes, else a negative hash."""
    hist = np.concatenate(([END], names[:-1]))
    classes = (hist >= 0) & (hist < n_classes) & (names >= 0) & (names < n_classes)
    hashed = _hash_long(names.view(np.uint64), _hash_long(hist.view(np.uint64), np.full(len(hist), 42, np.uint64)))
    return np.where(classes, np.where(classes, hist, 0) * n_classes + np.where(classes, names, 0), signed(hashed | np.uint64(1 << 63)))


def _is_class(name: str, lists: Lists) -> Column:
    return (F.col(name) >= 0) & (F.col(name) < lists.n_classes)


def _code_of(lists: Lists) -> Column:
    """_pair_codes for columns hist and next."""
    classes = _is_class("hist", lists) & _is_class("next", lists)
    return F.when(classes, F.col("hist") * lists.n_classes + F.col("next")).otherwise(F.xxhash64("hist", "next").bitwiseOR(F.lit(-(1 << 63))))


def _pair_counts(batches: Iterator[pa.RecordBatch], lists: Lists) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        code, name = (np.concatenate(x) for x in zip(*held, strict=True))
        _, at, n = np.unique(code, return_index=True, return_counts=True)
        hist = np.concatenate(([END], name[:-1]))  # chunks end with END, so they follow each other
        return pa.RecordBatch.from_arrays([pa.array(hist[at]), pa.array(name[at]), pa.array(n)], ["hist", "next", "n"])

    for part in chunks(batches, "text"):
        words, index, keys = _tokens(part)
        names = _names(words, index, keys, lists)
        held.append((_pair_codes(names, lists.n_classes), names))
        size += len(names)
        if size > GATHER:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _counts_of_counts(table: DataFrame, column: str) -> list[int]:
    n = [0] * (GT_ORDER + 2)
    for r in table.where(F.col(column) <= GT_ORDER + 1).groupBy(column).count().collect():
        n[r[column]] = r["count"]
    return n


def unigrams(words: DataFrame) -> Unigrams:
    """Good-Turing estimate from ``words(key, c)``."""
    tokens, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n = _counts_of_counts(words, "c")
    d = discounts(n)
    unseen = sum((1 - x) * r * n[r] for r, x in enumerate(d, 1)) / max(1, tokens)
    scale = 1.0
    if not unseen > 0:
        unseen, scale = 1 / (tokens + 1), tokens / (tokens + 1)
    return Unigrams(tokens, types, d, unseen, scale)


def train(docs: DataFrame) -> Model:
    """Fit the model to the ``text`` of ``docs``; the tables hold every word and pair."""
    text = docs.select("text")
    words = stored(text.mapInArrow(_word_counts, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "words")
    uni = unigrams(words)
    tokens = uni.tokens
    often = words.where((F.col("c") >= min(LIST_SHARE, CLASS_SHARE) * tokens) | (F.col("key") == END_KEY)).orderBy("key").toArrow()
    keys, counts = (often.column(c).to_numpy() for c in ("key", "c"))
    own = (counts >= CLASS_SHARE * tokens) & (keys != END_KEY)
    listed = (counts >= LIST_SHARE * tokens) | (keys == END_KEY)
    lists = Lists(uni, keys[listed], counts[listed], keys[own])

    pairs = text.mapInArrow(partial(_pair_counts, lists=lists), "hist long, next long, n long")
    # a pair is dealt by a member that is no class, where there is one, and so meets the count of ``next`` on the way
    other = F.when(~_is_class("next", lists), F.col("next")).when(~_is_class("hist", lists), F.col("hist")).otherwise(_code_of(lists))
    pairs = pairs.withColumn("key", other).repartition("key").groupBy("key", "hist", "next").agg(F.sum("n").alias("n"))
    pairs = pairs.join(words, "key", "left").select("hist", "next", "n", F.when(~_is_class("next", lists), F.col("c")).alias("c_next"))
    pairs = stored(pairs, "pairs")
    d2 = discounts(_counts_of_counts(pairs, "n"))
    spark = docs.sparkSession
    p = np.zeros(lists.n_classes)
    p[2:] = 10 ** uni.log10_p(counts[own])
    ends = counts[keys == END_KEY]
    p[END] = 10 ** uni.log10_p(ends)[0] if len(ends) else 0.0
    prior = spark.createDataFrame(pa.table({"next": np.arange(len(p)), "p": p}))  # 100,002 rows at most
    factor = F.when(F.col("n") > GT_ORDER, 1.0)
    for r, x in enumerate(d2, 1):
        factor = factor.when(F.col("n") == r, x)
    both = pairs.withColumn("dn", factor * F.col("n")).join(F.broadcast(prior), "next", "left")
    both = both.withColumn("p", F.coalesce("p", F.pow(F.lit(10.0), uni.log10_p_of(F.col("c_next")))))
    sums = both.groupBy("hist").agg(F.sum("n").alias("c"), F.sum("dn").alias("dc"), F.sum("p").alias("low"))
    below = F.when(F.col("dc") < F.col("c"), F.col("c")).otherwise(F.col("c") + 1).cast("double")  # a history of large counts alone gives up one
    rest = 1 - F.col("low")
    full = rest <= 1e-12  # it has shown every word: nothing to back off to
    sums = sums.withColumn("below", F.when(full, F.col("dc")).otherwise(below))
    sums = stored(sums.select("hist", "below", F.when(full, 1.0).otherwise((1 - F.col("dc") / F.col("below")) / rest).alias("back")), "histories")
    often = sums.where(_is_class("hist", lists))
    found = often.orderBy("hist").toArrow()
    lists.log_backoff = np.zeros(lists.n_classes)
    lists.log_backoff[found.column("hist").to_numpy()] = np.log10(found.column("back").to_numpy())
    gain = F.log10(F.col("dn") / F.col("below")) - F.log10("back") - F.log10("p")
    met = both.where(_is_class("hist", lists)).join(F.broadcast(often), "hist")
    met = met.unionByName(both.where(~_is_class("hist", lists)).join(sums.where(~_is_class("hist", lists)), "hist"))
    gains = stored(met.select(_code_of(lists).alias("code"), "n", gain.alias("g")), "gains")
    drop(pairs)
    classes = pa.table({"key": np.concatenate(([END_KEY], lists.class_keys)), "b": np.delete(lists.log_backoff, RARE)})
    weights = sums.where(~_is_class("hist", lists)).select(F.col("hist").alias("key"), F.log10("back").alias("b")).union(spark.createDataFrame(classes))
    whole = stored(words.join(weights, "key", "left").select("key", "c", F.coalesce("b", F.lit(0.0)).alias("b")), "words")
    drop(words)
    drop(sums)
    listed = whole.where((F.col("c") >= LIST_SHARE * tokens) | (F.col("key") == END_KEY)).orderBy("key").toArrow()
    lists.key_backoff = listed.column("b").to_numpy()
    top = gains.where(F.col("n") >= LIST_SHARE * max(1, tokens)).orderBy("code").toArrow()
    lists.pair_codes, lists.pair_gain = top.column("code").to_numpy(), top.column("g").to_numpy()
    return Model(lists, whole, gains)


#: What a row of _evidence says: what its key is (or whose sum its val is).
WORD, PAIR, DOC_ID, TOKENS, KNOWN, BASE, SCORE, HELD = 1, 0, -1, -2, -3, -4, -5, -6


def _evidence(batches: Iterator[pa.RecordBatch], lists: Lists) -> Iterator[pa.RecordBatch]:
    """Per text: sums over what the lists know, and (key, count) of each other word and pair.

    ``what`` is 2 n + WORD or 2 n + PAIR with n the count, or one of the negative codes.
    """
    for part in chunks(batches, "text"):
        words, index, keys = _tokens(part)
        n_docs = part.num_rows
        row = part.column("_row").to_numpy()
        at, listed = _found(lists.keys, keys)
        c = np.where(listed, lists.counts[at] if len(lists.counts) else 0, 0)
        ends = lists.counts[lists.keys == END_KEY]
        end = np.array([ends[0] if len(ends) else 0])
        uni = lists.unigrams
        base_of, p_of = np.where(listed, uni.log10_base(c), 0), np.where(listed, uni.log10_p(c), 0)
        if len(lists.keys):  # each word is a history once
            p_of = p_of + np.where(listed, lists.key_backoff[at], 0)
        doc_sum = lambda v: np.bincount(words.doc, weights=v, minlength=n_docs)
        base = doc_sum(base_of[index]) + uni.log10_base(end)[0]
        score = doc_sum(p_of[index]) + uni.log10_p(end)[0] + lists.log_backoff[END]
        known = doc_sum(listed[index].astype(float)) + (end[0] > 0)
        code = _pair_codes(_names(words, index, keys, lists), lists.n_classes)
        token_doc = np.repeat(np.arange(n_docs), words.per_doc + 1)
        at, often = _found(lists.pair_codes, code)
        if len(lists.pair_codes):
            score = score + np.bincount(token_doc, weights=np.where(often, lists.pair_gain[at], 0), minlength=n_docs)

        other = np.flatnonzero(~listed[index]) if len(index) else index
        both, n = np.unique(words.doc[other] * max(1, len(keys)) + index[other], return_counts=True)
        word_rows = (row[both // max(1, len(keys))], keys[both % max(1, len(keys))] if len(keys) else both, 2 * n + WORD)
        other = np.flatnonzero(~often)
        order = np.lexsort((code[other], token_doc[other]))
        d, k = token_doc[other][order], code[other][order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        begin = np.flatnonzero(new)
        pair_rows = (row[d[begin]], k[begin], 2 * np.diff(np.append(begin, len(d))) + PAIR)
        for r, key, what in (word_rows, pair_rows):
            yield _batch(r, key, what, np.zeros(len(r)))
        ids = part.column("doc_id").fill_null(0).to_numpy()
        there = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        none = np.zeros(n_docs)
        yield _batch(row[there], ids[there], np.full(there.sum(), DOC_ID), none[there])
        held = part.column("_held").to_numpy(zero_copy_only=False)
        for what, values in ((TOKENS, words.per_doc + 1.0), (KNOWN, known), (BASE, base), (SCORE, score), (HELD, held.astype(float))):
            yield _batch(row, row, np.full(n_docs, what), values)  # any key that spreads: these rows meet no table


def _batch(row: np.ndarray, key: np.ndarray, what: np.ndarray, val: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(key), pa.array(what.astype(np.int64)), pa.array(val.astype(np.float64))], ["_row", "key", "what", "val"])


def score(docs: DataFrame, model: Model, held: Column) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    ``score`` is the model's log10 probability of the words and the end of the text;
    null and empty texts have the end alone.  All words that training has not shown are
    one event, as in the base score.  Repeated rows are each scored, null ids stay, an
    empty table gives no rows, other columns are not read.  Without training text every
    token is unseen and has probability 1.
    """
    lists, uni = model.lists, model.lists.unigrams
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("_held"))
    source = source.withColumn("_row", F.monotonically_increasing_id())
    rows = source.mapInArrow(partial(_evidence, lists=lists), "_row long, key long, what long, val double")
    kind = F.when(F.col("what") >= 0, F.col("what") % 2).otherwise(F.lit(-1))
    tables = model.words.select(F.lit(WORD).cast("long").alias("kind"), "key", F.col("c").cast("double").alias("x"), "b").union(
        model.gains.select(F.lit(PAIR).cast("long"), F.col("code"), F.col("g"), F.lit(0.0))
    )
    rows = rows.withColumn("kind", kind.cast("long"))
    met = rows.join(tables, ["key", "kind"], "left")
    n = F.floor(F.col("what") / 2)
    c = F.coalesce("x", F.lit(0.0))
    word = lambda value: F.when(F.col("kind") == WORD, n * value)
    said = lambda what: F.when(F.col("what") == what, F.col("val"))
    total = lambda *parts: F.coalesce(F.sum(F.coalesce(*parts)), F.lit(0.0))
    summed = met.groupBy("_row").agg(
        F.max(F.when(F.col("what") == DOC_ID, F.col("key"))).alias("doc_id"),
        (total(said(HELD)) > 0).alias("held_out"),
        F.round(total(said(TOKENS))).cast("long").alias("n_tokens"),
        F.round(total(said(KNOWN), word(F.when(c > 0, 1.0).otherwise(0.0)))).cast("long").alias("n_known"),
        F.lit(uni.tokens).cast("long").alias("train_tokens"),
        F.round(total(said(BASE), word(uni.log10_base_of(c))), 9).alias("base_score"),
        F.round(total(said(SCORE), word(uni.log10_p_of(c) + F.coalesce("b", F.lit(0.0))), F.when(F.col("kind") == PAIR, n * c)), 9).alias("score"),
    )
    return summed.drop("_row")


def held_out() -> Column:
    """Documents that the model doesn't learn from: crc32 of the id as text leaves 0 modulo 10 (null: so)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and Katz scores of every document, learning from those that are not held out."""
    from .katz_corpus import learn_and_score

    return learn_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out())
