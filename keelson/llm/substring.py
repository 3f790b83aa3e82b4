"""Substring dedup: seed and extend over winnowed anchors.

Every window of ``length`` consecutive words has one *anchor*: the least-hashed
``gram``-word run inside it (leftmost if tied), which depends on the words of the
window alone, so equal windows have equal anchors wherever they stand.  Neighbouring
windows share an anchor position; such a run of windows is a *stretch*, the anchor
extended both ways as far as it stays the anchor.  A maximal repeat is a sequence of
equal stretches with at most one partly equal stretch at either end.

1. Anchors that hold an outsized share of all stretches are found first (a bounded
   list, see :func:`hot_anchors`).
2. Stretches are dealt out by anchor.  Of equal ones the first (doc_id, position) stays and
   the others are repeats as a whole.  Where different stretches meet at one anchor,
   their windows are compared one by one: those documents are read again and only
   windows of such stretches are dealt out by content.
3. Windows of hot anchors are dealt out by content at once, so one common line in
   very many texts never gathers in one task.

Before anything is dealt out, a task keeps the first of equal rows it has and marks
the others as repeats itself, so a passage costs one row a task, however many texts
hold it.  Keys are 128 bits (anchor and content hashed independently).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored
from .textops import Words, chunks, mixed, signed, split_words, word_hashes

LENGTH, GRAM = 20, 6
HOT_SHARE, HOT_LEAST = 1e-4, 1000
STRETCH, WINDOW, REPEAT = 0, 1, 2
ROW = "key long, sub long, doc_id long, at long, n int, kind int"
BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Windows:
    """Windows of a chunk: their start words, anchors and stretches."""

    def __init__(self, words: Words, length: int, gram: int):
        index, distinct = words.encode()
        hashes = word_hashes(distinct)[index] if len(words) else np.zeros((0, 2), np.uint64)
        self.words, self.length = words, length
        n = len(words)
        self.start = np.flatnonzero(np.arange(n) + length <= words.first[words.doc + 1])
        if not len(self.start):
            self.anchor = self.anchor_at = self.head = self.size = np.zeros(0, np.int64)
            return
        grams = n - gram + 1
        h = np.zeros(grams, np.uint64)
        for k in range(gram):
            h = h * BASE + hashes[k : k + grams, 0]
        h = mixed(h)
        span = length - gram + 1  # anchors to choose from in a window
        least, at, width = h, np.arange(grams), 1
        while width < span:  # leftmost least of growing runs
            step = min(width, span - width)
            left, right = least[: len(least) - step], least[step:]
            better = right < left
            at = np.where(better, at[step:], at[: len(at) - step])
            least = np.where(better, right, left)
            width += step
        self.anchor, self.anchor_at = least[self.start], at[self.start]
        doc = words.doc[self.start]
        new = np.ones(len(self.start), bool)
        new[1:] = (self.anchor_at[1:] != self.anchor_at[:-1]) | (doc[1:] != doc[:-1])
        self.head = np.flatnonzero(new)  # index of each stretch's first window
        self.size = np.diff(np.append(self.head, len(self.start)))
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE | np.uint64(1)))), dtype=np.uint64)
        self._sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[:, 1] * power[:-1], dtype=np.uint64)))
        back = np.uint64(_inverse(int(BASE | np.uint64(1))))
        self._back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, back))), dtype=np.uint64)

    def content(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``begin`` up to ``end``."""
        return mixed((self._sum[end] - self._sum[begin]) * self._back[begin] + (end - begin).astype(np.uint64))

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, content hash, first window and number of windows of each stretch."""
        begin = self.start[self.head]
        return self.anchor[self.head], self.content(begin, begin + self.size - 1 + self.length), self.head, self.size


def _anchor_shares(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        w = Windows(split_words(part.column("text")), length, gram)
        if not len(w.head):
            continue
        value, count = np.unique(w.anchor[w.head], return_counts=True)
        often = count >= HOT_SHARE / 2 * len(w.head)
        rows = [np.append(signed(value[often]), 0), np.append(count[often], len(w.head)), np.append(np.zeros(often.sum(), bool), True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["anchor", "n", "total"])


def hot_anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Anchors that may hold more than ``HOT_SHARE`` of all stretches (and over ``HOT_LEAST``), as sorted hashes.

    Each chunk names the anchors with half that share of its own stretches.  What the
    other chunks have of an anchor is less than half that share of all, so each anchor
    over the share is named with at least half of it; at most 2 / HOT_SHARE = 20,000
    anchors can be, which bounds this list whatever the input.
    """
    share = docs.mapInArrow(partial(_anchor_shares, length=length, gram=gram), "anchor long, n long, total boolean")
    summed = stored(share.groupBy("anchor", "total").agg(F.sum("n").alias("n")), "anchors")
    total = summed.where("total").agg(F.sum("n")).first()[0] or 0
    least = max(HOT_LEAST, HOT_SHARE * total) / 2
    rows = summed.where(~F.col("total") & (F.col("n") >= least)).select("anchor").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _first_only(key, sub, doc, at, n, kind) -> list[np.ndarray]:
    """Of rows with equal (kind, key, sub) only the first stays as it is; the others become repeats."""
    order = np.lexsort((at, doc, sub, key, kind))
    key, sub, doc, at, n, kind = (x[order] for x in (key, sub, doc, at, n, kind))
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (sub[1:] == sub[:-1]) & (kind[1:] == kind[:-1]) & (kind[1:] != REPEAT)
    kind = np.where(again, REPEAT, kind)
    return [np.where(again, mixed(doc.astype(np.uint64)), key), np.where(again, np.uint64(0), sub), doc, at, n, kind]


def _rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    key, sub, doc, at, n, kind = columns
    arrays = [signed(np.ascontiguousarray(key)), signed(np.ascontiguousarray(sub)), doc, at, n.astype(np.int32), kind.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "sub", "doc_id", "at", "n", "kind"])


def _window_rows(w: Windows, ids: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
    start = w.start[which]
    doc = w.words.doc[start]
    one = np.ones(len(start), np.int64)
    content = w.content(start, start + w.length)
    return [mixed(w.anchor[which] + content), content, ids[doc], start - w.words.first[doc], one, one * WINDOW]


def _seed(batches: Iterator[pa.RecordBatch], hot: np.ndarray, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        w = Windows(split_words(part.column("text")), length, gram)
        if not len(w.head):
            continue
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        anchor, content, head, size = w.stretches()
        is_hot = np.isin(anchor, hot)
        start = w.start[head]
        doc = w.words.doc[start]
        cold = [x[~is_hot] for x in (anchor, content, ids[doc], start - w.words.first[doc], size, np.full(len(size), STRETCH))]
        warm = _window_rows(w, ids, np.flatnonzero(np.repeat(is_hot, size)))
        yield _rows(_first_only(*(np.concatenate(x) for x in zip(cold, warm, strict=True))))


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, kind, sub): repeats (``sure``), and stretches whose windows have to be compared.

    Those are the first of each content where an anchor has several.  A key may hold any
    number of rows: all that is kept from one batch to the next is its last row, and the
    first of its contents while no second one has been seen.
    """
    last, waiting = None, None

    def rows(doc: np.ndarray, at: np.ndarray, n: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(n.astype(np.int32)), pa.array(sure)], ["doc_id", "at", "n", "sure"])

    for batch in batches:
        key, sub, doc, at, n, kind = (batch.column(k).to_numpy() for k in range(6))
        if not len(key):
            continue
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (kind[1:] == kind[:-1])
        again = same.copy()
        again[1:] &= sub[1:] == sub[:-1]
        same[0] = last is not None and last[:2] == (key[0], kind[0])
        again[0] = same[0] and last[2] == sub[0]
        fresh = np.flatnonzero(~again & (kind == STRETCH))  # the first of each content
        several = np.zeros(len(fresh), bool)
        several[1:] = key[fresh[1:]] == key[fresh[:-1]]
        if len(fresh) and waiting is not None and waiting[0] == key[fresh[0]]:
            several[0] = True
            yield rows(*(np.array([x]) for x in waiting[1:]), np.array([False]))
        elif len(fresh) and last is not None and last[:2] == (key[fresh[0]], STRETCH):
            several[0] = True  # its first was sent on before
        ask = np.zeros(len(key), bool)
        ask[fresh] = several
        ask[fresh[:-1]] |= several[1:]
        sure = again | (kind == REPEAT)
        sure &= (kind != STRETCH) | again
        out = sure | ask
        yield rows(doc[out], at[out], n[out], sure[out])
        open_ = len(fresh) and key[fresh[-1]] == key[-1] and kind[-1] == STRETCH
        if open_ and not ask[fresh[-1]]:
            f = fresh[-1]
            waiting = key[f], doc[f], at[f], n[f]
        elif len(fresh) or key[-1] != key[0] or not same[0]:
            waiting = None
        last = key[-1], kind[-1], sub[-1]


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(begin, n), 1)
    np.add.at(step, np.minimum(end, n), -1)
    return np.cumsum(step[:-1]) > 0


def _spans(listed: pa.ListArray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the listed runs of windows, as word positions in the chunk."""
    counts = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    packed = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return (packed >> 16) + np.repeat(first[:-1], counts), packed & 0xFFFF


def _compare(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Windows of the stretches that are listed with each text."""
    for part in chunks(batches, "text"):
        words = split_words(part.column("text"))
        w = Windows(words, length, gram)
        begin, n = _spans(part.column("runs"), words.first)
        wanted = _covered(begin, begin + n, len(words))
        which = np.flatnonzero(wanted[w.start])
        if len(which):
            yield _rows(_first_only(*_window_rows(w, part.column("doc_id").to_numpy(zero_copy_only=False), which)))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted by (key, sub, doc_id, at): all but the first of each content."""
    last = None
    for batch in batches:
        key, sub, doc, at, n, kind = (batch.column(k).to_numpy() for k in range(6))
        if not len(key):
            continue
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (sub[1:] == sub[:-1])
        again[0] = last == (key[0], sub[0])
        last = key[-1], sub[-1]
        sure = (again & (kind == WINDOW)) | (kind == REPEAT)
        arrays = [doc[sure], at[sure], n[sure].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["doc_id", "at", "n"])


def _runs(rows: DataFrame) -> DataFrame:
    """Runs of windows by document, each packed as position * 65536 + count (a stretch has few windows)."""
    packed = (F.col("at") * 65536 + F.col("n")).alias("run")
    return rows.groupBy("doc_id").agg(F.collect_list(packed).alias("runs"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, runs)``: windows of ``docs(doc_id, text)`` whose words also start earlier.

    doc_id has to be non-null and tell rows apart.
    """
    hot = hot_anchors(docs, length, gram)
    options = {"length": length, "gram": gram}
    seeds = docs.mapInArrow(partial(_seed, hot=hot, **options), ROW)
    by_anchor = seeds.repartition("key").sortWithinPartitions("key", "kind", "sub", "doc_id", "at")
    met = stored(by_anchor.mapInArrow(_extend, "doc_id long, at long, n int, sure boolean"), "stretches")
    asked = docs.join(_runs(met.where("not sure")), "doc_id")
    compared = asked.mapInArrow(partial(_compare, **options), ROW)
    by_content = compared.repartition("key", "sub").sortWithinPartitions("key", "sub", "doc_id", "at")
    later = by_content.mapInArrow(_later, "doc_id long, at long, n int")
    return _runs(met.where("sure").select("doc_id", "at", "n").union(later))


def _kept(part: pa.RecordBatch, runs: str, length: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words, removed words and what stays of each text of a chunk with its listed runs."""
    words = split_words(part.column("text"))
    begin, n = _spans(part.column(runs), words.first)
    gone = _covered(begin, begin + n + length - 1, len(words))
    text, opens, closes = words.spaced()
    removed = np.bincount(words.doc[gone], minlength=words.n_docs)
    kept = []
    for d in range(words.n_docs):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if not removed[d]:
            kept.append(text[opens[a] : closes[b - 1]] if b > a else b"")
        else:
            kept.append(b" ".join([text[opens[k] : closes[k]] for k in range(a, b) if not gone[k]]))
    return words.per_doc, removed, [k.decode() for k in kept]


def _strip(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        n_words, removed, kept = _kept(part, "_runs", length)
        arrays = [part.column("_id"), pa.array(n_words), pa.array(removed), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["_id", "n_words", "n_removed", "kept"])


def _rewrite(batches: Iterator[pa.RecordBatch], runs: str, length: int) -> Iterator[pa.RecordBatch]:
    """Texts that lost words are replaced by what stays; texts that lost all go."""
    for part in chunks(batches, "text"):
        n_words, removed, kept = _kept(part, runs, length)
        old = part.column("text").to_pylist()
        text = pa.array([k if r else t for k, r, t in zip(kept, removed, old, strict=True)], part.schema.field("text").type)
        columns = {name: part.column(name) for name in part.schema.names if name != runs} | {"text": text}
        yield pa.RecordBatch.from_pydict(columns).filter(pa.array((removed == 0) | (removed < n_words)))


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells rows apart and sorts as (doc_id, text) do, null ids last: doc_id, if it does."""
    unique = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()
    if unique and docs.schema["doc_id"].dataType.simpleString() == "bigint":
        return docs.where("doc_id is not null"), "doc_id"
    key = _fresh(docs, "_key")
    in_order = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn(key, F.monotonically_increasing_id())
    return stored(in_order, "keyed").where(F.col(key).isNotNull()), key


def _with_runs(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, str]:
    """``docs`` with the runs of repeated windows of each row, and the name of that column.

    Where ``docs`` is (doc_id, text), both joins to it have one shuffle, which Spark reuses.
    """
    keyed, key = _keyed(docs)
    runs, at = _fresh(keyed, "_runs"), _fresh(keyed, "_at")
    found = repeated_windows(keyed.select(F.col(key).alias("doc_id"), "text"), length, gram)
    found = found.select(F.col("doc_id").alias(at), F.col("runs").alias(runs))
    return keyed.join(found, keyed[key] == found[at], "left").select(*docs.columns, runs), runs


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row; ``kept`` is the words that stay, one space between.

    A word goes if a window of ``length`` words covers it whose sequence also starts
    earlier: in a smaller doc_id, or earlier in the same text.  Windows are judged on
    the input.  Null and empty texts, and those shorter than a window, lose nothing
    (null: no words, ``kept`` empty).  Rows with a null doc_id come after all others
    and rows that share a doc_id after each other, in the order of their text, so of
    repeated rows the first keeps its words.  An empty table gives no rows.  Columns
    other than doc_id and text are not read and not returned.
    """
    joined, _ = _with_runs(docs.select("doc_id", "text"), length, gram)
    joined = joined.select(F.col("doc_id").cast("long").alias("_id"), "text", "_runs")
    out = joined.mapInArrow(partial(_strip, length=length), "_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("_id", "doc_id")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated windows cut from ``text``, by the rules of :func:`strip_repeats`; other columns as they were.

    Texts that lose nothing keep their white space; what is left of others has one space
    between words; rows that lose all their words go.
    """
    joined, runs = _with_runs(docs, length, gram)
    return joined.mapInArrow(partial(_rewrite, runs=runs, length=length), docs.schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stay after repeated windows of 20 words are removed."""
    out = strip_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
