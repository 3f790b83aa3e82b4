"""Quality rules by distribution divergence.

A document's histogram of character classes and of common words is compared with the
reference of its language by Jensen-Shannon distance (base 2, so 0 to 1).  A rule only
speaks above a minimum length, and allows for the distance that sampling alone gives a
text of that length.

References come from all documents, by the ``lang`` column.  The common words of a
language are exactly those with a share of ``COMMON`` or more of its words.  They are
found without shuffling the vocabulary: each chunk names the words with half that share
of its own, whose sums leave at most 2 / COMMON candidates a language, and a second pass
counts those exactly.  Every language with ``MIN_REFERENCE_WORDS`` words has a reference,
whatever its share of the documents; of others, and of documents without a language, the
rules say nothing.  References travel with tasks, those of ``SHARD`` languages at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop, stored
from .textops import Words, chunks, raw_text, split_words

COMMON = 1 / 500
MAX_WORD_BYTES = float("inf")  # longer words are never common; none is, unless a caller sets this
#: At so many words sampling moves a reference by 0.03 at most (WORD_SLACK over the root), a tenth of what is allowed.
MIN_REFERENCE_WORDS, SHARD = 10_000, 200
MIN_CHARS, MIN_WORDS = 200, 80
#: Distance that is always allowed, and what is allowed on top for a text of one character or word.
MAX_CLASS_DISTANCE, CLASS_SLACK = 0.25, 1.0
MAX_WORD_DISTANCE, WORD_SLACK = 0.25, 2.7
SYMBOLS = b"#*$%&|<>"

N_CLASSES = 12


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes have none (-1), so a character counts once."""
    t = np.full(256, 8, np.int64)  # other ASCII
    t[ord("a") : ord("z") + 1] = 0
    t[ord("A") : ord("Z") + 1] = 1
    t[ord("0") : ord("9") + 1] = 2
    t[32] = 3
    t[9:14] = 4
    for c in b".,;:'-\"":
        t[c] = 5
    for c in b"!?()":
        t[c] = 6
    for c in SYMBOLS:
        t[c] = 7
    t[128:192] = -1
    t[192:208] = 9  # two-byte characters: Latin
    t[208:224] = 10  # two-byte characters: other alphabets
    t[224:] = 11
    return t


CLASS_OF = _class_table()


@dataclass
class Reference:
    classes: np.ndarray  # shares
    words: dict[bytes, int]  # common word -> index from 1; 0 stands for all others
    shares: np.ndarray  # of all others, then of each common word


def class_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Characters of each class in each text: (texts, N_CLASSES)."""
    n = len(off) - 1
    kind = CLASS_OF[raw]
    doc = np.repeat(np.arange(n), np.diff(off))
    seen = kind >= 0
    return np.bincount(doc[seen] * N_CLASSES + kind[seen], minlength=n * N_CLASSES).reshape(n, N_CLASSES)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, by row; rows of ``p`` without mass give 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def _named_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and language: documents (kind d), words (w), characters of each class (c), words with half the share (k)."""
    for part in chunks(batches, "text"):
        words = split_words(part.column("text"))
        index, distinct = words.encode()
        lang = part.column("lang").dictionary_encode()
        code = lang.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        classes = class_counts(*raw_text(part.column("text")))
        short = np.array([len(w) <= MAX_WORD_BYTES for w in distinct], bool)
        rows: list[tuple] = []
        for k, name in enumerate(lang.dictionary.to_pylist()):
            own = code == k
            mine = index[own[words.doc]] if len(words) else index
            rows += [(name, "d", b"", int(own.sum())), (name, "w", b"", len(mine))]
            rows += [(name, "c", str(c).encode(), int(n)) for c, n in enumerate(classes[own].sum(axis=0)) if n]
            n = np.bincount(mine, minlength=len(distinct))
            rows += [(name, "k", distinct[w], int(n[w])) for w in np.flatnonzero((n > 0) & (n >= COMMON / 2 * len(mine)) & short)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "kind", "word", "n"])


def _count_candidates(batches: Iterator[pa.RecordBatch], candidates: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
    totals = {lang: np.zeros(len(words), np.int64) for lang, words in candidates.items()}
    for part in chunks(batches, "text"):
        words = split_words(part.column("text"))
        index, distinct = words.encode()
        place = {w: k for k, w in enumerate(distinct)}
        lang = np.array(part.column("lang").to_pylist(), object)
        for name, wanted in candidates.items():
            own = lang == name
            if own.any() and len(words):
                n = np.append(np.bincount(index[own[words.doc]], minlength=len(distinct)), 0)
                totals[name] += n[[place.get(w, -1) for w in wanted]]
    rows = [(lang, w, int(n)) for lang, words in candidates.items() for w, n in zip(words, totals[lang], strict=True) if n]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "word", "n"])


def _shards(names: list[str]) -> list[list[str]]:
    return [names[k : k + SHARD] for k in range(0, len(names), SHARD)]


def references(docs: DataFrame) -> dict[str, Reference]:
    """The reference of each language with enough words in ``docs(text, lang)``."""
    named = docs.where("lang is not null").mapInArrow(_named_words, "lang string, kind string, word binary, n long")
    table = stored(named.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "shares")
    n_words = {r["lang"]: r["n"] for r in table.where((F.col("kind") == "w") & (F.col("n") >= MIN_REFERENCE_WORDS)).collect()}
    langs = sorted(n_words)
    sizes = table.where((F.col("kind") == "w") & (F.col("n") >= MIN_REFERENCE_WORDS)).select("lang", F.col("n").alias("of"))
    named_often = table.where("kind = 'k'").join(sizes, "lang").where(F.col("n") >= COMMON / 2 * F.col("of"))
    out = {}
    for shard in _shards(langs):
        classes = {lang: np.zeros(N_CLASSES) for lang in shard}
        for r in table.where((F.col("kind") == "c") & F.col("lang").isin(shard)).collect():
            classes[r["lang"]][int(bytes(r["word"]))] = r["n"]
        candidates: dict[str, list[bytes]] = {lang: [] for lang in shard}
        for r in named_often.where(F.col("lang").isin(shard)).select("lang", "word").collect():  # at most 2 / COMMON words each
            candidates[r["lang"]].append(bytes(r["word"]))
        candidates = {lang: sorted(words) for lang, words in candidates.items()}
        counted = docs.where(F.col("lang").isin(shard)).mapInArrow(partial(_count_candidates, candidates=candidates), "lang string, word binary, n long")
        found: dict[str, dict[bytes, int]] = {lang: {} for lang in shard}
        for r in counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
            if r["n"] >= COMMON * n_words[r["lang"]]:
                found[r["lang"]][bytes(r["word"])] = r["n"]
        for lang in shard:
            words = sorted(found[lang])
            n = np.array([found[lang][w] for w in words], float)
            shares = np.concatenate(([max(0.0, n_words[lang] - n.sum())], n)) / max(1, n_words[lang])
            out[lang] = Reference(classes[lang] / max(1.0, classes[lang].sum()), {w: k + 1 for k, w in enumerate(words)}, shares)
    drop(table)
    return out


def repeat_words(words: Words, index: np.ndarray, span: int = 3) -> np.ndarray:
    """By text: words inside windows of ``span`` words that the text holds twice or more."""
    n = len(words)
    out = np.zeros(words.n_docs, np.int64)
    start = np.flatnonzero(np.arange(n) + span <= words.first[words.doc + 1]) if n else np.zeros(0, np.int64)
    if not len(start):
        return out
    code = words.doc[start]  # pairs of codes are renumbered step by step, so they stay exact
    for k in range(span):
        code = np.unique(code * (index.max() + 1) + index[start + k], return_inverse=True)[1]
    twice = start[np.bincount(code)[code] > 1]
    inside = np.zeros(n, bool)
    for k in range(span):
        inside[twice + k] = True
    return np.bincount(words.doc[inside], minlength=words.n_docs)


_WORDY = regex.compile(r"[^\x20\x09-\x0D]")


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _WORDY.search(x)]
    return len(lines) - len(set(lines))


def _judge(batches: Iterator[pa.RecordBatch], refs: dict[str, Reference]) -> Iterator[pa.RecordBatch]:
    is_symbol = np.isin(np.arange(256), list(SYMBOLS))
    leads = (np.arange(256) & 0xC0) != 0x80
    for part in chunks(batches, "text"):
        column = part.column("text")
        raw, off = raw_text(column)
        n = len(column)
        words = split_words(column)
        index, distinct = words.encode()
        doc = np.repeat(np.arange(n), np.diff(off))
        classes = class_counts(raw, off)
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        word_chars = np.bincount(doc[leads[raw] & ~white], minlength=n)
        symbols = np.bincount(doc[is_symbol[raw]], minlength=n)
        dup_lines = np.array([_repeated_lines(t) if t and "\n" in t else 0 for t in column.to_pylist()], np.int64)
        again = repeat_words(words, index)
        n_words = words.per_doc
        failed = (n_words < 50) | (100 * again > 50 * n_words)
        lang = np.array(part.column("lang").to_pylist(), object)
        by_class, by_word = np.zeros(n), np.zeros(n)  # no reference, no objection
        for name, ref in refs.items():
            mine = lang == name
            if not mine.any():
                continue
            place = np.array([ref.words.get(w, 0) for w in distinct], np.int64)
            some = mine[words.doc] if len(words) else np.zeros(0, bool)
            k = len(ref.shares)
            counts = np.bincount(words.doc[some] * k + place[index[some]], minlength=n * k).reshape(n, k)
            by_class[mine] = js_distance(classes[mine], ref.classes)
            by_word[mine] = js_distance(counts[mine], ref.shares)
        chars = classes.sum(axis=1)
        odd = (chars >= MIN_CHARS) & (by_class > MAX_CLASS_DISTANCE + CLASS_SLACK / np.sqrt(np.maximum(chars, 1)))
        odd |= (n_words >= MIN_WORDS) & (by_word > MAX_WORD_DISTANCE + WORD_SLACK / np.sqrt(np.maximum(n_words, 1)))
        longs = [n_words, word_chars, symbols, dup_lines, again]
        arrays = [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in longs), pa.array(failed), pa.array(~failed & ~odd), pa.array(by_class), pa.array(by_word)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"])


ROW = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge_quality(docs: DataFrame, refs: dict[str, Reference] | None = None) -> DataFrame:
    """Counts, distances and verdict for every row of ``docs(doc_id, text, lang)``.

    A null or empty text has no words and fails the base rule.  A document whose lang
    is null, or has no reference, has distances of 0: only the base rule judges it.
    Repeated rows are judged alike, null ids stay, an empty table gives no rows, other
    columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    refs = references(source.select("text", "lang")) if refs is None else refs
    shards = _shards(sorted(refs))
    if len(shards) < 2:
        return source.mapInArrow(partial(_judge, refs=refs), ROW)
    parts = [source.where(F.col("lang").isin(shard)).mapInArrow(partial(_judge, refs={x: refs[x] for x in shard}), ROW) for shard in shards]
    rest = source.where(~F.coalesce(F.col("lang").isin(sorted(refs)), F.lit(False)))
    return reduce(DataFrame.union, parts, rest.mapInArrow(partial(_judge, refs={}), ROW))


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the divergence rules for every document."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
