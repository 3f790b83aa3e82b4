"""Token counts by prefix dynamic programming.

``at[k]`` is the exact number of tokens of the first ``k`` characters of a text, stored
for every ``k``.  The tokenizer drops white space and never joins text across it, nor
across the pieces it cuts a word into, so a prefix costs the whole pieces before the
cut plus the count of the cut piece.

Within a piece of up to ``SHORT`` bytes the library counts each prefix once and words
share it.  In a longer one, where that would cost the square of its length, the counts
come from a program over its prefixes.  Byte pairs have the property that a tokenization
without its last token is the tokenization of what is left, and that a sequence is one
if all its neighbours are, each pair by itself.  So the last token of each prefix is the
suffix that is a token and a valid neighbour of the last token before it, and its count
is the one found there plus one.  The token that ends a piece has a form of its own and
is found the same way.  Pairs are judged by the library and remembered.

Words with other characters than ``PLAIN`` (or a special string) are cut into the same
pieces by the library's own normaliser and pre-tokeniser, so they too cost their length,
whatever that is.  A cut inside characters that compose changes the last ones only, and
the program goes on from the state before them.  With tokenizers of another make the
library encodes every prefix of a word, a bounded number of characters together.

Budgets and truncation are then answered by look-up (:func:`tokens_at`, :func:`fits`,
:func:`tokens_of_prefix`, :func:`longest_prefix`), never by encoding again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import NORMALIZERS, PATTERN, PIECE, PLAIN, byte_names, load
from .textops import chunks, raw_text, split_words

MAX_TOKENS = 2048
MEMO_WORDS = 400_000  # distinct words that a task remembers; more are counted again
SHORT = 32  # bytes of the prefixes that words share, counted by the library once each
WORD_END = "</w>"
ROW = "doc_id long, n_bytes long, ends array<long>, counts array<long>, at array<int>"
MEMO_CHARS = 8_000_000  # prefixes that a task remembers
AT_ONCE = 1 << 20  # characters encoded together


def _lengths(tokenizer, words: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class _Pieces:
    """Counts at every character of a piece, by the program over its prefixes."""

    def __init__(self, tokenizer, model: dict):
        from tokenizers.models import BPE

        self._names = byte_names()
        self._inner = {t for t in model["vocab"] if not t.endswith(WORD_END)}
        self._final = {t.removesuffix(WORD_END) for t in model["vocab"] if t.endswith(WORD_END)}
        self._reach: dict[str, int] = {}  # how long a token with these last three characters can be
        self._longest = max(map(len, self._inner | self._final), default=2)
        for t in self._inner | self._final:
            self._reach[t[-3:]] = max(len(t), self._reach.get(t[-3:], 2))
        self._ending = tokenizer.model
        self._plain = BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self._pairs: dict[tuple[str, str], bool] = {}
        self._ends: dict[tuple[str, str], bool] = {}
        self._short: dict[str, int] = {"": 0}

    def _neighbours(self, a: str, b: str) -> bool:
        if not a:
            return True
        got = self._pairs.get((a, b))
        if got is None:
            got = self._pairs[a, b] = [t.value for t in self._plain.tokenize(a + b)] == [a, b]
        return got

    def _ending_pair(self, a: str, b: str) -> bool:
        got = self._ends.get((a, b))
        if got is None:
            got = self._ends[a, b] = [t.value for t in self._ending.tokenize(a + b)] == ([a, b + WORD_END] if a else [b + WORD_END])
        return got

    def _step(self, text: str, at: int, every: list[tuple[str, int, int]]) -> tuple[str, int, int]:
        """Last inner token and count of ``text[:at]``, and its count as a whole piece; ``every`` holds those of all shorter prefixes."""
        inner = final = None
        for size in range(min(at, self._reach.get(text[at - 3 : at], 2) if at > 2 else at), 0, -1):
            token = text[at - size : at]
            last, n, _ = every[at - size]
            if inner is None and token in self._inner and self._neighbours(last, token):
                inner = token, n + 1
            if final is None and token in self._final and self._ending_pair(last, token):
                final = n + 1
            if inner and final:
                break
        return (*inner, final)

    def counts(self, piece: str) -> list[int]:
        """Tokens of ``piece[:k]`` for k from 1, for a piece that is one at every cut."""
        if piece.isascii() and piece.isprintable():
            text, cuts = piece, range(1, len(piece) + 1)
        else:
            raw = [c.encode() for c in piece]
            text = "".join([self._names[b] for c in raw for b in c])
            cuts = list(accumulate(map(len, raw)))
        short, tokenize = self._short, self._ending.tokenize
        known = here = min(len(text), SHORT)
        while text[:known] not in short:
            known -= 1
        for at in range(known + 1, here + 1):
            short[text[:at]] = len(tokenize(text[:at]))
        if here == len(text):
            return [short[text[:k]] for k in cuts]
        every = self.program(text)
        return [every[k][2] for k in cuts]

    def program(self, text: str) -> list[tuple[str, int, int]]:
        """The states of all prefixes of byte symbols."""
        every = [("", 0, 0)]
        for at in range(1, len(text) + 1):
            every.append(self._step(text, at, every))
        return every

    def symbols(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() else "".join([self._names[b] for b in text.encode()])

    def and_more(self, text: str, every: list[tuple[str, int, int]], at: int, more: str) -> int:
        """Tokens of ``text[:at] + more``, from the states of ``text``."""
        low = max(0, at - self._longest)
        text, states = text[low:at] + more, every[low : at + 1]
        for k in range(at - low + 1, len(text) + 1):
            states.append(self._step(text, k, states))
        return states[-1][2]

    def forget(self) -> None:
        if len(self._short) > 2 * MEMO_WORDS:
            self._short = {"": 0}
        if len(self._pairs) + len(self._ends) > 2 * MEMO_WORDS:
            self._pairs, self._ends = {}, {}


def _composing(text: str) -> list[str]:
    """The text in groups, each a character and those after it that may join with it or change places."""
    joins = lambda c: unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ"  # noqa: E731  marks, vowels and finals of Hangul
    out: list[str] = []
    for c in text:
        if out and joins(c):
            out[-1] += c
        else:
            out.append(c)
    return out


class _Counter:
    """Counts at every prefix of distinct words, remembered by word."""

    def __init__(self, path: str):
        self._tokenizer = load(path)
        made = json.loads(self._tokenizer.to_str())
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        cut = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        own = made["model"].get("type") == "BPE" and made["model"].get("end_of_word_suffix") == WORD_END and not made["model"].get("dropout")
        self._pieces = _Pieces(self._tokenizer, made["model"]) if own and steps == NORMALIZERS and cut == [PATTERN, None] else None
        self._special = [x["content"] for x in made["added_tokens"]]
        self._split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self._special, key=lambda x: (-len(x), x))) + ")") if self._special else None
        self._one: dict[str, str] = {}  # characters as normalised by themselves
        self._clear()

    def _clear(self) -> None:
        self._word: dict[bytes, int] = {}
        self._flat, self._sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self._piece: dict[str, int] = {}
        self._piece_counts: list[array] = []
        self._piece_chars = 0

    def table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words, and where each number's counts begin and what they are, end to end."""
        new = [w for w in words if w not in self._word]
        if len(self._word) + len(new) > MEMO_WORDS or len(self._flat[0]) + self._piece_chars > MEMO_CHARS:
            self._clear()
            new = words
            if self._pieces:
                self._pieces.forget()
        texts = [w.decode() for w in new]
        plain = [bool(self._pieces) and PLAIN.fullmatch(t) is not None and not any(x in t for x in self._special) for t in texts]
        for some, count in (([t for t, ok in zip(texts, plain, strict=True) if ok], self._by_piece), ([t for t, ok in zip(texts, plain, strict=True) if not ok], self._by_rule if self._pieces else self._by_library)):
            if some:
                flat, sizes = count(some)
                self._flat.append(flat)
                self._sizes.append(sizes)
        base = len(self._word)
        order = [w for w, ok in zip(new, plain, strict=True) if ok] + [w for w, ok in zip(new, plain, strict=True) if not ok]
        self._word.update(zip(order, range(base, base + len(order)), strict=True))
        self._flat, self._sizes = [np.concatenate(self._flat)], [np.concatenate(self._sizes)]
        begin = np.concatenate(([0], np.cumsum(self._sizes[0])))
        return np.array([self._word[w] for w in words], np.int64), begin, self._flat[0]

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, some, size = array("i"), [], 0
        for t in texts:
            for k in range(1, len(t) + 1):
                some.append(t[:k])
                size += k
                if size >= AT_ONCE:
                    counts.extend(_lengths(self._tokenizer, some))
                    some, size = [], 0
        counts.extend(_lengths(self._tokenizer, some))
        return np.array(counts, np.int32), np.array([len(t) for t in texts], np.int64)

    def _by_rule(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words with any characters and special strings, each of which is a token of its own once it is whole."""
        out = array("i")
        for text in texts:
            base, parts = 0, self._split.split(text) if self._split else [text]
            for k in range(0, len(parts), 2):
                special = parts[k + 1] if k + 1 < len(parts) else ""
                counts = self._any_counts(parts[k] + special[:-1])
                out.extend([base + n for n in counts])
                if special:
                    base += (counts[len(parts[k]) - 1] if parts[k] else 0) + 1
                    out.append(base)
        return np.array(out, np.int32), np.array([len(t) for t in texts], np.int64)

    def _normal(self, text: str) -> str:
        return self._tokenizer.normalizer.normalize_str(text)

    def _cut(self, normal: str) -> list[tuple[int, int]]:
        """Where the pieces of a normalised text begin and end."""
        return [at for _, at in self._tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _any_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:k]`` for k from 1, special strings read as plain text."""
        one = self._one
        for c in set(text) - one.keys():
            one[c] = self._normal(c)
        groups = list(text)
        if re.sub(" +", " ", "".join([one[c] for c in groups])) != self._normal(text):
            groups = _composing(text)
        normal = [one[g] if len(g) == 1 else self._normal(g) for g in groups]
        whole = "".join(normal)
        pieces = self._cut(whole)
        upto = np.zeros(len(whole) + 1, np.int64)  # of the normalised text
        base = 0
        for a, b in pieces:
            counts = self._piece_list(whole[a:b])
            upto[a + 1 : b + 1] = np.add(counts, base)
            base += counts[-1]
        inside = np.zeros(len(upto), bool)
        for a, b in pieces:
            inside[a + 1 : b + 1] = True
        last = np.maximum.accumulate(np.where(inside, np.arange(len(upto)), 0))
        upto = upto[last]  # white space in a word adds nothing
        out: list[int] = []
        at, number, states = 0, 0, None
        for g, n in zip(groups, normal, strict=True):
            for k in range(1, len(g)):  # a cut inside characters that compose
                while number < len(pieces) and pieces[number][1] < at:
                    number, states = number + 1, None
                a = pieces[number][0] if number < len(pieces) and pieces[number][0] < at else at
                if states is None and a < at:
                    symbols = self._pieces.symbols(whole[a : pieces[number][1]])
                    states = symbols, self._pieces.program(symbols), [0, *accumulate(len(c.encode()) for c in whole[a : pieces[number][1]])]
                tail = self._normal(g[:k])
                if 0 < a and at - a < 2 and number and pieces[number - 1] == (a - 1, a) and whole[a - 1] == "'":  # may become 're and the like
                    out.append(int(upto[a - 1]) + sum(self._piece_list((whole[a - 1 : at] + tail)[x:y])[-1] for x, y in self._cut(whole[a - 1 : at] + tail)))
                else:
                    out.append(self._with_tail(whole, a, at, tail, int(upto[at]), int(upto[a]), states))
            at += len(n)
            out.append(int(upto[at]))
        return out

    def _with_tail(self, whole: str, a: int, at: int, tail: str, upto: int, before: int, states) -> int:
        """Tokens of ``whole[:at] + tail``; a piece goes from ``a`` to ``at`` or beyond, and ``before`` counts what is before it."""
        near = whole[max(a, at - 8) : at]
        first = 0
        cut = self._cut(near + tail)
        if near and cut and cut[0][1] > len(near):
            more = (near + tail)[len(near) : cut[0][1]]
            symbols, program, offsets = states
            upto = before + self._pieces.and_more(symbols, program, offsets[at - a], self._pieces.symbols(more))
            first = 1
        elif near:
            first = 1
        return upto + sum(self._piece_list((near + tail)[x:y])[-1] for x, y in cut[first:])

    def _piece_list(self, piece: str) -> list[int]:
        """Tokens at every character of a piece; 's and the like are two pieces when cut short."""
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            return [sum(self._pieces.counts(x)[-1] for x in PIECE.findall(piece[:k])) for k in range(1, len(piece))] + self._pieces.counts(piece)[-1:]
        return self._pieces.counts(piece)

    def _by_piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = PIECE.findall("\n".join(texts).lower() + "\n")
        for p in set(flat) - self._piece.keys() - {"\n"}:
            self._piece[p] = len(self._piece_counts)
            self._piece_counts.append(array("i", self._piece_list(p)))
            self._piece_chars += len(p)
        index = np.array([self._piece.get(p, -1) for p in flat], np.int64)
        used, inverse = np.unique(index[index >= 0], return_inverse=True)
        lists = [self._piece_counts[k] for k in used.tolist()]
        size = np.array([len(x) for x in lists], np.int64)
        pool = np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))
        start = np.cumsum(size) - size
        word = np.cumsum(index < 0)[index >= 0]
        whole = pool[start + size - 1][inverse].astype(np.int64)
        before = np.cumsum(whole) - whole
        before -= before[np.searchsorted(word, word)]  # from the word's first piece
        n = size[inverse]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        counts = pool[np.repeat(start[inverse], n) + at] + np.repeat(before, n)
        return counts.astype(np.int32), np.bincount(word, weights=n, minlength=len(texts)).astype(np.int64)


def _prefix_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _Counter(path)
    for part in chunks(batches, "text"):
        column = part.column("text")
        words = split_words(column)
        index, distinct = words.encode()
        number, begin, pool = counter.table(distinct)
        own = number[index] if len(index) else index
        size = begin[own + 1] - begin[own]  # characters of each word
        each = pool[begin[own + 1] - 1].astype(np.int64) if len(own) else own
        running = np.cumsum(each)
        before = np.concatenate(([0], running))
        start = before[words.first[:-1]]
        counts = running - np.repeat(start, words.per_doc)
        raw, off = raw_text(column)
        ends = _word_ends(column) - off[words.doc]
        # one entry for each character of each text, and one for none: what the words before it hold, plus its own
        opens = (raw & 0xC0) != 0x80
        chars = np.concatenate(([0], np.cumsum(opens)))[off]
        black = opens & (raw != 32) & ~((raw >= 9) & (raw <= 13))
        word = np.cumsum(np.bincount((np.concatenate(([0], np.cumsum(opens)))[ends + off[words.doc]]) if len(ends) else np.zeros(0, np.int64), minlength=int(opens.sum()) + 1))[: int(opens.sum())]
        at = before[word]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at[black[opens]] += pool[np.repeat(begin[own], size) + inside] if len(own) else 0
        at -= np.repeat(start, np.diff(chars))
        at = np.insert(at, chars[:-1], 0)
        rows = pa.array(words.first.astype(np.int32))
        lists = [pa.ListArray.from_arrays(rows, pa.array(x)) for x in (ends, counts)]
        lists.append(pa.ListArray.from_arrays(pa.array((chars + np.arange(len(chars))).astype(np.int32)), pa.array(at.astype(np.int32))))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off)), *lists], ["doc_id", "n_bytes", "ends", "counts", "at"])


def _word_ends(column: pa.Array) -> np.ndarray:
    """Byte after each word, over the bytes of all texts."""
    raw, off = raw_text(column)
    if not len(raw):
        return np.zeros(0, np.int64)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    opens = np.zeros(len(raw) + 1, bool)
    opens[off] = True
    return np.flatnonzero(~white & (np.concatenate((white[1:], [True])) | opens[1:])) + 1


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_bytes, ends, counts, at)``: the exact token count at every prefix of every text.

    ``at`` has an entry for each number of characters from 0; ``counts`` and ``ends`` pick
    out the ends of words, with the byte of each.  ``path`` is a vocabulary file of the ``tokenizers`` library whose normaliser and
    pre-tokeniser drop white space.  Special strings inside a text become their special
    token, the library's default; nothing is added, cut or padded.  Null texts count as
    empty (no words, ``at`` is 0 alone); repeated rows are each returned; null ids stay; an empty table
    gives no rows; other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(partial(_prefix_batches, path=path), ROW)


def total(counts: Column) -> Column:
    """Tokens of a whole text."""
    return F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0).cast("long"))


def tokens_at(counts: Column, words: int) -> Column:
    """Tokens of the first ``words`` words (of all, if there are fewer)."""
    at = F.least(F.size(counts), F.lit(words))
    return F.coalesce(F.try_element_at(counts, F.nullif(at, F.lit(0))), F.lit(0).cast("long"))


def fits(ends: Column, counts: Column, budget: int) -> Column:
    """Bytes of the longest prefix of whole words with ``budget`` tokens at most."""
    n = F.size(F.filter(counts, lambda c: c <= budget))
    return F.coalesce(F.try_element_at(ends, F.nullif(n, F.lit(0))), F.lit(0).cast("long"))


def tokens_of_prefix(at: Column, n_chars: int | Column) -> Column:
    """Tokens of the first ``n_chars`` characters (of all, if there are fewer)."""
    return F.get(at, F.least(F.size(at) - 1, F.lit(n_chars) if isinstance(n_chars, int) else n_chars))


def longest_prefix(at: Column, budget: int) -> Column:
    """Characters of the longest prefix with ``budget`` tokens at most; a longer prefix can have fewer tokens than a shorter one."""
    return F.array_max(F.transform(at, lambda n, k: F.when(n <= budget, k)))


class PrefixCounts:
    """Exact counts at every character prefix of one text."""

    def __init__(self, text: str, path: str):
        batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text])], ["doc_id", "text"])
        self._at = [0]
        for out in _prefix_batches(iter([batch]), path):
            self._at = out.column("at")[0].as_py()

    def at(self, n_chars: int) -> int:
        """Tokens of ``text[:n_chars]``."""
        return self._at[min(n_chars, len(self._at) - 1)]


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    found = prefix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
    n = found.select("doc_id", "n_bytes", F.element_at("at", -1).cast("long").alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)
