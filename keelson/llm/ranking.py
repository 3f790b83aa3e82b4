"""Ranked lexical search by Fagin's threshold algorithm.

The forward index is a stored table: a row for each text, with the codes and counts of
the query terms it holds and its number of terms.  Statistics of the whole corpus come
from that table.  Each task then takes its rows a block of bounded size at a time, turns
them into one list a term, sorted by falling impact, and answers every item there: the
lists of the item's terms are read round-robin, ``STEP`` entries of each a round at
first and twice as many in each round that follows; every text met is scored in full
through the forward index; and reading stops when the threshold, the sum of the impacts
last read, falls strictly below the score of the item's k-th best text.  The best of
earlier blocks stay in force for later ones.  The best of all tasks meet in two steps.

Impacts are whole numbers, so scores are exact and equal scores are ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from math import floor, isqrt, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored
from .textops import chunks, raw_text

TOP = 50
STEP = 64  # entries of each list in the first round
BLOCK_POSTINGS = 2_000_000  # of the forward index in memory, or one text's
SHARD_BYTES, SHARD_ITEMS = 16 << 20, 20_000
#: Bytes of terms: letters and digits of ASCII, and all of any other character.
TERM_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"
HITS = "item int, doc_id long, score long"


def terms_in(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts, end to end, and the text that each is of."""
    raw, off = raw_text(column)
    black = np.append(TERM_BYTE[raw], False)
    opens = np.zeros(len(raw) + 1, bool)
    opens[off] = True
    before = np.append(True, ~black[:-1])
    begin = np.flatnonzero(black & (before | opens))
    end = np.flatnonzero(black[:-1] & (~black[1:] | opens[1:])) + 1
    flat = LOWER[raw[black[:-1]]]
    ends = np.append(0, np.cumsum(end - begin)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    return terms, np.searchsorted(off, begin, side="right") - 1


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        terms, owner = terms_in(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(owner)), terms], ["item_id", "term"])


def _forward(batches: Iterator[pa.RecordBatch], codes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of the forward index; texts without terms are left out."""
    for part in chunks(batches, "text"):
        terms, owner = terms_in(part.column("text"))
        n = np.bincount(owner, minlength=part.num_rows)
        coded = terms.dictionary_encode()
        found = pc.index_in(coded.dictionary, codes).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = found[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int64)
        wanted = code >= 0
        pair, tf = np.unique(owner[wanted] * len(codes) + code[wanted], return_counts=True)
        doc, code = np.divmod(pair, max(1, len(codes)))
        off = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=part.num_rows))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (code, tf)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each term, summed for each batch."""
    for batch in batches:
        code, df = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(df)], ["code", "df"])


@dataclass
class Block:
    """Part of the forward index with its impact-sorted lists."""

    ids: np.ndarray
    absent: np.ndarray  # the id is null
    first: np.ndarray  # where each text's entries begin in the next two
    term: np.ndarray
    impact: np.ndarray
    begin: np.ndarray  # by term: where its list begins in the next two
    doc: np.ndarray
    by_impact: np.ndarray

    @classmethod
    def build(cls, batches: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> Block:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table["doc_id"].combine_chunks()
        lists = table["terms"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        norm = 100 - 50 + 50 * table["n"].to_numpy() * n_docs // n_terms
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(norm, size)))
        order = np.lexsort((-impact, term))
        begin = np.searchsorted(term[order], np.arange(len(weights) + 1))
        doc = np.repeat(np.arange(len(size)), size)
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        return cls(ids.fill_null(0).to_numpy(), absent, np.append(0, np.cumsum(size)), term, impact, begin, doc[order], impact[order])

    def scores(self, docs: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Full scores of some texts by look-ups in the forward index; ``mine`` marks the item's terms."""
        size = self.first[docs + 1] - self.first[docs]
        start = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(start - self.first[docs], size)
        return np.add.reduceat(np.where(mine[self.term[at]], self.impact[at], 0), start)


@dataclass
class Best:
    """The k best of an item so far: falling score, then rising id, null ids last."""

    k: int
    score: np.ndarray
    absent: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls, k: int) -> Best:
        return cls(k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    @property
    def least(self) -> int:
        """The k-th best score; 0 where there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least)
        if good.any():
            score, absent, ids = (np.concatenate(x) for x in ((self.score, score[good]), (self.absent, absent[good]), (self.ids, ids[good])))
            order = np.lexsort((ids, absent, -score))[: self.k]
            self.score, self.absent, self.ids = score[order], absent[order], ids[order]


def search(block: Block, terms: np.ndarray, best: Best) -> int:
    """The threshold algorithm over one block for one item; the number of entries read."""
    begin, end = block.begin[terms], block.begin[terms + 1]
    mine = np.zeros(len(block.begin) - 1, bool)
    mine[terms] = True
    seen = np.zeros(len(block.ids), bool)
    at, step, read = begin.copy(), STEP, 0
    while (at < end).any():
        to = np.minimum(at + step, end)
        docs = np.unique(np.concatenate([block.doc[a:b] for a, b in zip(at.tolist(), to.tolist(), strict=True)]))
        docs = docs[~seen[docs]]
        seen[docs] = True
        read += int((to - at).sum())
        if len(docs):
            best.add(block.scores(docs, mine), block.absent[docs], block.ids[docs])
        at, step = to, 2 * step
        open_ = at < end
        if block.by_impact[at[open_] - 1].sum() < best.least:
            break
    return read


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            upto = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
            take = max(1 if not held else 0, int(np.searchsorted(upto, BLOCK_POSTINGS - size, side="right")))
            if take:
                held.append(batch.slice(0, take))
                size += int(upto[take - 1])
            if take < batch.num_rows:
                yield held
                held, size = [], 0
            batch = batch.slice(take)
    if held:
        yield held


def _search_all(batches: Iterator[pa.RecordBatch], items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    best = [Best.none(k) for _ in items]
    for held in _blocks(batches):
        block = Block.build(held, weights, n_docs, n_terms)
        for terms, own in zip(items, best, strict=True):
            search(block, terms, own)
    for item, own in enumerate(best):
        if len(own.score):
            columns = [pa.array(np.full(len(own.score), item, np.int32)), pa.array(own.ids, mask=own.absent), pa.array(own.score)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def _first_k(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each item from the best k of every task: once for each part of the tasks, then of those."""
    part = F.pmod(F.spark_partition_id(), F.lit(max(1, isqrt(hits.sparkSession.sparkContext.defaultParallelism * 4))))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    first = hits.withColumn("_part", part).withColumn("_k", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("_k") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("_part", "_k")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms are runs of letters and digits of ASCII and of all other characters outside
    it, A-Z lower-cased.  Rows of ``items`` with one id are one item with the terms of
    all; items and texts without terms (null, empty) get and give nothing.  Equal scores
    rank by rising doc_id, null last; repeated rows of ``docs`` rank each.  Texts are
    taken whole, however long; empty tables give no rows; other columns are not read.

    Items are searched in shards of bounded size, whose terms the tasks get with the
    function; several shards cost a pass over the texts each.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    given = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = given.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(1, -(-size[0] // SHARD_ITEMS), -(-(size[1] or 0) // SHARD_BYTES))
    out = []
    for shard in range(shards):
        some = given.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        pairs = some.mapInArrow(_item_terms, "item_id long, term binary").distinct().orderBy(F.col("item_id").asc_nulls_first(), "term").collect()  # of one shard
        if not pairs:
            continue
        terms = sorted({bytes(r["term"]) for r in pairs})
        code = {t: c for c, t in enumerate(terms)}
        of_item: dict[int | None, list[int]] = {}
        for r in pairs:
            of_item.setdefault(r["item_id"], []).append(code[bytes(r["term"])])
        forward = stored(source.mapInArrow(partial(_forward, codes=pa.array(terms, pa.binary())), FORWARD), "forward")
        sums = forward.agg(F.count("*"), F.sum("n")).first()
        if not sums[0]:
            continue
        counted = forward.select("terms").mapInArrow(_document_counts, "code int, df long").groupBy("code").agg(F.sum("df")).collect()  # of one shard
        weights = np.zeros(len(terms), np.int64)
        for c, df in counted:
            weights[c] = weight(sums[0], df)
        find = partial(_search_all, items=[np.array(x) for x in of_item.values()], weights=weights, n_docs=sums[0], n_terms=sums[1], k=k)
        hits = _first_k(forward.mapInArrow(find, HITS), k)
        names = spark.createDataFrame(list(enumerate(of_item)), "item int, item_id long")
        out.append(hits.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH term AS (
  SELECT k, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
size AS (SELECT k, doc_id, count(*) AS n FROM term GROUP BY k, doc_id),
total AS (SELECT count(*) AS docs, cast(sum(n) AS BIGINT) AS terms FROM size),
held AS (SELECT k, t, count(*) AS tf FROM term WHERE t IN (SELECT t FROM wanted) GROUP BY k, t),
weight AS (SELECT t, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT t, count(*) AS df FROM held GROUP BY t), total),
impact AS (SELECT k, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS x
           FROM held JOIN weight USING (t) JOIN size USING (k), total),
score AS (SELECT item_id, k, cast(sum(x) AS BIGINT) AS score FROM wanted JOIN impact USING (t) GROUP BY item_id, k HAVING sum(x) > 0)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score JOIN size USING (k) QUALIFY rank <= 50"""
