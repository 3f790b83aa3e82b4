"""Ranked search against scoring every text for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from keelson.llm import ranking

from . import brute

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain(docs, items, k=50):
    bags = [(i, Counter(TERM.findall((t or "").translate(brute.LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(brute.LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, bag in bags:
            m = 100 - 50 + 50 * bag.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in terms if t in bag)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ours(docs, items, k=50):
    return sorted((tuple(r) for r in ranking.ranked(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["Éa", "中文", "x’y", "Z9"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    docs = [(k, rnd.choice([" ", "-", "\n", "."]).join(rnd.choices(vocab, weights, k=rnd.randint(0, 50)))) for k in range(n)]
    docs += [(k, docs[7][1]) for k in range(n, n + 90)] + [docs[3]] * 3 + [(None, docs[9][1])] * 2 + [(n + 100, None), (n + 101, "")]
    items = [(k, " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 12)))) for k in range(20)]
    return docs, [*items, (50, docs[7][1]), (3, "w50 w51"), (None, "w1 W1 w2"), (60, None), (61, "--"), (62, "unseen")]


@pytest.mark.parametrize("step,postings", [(64, 2_000_000), (1, 300), (3, 1)])
def test_all_items(spark, monkeypatch, step, postings):
    """Ties, copies, repeated rows, null ids and texts, several blocks a task and short rounds."""
    monkeypatch.setattr(ranking, "STEP", step)
    monkeypatch.setattr(ranking, "BLOCK_POSTINGS", postings)
    docs, items = corpus(step)
    got = ours(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS n", "'x' AS score"), spark.createDataFrame(items, ITEMS).selectExpr("*", "2 AS rank"))
    assert got == plain(docs, items)


def test_few_and_shards(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SHARD_ITEMS", 6)
    docs, items = corpus(9)
    assert ours(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 3) == plain(docs, items, 3)


def test_empty(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "cat dog")], ITEMS)
    assert ours(no_docs, some) == [] and ours(odd_docs, none) == []
    assert ours(odd_docs, some) == plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(1, "cat dog")])


def test_stops_early():
    """Reading ends once the threshold is below the k-th score: a skewed list isn't read to its end."""
    n = 50_000
    rnd = np.random.default_rng(1)
    tf = np.where(np.arange(n) < 200, 50, 1).astype(np.int32)
    off = pa.array(np.arange(0, 2 * n + 1, 2).astype(np.int32))
    lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (np.tile(np.array([0, 1], np.int32), n), np.repeat(tf, 2))]
    batch = pa.RecordBatch.from_arrays([pa.array(rnd.permutation(n)), pa.array(np.full(n, 100)), *lists], ["doc_id", "n", "terms", "counts"])
    block = ranking.Block.build([batch], np.array([900, 1100]), n, 100 * n)
    best = ranking.Best.none(50)
    assert ranking.search(block, np.array([0, 1]), best) < 2_000
    top = np.sort(batch.column("doc_id").to_numpy()[:200])[:50]
    assert best.ids.tolist() == top.tolist() and len(set(best.score.tolist())) == 1
