"""Scores from one exchange are those of the tables, and of a plain-Python Katz model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import katz, katz_corpus

from .test_katz_pairs import plain_scores

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def by_id(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


def same(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert [r[k] for r in got] == pytest.approx([r[k] for r in want], abs=1e-6)


def test_blocks_come_back():
    rng = np.random.default_rng(0)
    columns = [np.zeros(0, np.int64), rng.integers(0, 9, 1000), rng.integers(-(2**63), 2**63 - 1, 50), rng.random(7)]
    got = katz_corpus.unpack(katz_corpus.pack(columns))
    assert all(np.array_equal(a.view(np.uint64), b) for a, b in zip(columns, got, strict=True))


@pytest.mark.parametrize("share, hot, size", [(1e-5, 1e-5, 3_000_000), (1e-5, 1.0, 3_000), (0.002, 1.0, 2_000), (0.002, 0.004, 3_000), (1.0, 1.0, 1_000)])
def test_same_as_the_tables(spark, monkeypatch, share, hot, size):
    """All, some or no words with a class; all, some or no pairs named; one bucket or many."""
    monkeypatch.setattr(katz, "CLASS_SHARE", share)
    monkeypatch.setattr(katz_corpus, "HOT_SHARE", hot)
    monkeypatch.setattr(katz_corpus, "BUCKET_TOKENS", size)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 50 = 3")).repartition(3)  # some rows twice
    want = katz.score(docs, katz.train(docs.where(~katz.held_out())), katz.held_out())
    same(by_id(katz_corpus.learn_and_score(docs, katz.held_out())), by_id(want))


@pytest.mark.parametrize("share, hot", [(1e-5, 1e-5), (0.01, 1.0), (1.0, 1.0)])
def test_same_as_plain(spark, monkeypatch, share, hot):
    monkeypatch.setattr(katz, "CLASS_SHARE", share)
    monkeypatch.setattr(katz_corpus, "HOT_SHARE", hot)
    texts = [f"the w{k % 37} saw q{k % 53} and the x{k % 61 * k % 7} of w{(k * k) % 41} ran {'on ' * (k % 3)}rare{k % 90} tail{k % 90}" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(katz_corpus.learn_and_score(docs, F.lit(False)))
    assert [r[6] for r in got] == pytest.approx(plain_scores(texts), abs=1e-6)


def test_odd_rows(odd_docs, no_docs, spark):
    model = katz.train(odd_docs.where(~katz.held_out()))
    same(by_id(katz_corpus.learn_and_score(odd_docs, katz.held_out())), by_id(katz.score(odd_docs, model, katz.held_out())))
    assert katz_corpus.learn_and_score(no_docs, katz.held_out()).count() == 0
    assert all(r[6] == 0 and r[3] == 0 for r in by_id(katz_corpus.learn_and_score(odd_docs, F.lit(True))))
