"""The pair model keeps every word, however rare: against a plain-Python Katz model."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keelson.llm import katz

from . import brute


def plain_scores(texts: list[str]) -> list[float]:
    """Katz scores of order 2 of the training texts themselves."""
    tokens = [["", *brute.words(t, lower=True), ""] for t in texts]  # "" is the beginning and the end
    one = Counter(w for ws in tokens for w in ws[1:])
    two = Counter(p for ws in tokens for p in zip(ws, ws[1:], strict=False))
    total = sum(one.values())

    def factors(counts: Counter) -> dict[int, float]:
        n = Counter(counts.values())
        return dict(enumerate(katz.discounts([n[r] for r in range(katz.GT_ORDER + 2)]), 1))

    d1, d2 = factors(one), factors(two)
    p = {w: d1.get(c, 1.0) * c / total for w, c in one.items()}
    shown: dict[str, list[str]] = {}
    for h, w in two:
        shown.setdefault(h, []).append(w)
    below, back = {}, {}
    for h, ws in shown.items():
        c, dc = sum(two[h, w] for w in ws), sum(d2.get(two[h, w], 1.0) * two[h, w] for w in ws)
        below[h] = c if dc < c else c + 1
        back[h] = (1 - dc / below[h]) / (1 - sum(p[w] for w in ws))
    assert all(0 < b for b in back.values())
    return [sum(math.log10(d2.get(two[x], 1.0) * two[x] / below[x[0]]) for x in zip(ws, ws[1:], strict=False)) for ws in tokens]


@pytest.mark.parametrize("share, listed", [(1e-5, 1e-6), (0.01, 1e-6), (0.01, 0.02)])
def test_rare_words_keep_their_pairs(spark, monkeypatch, share, listed):
    """Words under CLASS_SHARE are looked up by key, but counted as themselves."""
    monkeypatch.setattr(katz, "CLASS_SHARE", share)
    monkeypatch.setattr(katz, "LIST_SHARE", listed)
    texts = [f"the w{k % 37} saw q{k % 53} and the x{k % 61 * k % 7} of w{(k * k) % 41} ran {'on ' * (k % 3)}rare{k % 90} tail{k % 90}" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in katz.score(docs, katz.train(docs), F.lit(False)).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(plain_scores(texts), abs=1e-6)


def test_codes_agree(spark):
    """Pair codes in Python and in Spark are the same numbers."""
    import numpy as np

    lists = katz.Lists(None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(5))
    names = np.array([3, 6, -5, 1 << 40, 2, -(1 << 63), 0], np.int64)
    rows = [(i, int(h), int(w)) for i, (h, w) in enumerate(zip([katz.END, *names[:-1]], names, strict=True))]
    df = spark.createDataFrame(rows, "i long, hist long, next long").select("i", katz._code_of(lists).alias("code"))
    assert [r["code"] for r in df.orderBy("i").collect()] == katz._pair_codes(names, lists.n_classes).tolist()
