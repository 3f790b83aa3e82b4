"""The pipeline's near-dedup against all pairs of exact shingle sets."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from keelson.llm import shingles

from . import brute


def plain_kept(texts: dict[int, str], n: int = 5, least: float = 0.8) -> set[int]:
    def own(text):
        w = brute.words(text, lower=True)
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}

    sets = {i: own(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if root[a] != root[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_near_copies_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == plain_kept(texts) and not {177, 145} & got  # 0.83 like 1 and 6, but 11 and 7 bits of SimHash away


@pytest.mark.parametrize("small", [48, 3])
def test_crowds_and_chains(spark, monkeypatch, small):
    """Chains of changed words and a crowd of near copies, through pairs and through large bands."""
    monkeypatch.setattr(shingles, "SMALL", small)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for k in range(40):
        w = list(base)
        w[3 * k] = f"new{k}"
        texts[100 + k] = " ".join(w)
    w = [f"v{k}" for k in range(150)]
    for k in range(12):  # each is near the one before, and far from the first
        w = w[:]
        w[12 * k] = "other"
        texts[300 - k] = " ".join(w).upper()
    texts |= {1: "a b", 2: "a  B", 3: "a c", 4: "", 5: " \n", 6: "alone in the world it stands and has no copy"}
    docs = spark.createDataFrame([*texts.items(), (None, "a b")], "doc_id long, text string")
    got = [r["doc_id"] for r in shingles.keep_first(docs).collect()]
    assert None in got and set(got) - {None} == plain_kept(texts) and len(got) == len(set(got))


def test_members_meet_in_the_pivot_table(spark):
    """Fingerprints of sets bit by bit, and all links within two bits by the cells alone."""
    rnd = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k // 8 * 9 : k // 8 * 9 + 300 - k % 8]) for k in range(64)] + ["", "a b"]
    h, off = shingles.shingle_sets(pa.array(texts))
    prints = shingles.set_prints(h, off)
    for k in rnd.integers(0, len(texts), 8):
        own = [int(x) for x in h[off[k] : off[k + 1]]]
        assert int(prints[k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))
    keys = shingles.set_keys(h, off).astype(np.int64)
    rows = [(int(k), int(x)) for k, x in zip(keys, prints.astype(np.int64), strict=True)]
    got = [(r["a"], r["b"]) for r in shingles.pivot_pairs(spark.createDataFrame(rows, "key long, fp long")).collect()]
    full = [(k, x % 2**64) for k, x in rows if k]
    root = {k: k for k, _ in full}

    def reach(pairs, root):
        root = dict(root)
        for a, b in pairs:
            x, y = sorted((root[a], root[b]))
            root = {k: x if r == y else r for k, r in root.items()}
        return root

    near = [(a, b) for (a, x), (b, y) in combinations(full, 2) if (x ^ y).bit_count() <= 2]
    assert len(near) > 10 and reach(got, root) == reach(near, root)
