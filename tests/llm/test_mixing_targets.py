"""What a mix takes of each source, against plain Python and every rounding there is."""

from __future__ import annotations

from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from keelson.llm import mixing
from keelson.llm.queries import QUERIES

from . import brute


def plain_targets(sizes):
    """Shares by weights 5, 2, 1, at most three times a size, the excess shared again."""
    weights = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]
    low, high = 0.0, float(sum(sizes)) + 1
    for _ in range(200):  # the level at which min(level * weight, three times the size) uses up all
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w, 3 * s) for w, s in zip(weights, sizes, strict=True)) < sum(sizes) else (low, mid)
    return [min(high * w, 3 * s) for w, s in zip(weights, sizes, strict=True)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_each_source_comes_near_its_target(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    size = {i: len(brute.words(r["text"])) for i, r in docs.items()}
    sources = defaultdict(list)
    for i, r in docs.items():
        sources[r["source"]].append(i)
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, plain_targets([sum(size[i] for i in sources[s]) for s in names]), strict=True))
    got = {r["doc_id"]: r for r in QUERIES["op7_source_mix"](spark, folder).collect()}
    assert set(got) == set(docs)
    for s in names:
        own = [got[i] for i in sources[s]]
        assert all(r["size"] == size[r["doc_id"]] and r["source_size"] == sum(size[i] for i in sources[s]) and r["target"] == pytest.approx(target[s]) for r in own)
        assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in own)
        off = abs(sum(r["taken"] for r in own) - target[s])
        # within 1 %, or one small text: the median one of the source's
        assert off <= max(0.01 * target[s], float(np.median([r["size"] for r in own]))), (s, off, target[s])
        if sf == "sf0.01":
            assert off <= max(0.01 * target[s], min(r["size"] for r in own if r["size"])), (s, off, target[s])


def test_many_sources_in_little_time():
    sizes = list(range(1, 20_001))
    got = mixing.targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sizes))])
    assert got == pytest.approx(plain_targets(sizes))


@pytest.mark.parametrize("seed", range(20))
def test_root_against_every_rounding(seed):
    """Of ten texts the root keeps one of the best few of all 1,024 roundings, or comes within the smallest text."""
    rng = np.random.default_rng(seed)
    mass, chance = rng.integers(1, 500, 10).astype(float), np.full(10, rng.uniform(0.1, 0.9))
    want = mass @ chance
    every = sorted(abs(mass @ np.array(x) - want) for x in product((0, 1), repeat=10))
    got = mixing.close_root(mass, chance, np.random.default_rng(seed))
    assert set(got) <= {0, 1} and abs(mass @ got - want) <= max(mass.min(), every[100])
