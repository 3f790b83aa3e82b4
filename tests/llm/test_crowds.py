"""Large bands: links against all pairs, and crowds of pages that share a template."""

from __future__ import annotations

import time

import numpy as np
import pytest

from keelson.llm import shingles


def components(n, links):
    root = np.arange(n)
    for a, b in links:
        root[root == root[a]] = root[b]
    low = {}
    for k, r in enumerate(root):
        low.setdefault(r, k)
    return [low[r] for r in root]


@pytest.mark.parametrize("seed", range(30))
def test_links_keep_the_components(seed):
    """Copies with few changes, chains, subsets, and sets of one shingle."""
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 400, rng.integers(1, 60))) for _ in range(6)]
    sets = []
    for _ in range(120):
        x = base[rng.integers(6)]
        drop = rng.random(len(x)) < rng.choice([0, 0.05, 0.1, 0.2])
        more = rng.integers(0, 400, rng.integers(0, 6))
        x = np.unique(np.concatenate((x[~drop], more)))
        sets.append((x if len(x) else np.array([7])).astype(np.uint64))
    want = [(a, b) for a in range(len(sets)) for b in range(a) if shingles.similarity(sets[a], sets[b]) >= shingles.LEAST]
    got = list(shingles._Crowd(sets).links())
    assert set(got) <= set(want) and components(len(sets), got) == components(len(sets), want)


@pytest.mark.parametrize("common,own", [(134, 67), (172, 30)])
def test_pages_of_one_template(common, own):
    """10,000 pages of similarity 0.5 and 0.74, and near copies of some of them."""
    rng = np.random.default_rng(1)
    head = rng.integers(0, 2**62, common)
    sets = [np.unique(np.concatenate((head, rng.integers(0, 2**62, own)))).astype(np.uint64) for _ in range(10_000)]
    sets += [np.delete(sets[k], [3, 9]) for k in range(0, 500, 5)]
    began = time.perf_counter()
    got = list(shingles._Crowd(sets).links())
    assert time.perf_counter() - began < 60
    assert {(a, b) for a, b in got} == {(10_000 + k, 5 * k) for k in range(100)}


def test_a_crowd_of_near_copies():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 200)
    sets = [np.unique(np.concatenate((np.delete(base, rng.integers(0, 200, 4)), rng.integers(0, 2**62, 4)))).astype(np.uint64) for _ in range(5_000)]
    began = time.perf_counter()
    assert len(list(shingles._Crowd(sets).links())) == 4_999
    assert time.perf_counter() - began < 60
