"""Languages with few of the documents are held against themselves, or not at all."""

from __future__ import annotations

import numpy as np
import pytest

from keelson.llm import quality


def texts(seed: int, stem: str, n: int, size: int = 150) -> list[str]:
    """Texts of one invented language: words of its own, some common and many rare."""
    rng = np.random.default_rng(seed)
    return [" ".join(f"{stem}{min(int(x), 400)}{stem}" for x in rng.zipf(1.3, size)) for _ in range(n)]


@pytest.mark.parametrize("shard", [200, 1])
def test_tail_languages(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD", shard)
    big, tail, few = texts(1, "abc", 9000, 20), texts(2, "XYZ", 80), texts(3, "éü", 5)
    junk = [" ".join(["zz top"] * 5 + [f"j{k * 7}" for k in range(150)])]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "big") for t in big), *((t, "tail") for t in tail), *((t, "few") for t in few), (few[0], None), (junk[0], "tail")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    refs = quality.references(docs.select("text", "lang"))
    assert sorted(refs) == ["big", "tail"]  # under 1 % of the documents, but over 10,000 words
    got = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    assert len(got) == len(rows)
    odd = lambda r: r["class_distance"] > 0.25 + 1 / 10 or r["word_distance"] > 0.25 + 2.7 / 12
    assert not any(odd(got[i]) for i, _, lang in rows if lang != "big" and i != len(rows) - 1)
    assert all(got[i]["class_distance"] == got[i]["word_distance"] == 0 for i, _, lang in rows if lang in ("few", None))
    assert odd(got[len(rows) - 1])
