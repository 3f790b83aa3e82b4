"""The training sample leaves no language out."""

from __future__ import annotations

from collections import Counter

from keelson.llm import langid


def test_every_language_is_sampled(spark, monkeypatch):
    rows = [(i, f"text {i} of language {i % 90}", f"l{i % 90}") for i in range(90 * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = langid.training_sample(docs)
    assert len(set(langs)) == 90 and set(Counter(langs).values()) == {40} and len(texts) == len(langs)
    monkeypatch.setattr(langid, "MAX_ROWS", 200)
    assert set(Counter(langid.training_sample(docs)[1]).values()) == {2}
