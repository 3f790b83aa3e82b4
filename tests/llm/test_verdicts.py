"""Verdicts of the quality rules and of the language network against plain loops, and pipeline stages on odd rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from keelson.llm import langid, quality

from . import brute

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_distance(p: list[float], q: list[float]) -> float:
    """Jensen-Shannon distance, base 2; 0 for an empty histogram."""
    total = sum(p)
    if not total:
        return 0.0
    p = [x / total for x in p]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def test_verdicts_of_the_rules(spark):
    """Every verdict at sf 0.01: references counted and compared one document at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    table = quality._class_table()
    classes = lambda text: Counter(int(table[c.encode()[0]]) for c in text or "")
    chars, words, n_words = {}, {}, Counter()
    for r in docs:
        if r["lang"] is not None:
            chars.setdefault(r["lang"], Counter()).update(classes(r["text"]))
            words.setdefault(r["lang"], Counter()).update(brute.words(r["text"]))
    n_words = {lang: sum(c.values()) for lang, c in words.items()}
    want = {}
    for r in docs:
        text, lang = r["text"] or "", r["lang"]
        n, _, _, _, again = brute.base_counts(text)
        ok = not (n < 50 or 100 * again > 50 * n)
        if n_words.get(lang, 0) >= quality.MIN_REFERENCE_WORDS:
            whole = sum(chars[lang].values())
            own = classes(text)
            by_class = plain_distance([own[k] for k in range(quality.N_CLASSES)], [chars[lang][k] / whole for k in range(quality.N_CLASSES)])
            common = sorted(w for w, c in words[lang].items() if c >= quality.COMMON * n_words[lang])
            shares = [words[lang][w] / n_words[lang] for w in common]
            mine = Counter(brute.words(text))
            by_word = plain_distance([n - sum(mine[w] for w in common), *(mine[w] for w in common)], [1 - sum(shares), *shares])
            if len(text) >= quality.MIN_CHARS and by_class > quality.MAX_CLASS_DISTANCE + quality.CLASS_SLACK / math.sqrt(len(text)):
                ok = False
            if n >= quality.MIN_WORDS and by_word > quality.MAX_WORD_DISTANCE + quality.WORD_SLACK / math.sqrt(n):
                ok = False
        want[r["doc_id"]] = ok
    got = {r["doc_id"]: r["kept"] for r in quality.op1_divergence_rules(spark, SF).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_long_words_can_be_common(spark):
    """A word of any length counts among the common ones of its language."""
    long_word = "x" * 300
    rows = [(k, f"{long_word} and the cat {k} ran off " * 100, "en") for k in range(20)]
    refs = quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert long_word.encode() in refs["en"].words


def test_network_by_loops(spark):
    """Forward pass of a trained network, one filter and one position at a time."""
    net = langid.train(["the cat and the dog ran away", "le chat et la souris dans la maison", "der Hund und die Katze"] * 12, ["en", "fr", "de"] * 12)
    texts = ["the house", "la maison de la rue était très belle " * 9, "ß", "und"]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        evidence, chance = np.zeros(3), np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            own = list(raw[at : at + langid.WINDOW])
            padded = own + [langid.PAD] * (langid.WINDOW + max(langid.WIDTHS) - 1 - len(own))
            pooled = []
            for f in range(len(langid.WIDTHS) * langid.FILTERS):
                width = langid.WIDTHS[f // langid.FILTERS]
                weights = net.conv[:, f].reshape(-1, langid.EMBED)
                best = max(sum(float(net.embed[padded[p + j]] @ weights[j]) for j in range(width)) for p in range(langid.WINDOW))
                pooled.append(max(0.0, best + float(net.conv_bias[f])))
            z = np.array(pooled) @ net.dense.astype(float) + net.dense_bias
            logp = z - z.max() - math.log(np.exp(z - z.max()).sum())
            evidence += logp * len(own)
            chance += np.exp(logp) * len(own)
        best = int(evidence.argmax())
        assert got[i]["lang_pred"] == net.languages[best]
        assert got[i]["score"] == pytest.approx(chance[best] / len(raw), abs=1e-4)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, odd_docs, no_docs, name, stage):
    """Nulls in any column, empty and long texts, repeated rows, clashing names; and no rows at all."""
    out = stage(spark, odd_docs, "/root/testdata/sf0.001")
    last = name == "source_mix"
    columns = [c for c in odd_docs.columns if name != "language_id" or c not in ("lang_pred", "score")]  # names of its own results go
    assert set(out.columns) == set(columns) and (last or out.columns == columns)
    rows = out.collect()
    assert len(rows) <= 9 and all(r["doc_id"] in (1, 2, 3, None, 5, 6, 7, 8) for r in rows)
    ids = sorted((r["doc_id"] for r in rows), key=lambda i: (i is None, i or 0))
    if name == "near_dedup":  # null, empty and blank texts, and 7 is a text of its own
        assert ids == [1, 1, 2, 5, 7, 8, None]
    if name == "substring_dedup":  # the second of the equal rows loses all its words
        assert ids == [1, 2, 3, 5, 6, 7, 8, None]
    if name == "decontamination":
        assert len(rows) == 9
    nothing = stage(spark, no_docs, "/root/testdata/sf0.001")
    assert nothing.count() == 0 and set(COLUMNS) <= set(nothing.columns)
