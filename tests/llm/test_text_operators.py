"""Operators over documents: brute force on a small table, and odd inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.llm import decontam, katz, langid, mixing, quality, simhash, substring, tokencount
from keelson.llm.textops import chunks, split_words

from . import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.collect()}


def test_words_of_chunks():
    column = pa.array(["Ab  cé\n", None, "", " x", "y\x0bZ\x85q"])
    w = split_words(column, lower=True)
    index, distinct = w.encode()
    assert [distinct[k].decode() for k in index] == ["ab", "cé", "x", "y", "z\x85q"]
    assert w.per_doc.tolist() == [2, 0, 0, 1, 2]
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    assert sum(p.num_rows for p in chunks([batch], "text", 3)) == 5


# --- quality --------------------------------------------------------------------


def test_base_counts(small, texts):
    got = {r["doc_id"]: r for r in quality.judge_quality(small).collect()}
    for i, text in texts.items():
        r = got[i]
        n, chars, symbols, lines, again = brute.base_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_distance():
    p = np.array([[2.0, 2.0, 0.0], [0.0, 0.0, 4.0], [0.0, 0.0, 0.0]])
    q = np.array([0.5, 0.5, 0.0])
    assert quality.js_distance(p, q).round(9).tolist() == [0.0, 1.0, 0.0]


def test_references_are_exact(small, texts):
    refs = quality.references(small.select("text", "lang"))
    by_lang = {}
    for r in small.collect():
        by_lang.setdefault(r["lang"], []).extend(brute.words(r["text"]))
    for lang, ref in refs.items():
        n = len(by_lang[lang])
        common = {w for w in set(by_lang[lang]) if by_lang[lang].count(w) >= quality.COMMON * n and len(w.encode()) <= quality.MAX_WORD_BYTES}
        assert {w.decode() for w in ref.words} == common
        assert abs(ref.shares.sum() - 1) < 1e-9 and abs(ref.classes.sum() - 1) < 1e-9


def test_quality_tells_junk(spark, small):
    docs = small.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    got = docs.select("doc_id", "quality").join(quality.judge_quality(small).where("not base_failed"), "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_quality_odd(odd_docs, no_docs):
    got = quality.judge_quality(odd_docs).collect()
    assert len(got) == 9 and all(r["base_failed"] for r in got if r["doc_id"] in (2, 3, 6, 7))
    assert quality.judge_quality(no_docs).count() == 0


# --- near dedup -------------------------------------------------------------------


def test_near_duplicates(small, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(small).collect()}
    prints = [(i, brute.fingerprint(t)) for i, t in texts.items()]
    want = brute.components(prints)
    for (i, fp), root in zip(prints, want, strict=True):
        assert got[i]["fp"] & (2**64 - 1) == fp and got[i]["component_id"] == root


@pytest.mark.parametrize("spread", [4, 16, 64])
def test_links_of_dense_fingerprints(spark, spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    bits = rng.choice(64, spread, replace=False)
    prints = {int(base[k % 3]) ^ sum(1 << int(b) for b in rng.choice(bits, rng.integers(0, 5))) for k in range(400)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    from keelson.llm.components import components

    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute.components(list(enumerate(prints)))
    groups: dict[int, set[int]] = {}
    for k, root in enumerate(want):
        groups.setdefault(root, set()).add(signed[k])
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_large_cell_by_flips():
    members = np.unique(np.random.default_rng(1).integers(0, 4096, 300).astype(np.uint64) << np.uint64(20))
    a, b = simhash._linked_within(members)
    want = brute.components(list(enumerate(int(m) for m in members)))
    assert len(set(want)) == len(set(b.tolist())) + len(set(range(len(members))) - {int(np.searchsorted(members, x)) for x in a})


def test_keep_first(odd_docs, no_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 1, 2, 5, 7, 8, None]  # 3 and 6 have no words, like 2
    assert simhash.keep_first(no_docs).count() == 0
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd_docs).collect()}
    assert got[6] == got[3] == got[2] == 2 and got[None] is None


# --- substring dedup --------------------------------------------------------------


def test_strip_repeats(small, texts):
    out = substring.strip_repeats(small).withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["sha"]) for r in out.collect()}
    assert got == brute.strip_repeats(list(texts.items()))


@pytest.mark.parametrize("seed", range(3))
def test_strip_repeats_of_dense_text(spark, seed, monkeypatch):
    """Few words, shared lines and periodic runs; every anchor is hot in one of the runs."""
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "b", "c", "dd", "ée"][: 2 + seed]
    shared = [" ".join(rng.choice(vocabulary, 45)) for _ in range(3)] + ["x " * 70]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(3)]
        parts.insert(1, shared[rng.integers(0, 4)])
        docs.append((int(i * 7 % 61), " ".join(parts)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    if seed == 1:
        monkeypatch.setattr(substring, "HOT_LEAST", 4)
    out = substring.strip_repeats(frame).withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["sha"]) for r in out.collect()}
    assert got == brute.strip_repeats(docs)


def test_strip_repeats_odd(spark, odd_docs, no_docs):
    got = substring.strip_repeats(odd_docs).collect()
    twice = sorted(r["n_removed"] for r in got if r["doc_id"] == 1)
    assert len(got) == 9 and twice == [0, 23]  # all of its 23 words
    kept = substring.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 1").count() == 1
    assert {(r["_key"], r["_runs"], r["runs"]) for r in kept.collect()} == {("clash",) * 3}
    assert substring.strip_repeats(no_docs).count() == 0 and substring.without_repeats(no_docs).count() == 0


# --- language ---------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs.where(~langid.held_out()))
    got = langid.identify(docs, net).where(langid.held_out())
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98


def test_language_odd(odd_docs, no_docs):
    net = langid.train(["the cat and the dog", "le chat et la souris"] * 20, ["en", "fr"] * 20)
    got = {r["doc_id"]: r for r in langid.identify(odd_docs, net).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 6, 7))
    assert got[1]["lang_pred"] == "en" and got[8]["lang_pred"] == "fr" and 0 <= got[5]["score"] <= 1
    assert langid.identify(no_docs, net).count() == 0
    assert langid.train([], []) is None and langid.fit(no_docs) is None
    assert {r["lang_pred"] for r in langid.identify(odd_docs, None).collect()} == {"und"}
    assert langid.known_language(odd_docs, net, 0.4).columns == [c for c in odd_docs.columns if c not in ("lang_pred", "score")]


# --- mixing -----------------------------------------------------------------------


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([30 * 5 / 8, 30 * 2 / 8, 30 / 8])
    capped = mixing.targets([1, 100, 100], [5, 2, 1])
    assert capped[0] == 3 and sum(capped) == pytest.approx(201) and capped[1] == pytest.approx(2 * capped[2])
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [5, 2]) == [0, 5]


@pytest.mark.parametrize("close", [mixing.close_pairs, mixing.close_all])
def test_rounding_keeps_mass_and_is_unbiased(close):
    mass = np.array([1.0, 7, 3, 20, 5, 1, 2, 40, 1, 9, 11, 6, 2, 1, 1, 8, 12, 4, 3, 17])
    chance = np.full(20, 0.37)
    runs = np.array([close(mass, chance, np.random.default_rng(k)) for k in range(3000)])
    closed = (runs == 0) | (runs == 1)
    assert (closed.sum(axis=1) >= 19).all()
    assert abs(runs.mean(axis=0) - 0.37).max() < 0.04
    off = abs(runs @ mass - chance @ mass)
    assert off.mean() < (1e-6 if close is mixing.close_pairs else 1)  # the least mass is 1


def test_mix(spark, small, texts):
    got = mixing.copies_of(small).collect()
    size = {i: len(brute.words(t)) for i, t in texts.items()}
    sources = {r["doc_id"]: r["source"] for r in small.collect()}
    names = sorted(set(sources.values()))
    whole = [sum(size[i] for i in size if sources[i] == s) for s in names]
    goal = mixing.targets(whole, [mixing.WEIGHTS[k % 3] for k in range(len(names))])
    for s, w, g in zip(names, whole, goal, strict=True):
        own = [r for r in got if r["source"] == s]
        assert all(r["size"] == size[r["doc_id"]] and r["source_size"] == w for r in own)
        assert all(abs(r["target"] - g) < 1e-6 and 0 <= r["copies"] <= 3 for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - g) <= max(r["size"] for r in own)  # ten texts a source here
    again = {(r["doc_id"], r["copies"]) for r in mixing.copies_of(small.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_mix_by_levels(spark, small, monkeypatch):
    for name, value in (("BLOCK", 3), ("RESERVE", 1), ("ROOT_ROWS", 2)):
        monkeypatch.setattr(mixing, name, value)
    got = mixing.copies_of(small).collect()
    assert len(got) == small.count()
    total = sum(r["size"] * r["copies"] for r in got)
    assert abs(total - sum(r["size"] for r in got)) < 0.2 * total


def test_mix_odd(odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    assert sorted(out.columns) == sorted(odd_docs.columns)
    assert {r["copies"] for r in out.collect()} <= {1, 2, 3}
    assert sum(r["m"] for r in mixing.copies_of(odd_docs).collect()) == 9
    assert mixing.mix(no_docs).count() == 0


# --- language model -----------------------------------------------------------------


def test_discounts():
    d = katz.discounts([0, 1000, 400, 200, 120, 80, 60])
    assert len(d) == 5 and all(0 < x < 1 for x in d)
    assert katz.discounts([0, 5, 0, 0, 0, 0, 0]) == [(r - 0.5) / r for r in range(1, 6)]


def test_katz_sums_to_one(spark, small):
    model = katz.train(small)
    lists = model.lists
    gains = {r["code"]: r["g"] for r in model.gains.collect()}
    own = lists.counts[(lists.counts >= katz.CLASS_SHARE * lists.unigrams.tokens) & (lists.keys != katz.END_KEY)]
    p = np.zeros(lists.n_classes)
    p[2:] = 10 ** lists.unigrams.log10_p(own)
    p[katz.END] = 10 ** lists.unigrams.log10_p(lists.counts[lists.keys == katz.END_KEY])[0]
    p[katz.RARE] = 1 - p.sum()
    for h in (0, 1, 2, 5, lists.n_classes - 1):
        g = np.array([gains.get(h * lists.n_classes + w, 0.0) for w in range(lists.n_classes)])
        assert (p * 10 ** (lists.log_backoff[h] + g)).sum() == pytest.approx(1, abs=1e-9)


def test_katz_base_and_lists(spark, small, texts, monkeypatch):
    import math
    import zlib
    from collections import Counter

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*brute.words(t, lower=True), None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)

    def run():
        return {r["doc_id"]: r for r in katz.score(small, katz.train(small.where(~katz.held_out())), katz.held_out()).collect()}

    got = run()
    for i, ws in tokens.items():
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(want, abs=1e-6)
    per_token = lambda k: sum(r[k] for r in got.values() if r["held_out"]) / sum(r["n_tokens"] for r in got.values() if r["held_out"])
    assert per_token("score") > per_token("base_score")
    monkeypatch.setattr(katz, "LIST_SHARE", 1e-3)  # most look-ups go through the tables
    for i, r in run().items():
        assert r["score"] == pytest.approx(got[i]["score"], abs=1e-6) and r["base_score"] == pytest.approx(got[i]["base_score"], abs=1e-6)


def test_katz_odd(odd_docs, no_docs):
    model = katz.train(odd_docs.where(~katz.held_out()))
    got = katz.score(odd_docs, model, katz.held_out()).collect()
    assert len(got) == 9 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 6)} == {1}
    empty = katz.train(no_docs)
    assert katz.score(no_docs, empty, katz.held_out()).count() == 0
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in katz.score(odd_docs, empty, katz.held_out()).collect())


# --- decontamination ----------------------------------------------------------------


def test_leaks(spark, small):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    planted = [(900 + k, f"Some words before {'and more ' * (40 * k)}, {t.upper() if k % 2 else t} and some after it.") for k, t in sorted(items.items())[:6]]
    docs = small.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in (r["text"] or "")}
    latin = {(900 + k, i) for k, (i, t) in enumerate(sorted(items.items())[:6]) if t.isascii()}
    assert exact | latin <= got and got <= exact | {(900 + k, i) for k, i in enumerate(sorted(items)[:6])}
    kept = decontam.without_leaks(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}


def test_search_is_exact(spark, small):
    """Every passage's items above a low threshold, against scoring all items."""
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    (ix,) = decontam.build_shards(bench)[0]
    rng = np.random.default_rng(3)
    passages = [np.unique(rng.choice(len(ix.ids), 60 + 40 * k)) for k in range(12)]
    p = np.repeat(np.arange(12), [len(x) for x in passages])
    got = {(d, item): round(s, 9) for d, item, s in ix.search(p, np.concatenate(passages), 0.25)}
    want = {}
    for d, x in enumerate(passages):
        for item, weights in enumerate(ix.weights):
            s = sum(w for t, w in weights.items() if t in set(x.tolist()))
            if s >= 0.25:
                want[d, item] = round(s, 9)
    assert want and got == want


def test_leaks_odd(spark, odd_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "sat on the log while it rained all day long"), (2, None), (3, ""), (4, "unrelated words altogether in this one")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(odd_docs, bench).collect())
    assert got == [(1, 1), (1, 1)]
    assert decontam.leaks(no_docs, bench).count() == 0 and decontam.leaks(odd_docs, bench.where("false")).count() == 0
    assert decontam.without_leaks(odd_docs, bench).count() == 7
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 1)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(odd_docs, bench).collect()) == got


# --- token counts ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def test_token_counts(small, texts, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    got = {r["doc_id"]: r for r in tokencount.prefix_counts(small, vocabulary).collect()}
    for i, text in texts.items():
        assert (got[i]["counts"] or [0])[-1] == len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((text or "").encode())
        for k in (0, len(got[i]["ends"]) // 2):
            cut = (text or "").encode()[: got[i]["ends"][k]].decode()
            assert got[i]["counts"][k] == len(t.encode(cut, add_special_tokens=False).ids)


def test_character_prefixes(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    text = "Hello wörld it's <|endoftext|>x  don't\x1cfoo ΣΑΣ é 1234 <|endof"
    p = tokencount.PrefixCounts(text, vocabulary)
    assert [p.at(k) for k in range(len(text) + 1)] == [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_budgets(spark, vocabulary):
    df = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string")
    c, e = F.col("counts"), F.col("ends")
    out = tokencount.prefix_counts(df, vocabulary).select("doc_id", tokencount.total(c).alias("n"), tokencount.tokens_at(c, 2).alias("two"), tokencount.fits(e, c, 3).alias("cut"), tokencount.fits(e, c, 0).alias("none"))
    assert sorted(map(tuple, out.collect())) == [(1, 4, 2, 13, 0), (2, 0, 0, 0, 0)]


def test_token_counts_odd(odd_docs, no_docs, vocabulary):
    assert tokencount.prefix_counts(odd_docs, vocabulary).count() == 9
    assert tokencount.prefix_counts(no_docs, vocabulary).count() == 0


def test_every_prefix(spark, vocabulary):
    """The stored count of every prefix is the library's count of that prefix, whatever the text."""
    import random

    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(vocabulary), random.Random(5)
    texts = ["", None, " \t ", "'re 'llama we'll they've I'd! 'S ''t", "日本語のテキスト 한국어 ПриветМир ЁЖ", "a" * 90 + " " + "th" * 60 + "ß" * 40, "İstanbul é́ ﬁ <|endoftext|>x", "\n\n x"]
    texts += ["".join(rng.choices("abcdethrsoni'.,<>|/w!ÉéñÑß-0123 \n\t#日かЯ", k=120)) for _ in range(20)]
    texts += ["".join(rng.choices("thearinso", k=150)) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = F.col("at")
    rows = tokencount.prefix_counts(df, vocabulary).select("doc_id", "at", tokencount.longest_prefix(at, 7).alias("longest"), tokencount.tokens_of_prefix(at, 9).alias("nine")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        want = [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert r["at"] == want and r["nine"] == want[min(9, len(text))]
        assert r["longest"] == max(k for k, n in enumerate(want) if n <= 7)


def test_small_sources_are_paired(spark):
    """Blocks of a source of 40 equal texts (ties in size) close their fractions in pairs before the root sees any."""
    rows = [(k, "one two three four five", "b" if k < 40 else "a") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    levels = []
    plain = mixing._level

    def spied(rows, level, blocks):
        out = plain(rows, level, blocks)
        levels.append(out.where("sid = 1").select("chance").collect())
        return out

    mixing._level = spied
    try:
        got = mixing.copies_of(docs).collect()
    finally:
        mixing._level = plain
    first = [r["chance"] for r in levels[0]]
    assert 5 <= len(first) <= 35 and sum(0 < c < 1 for c in first) <= 1
    for s in ("a", "b"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 5
