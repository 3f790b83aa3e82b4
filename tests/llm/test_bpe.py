"""BPE encoding and decoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest

from keelson.llm import bpe
from keelson.llm.pieces import load
from keelson.llm.queries import QUERIES

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SF = "/root/testdata/sf0.01"
ALPHABET = [*"aaabbc'.!sS ldRE\t\n\x0b\x1c\x85\xa0́ ‍ﬁǅͅ", "é", "é", "<|endoftext|>", "<|startoftext|>", "<|", "İ", "Σ", "ς", "中", "文。", "ก", "ำ", "😀", "　", "각", "각", "½", "٣", "’", "</w>", "'ll", "'RE"]


@pytest.fixture(scope="module")
def library():
    return load(PATH)


def encoded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = bpe.decode(bpe.encode(rows, PATH), PATH)
    found = {r["doc_id"]: (r["ids"], r["text"]) for r in both.collect()}
    return [found[k] for k in range(len(texts))]


def test_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op12_bpe_round_trip"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for (doc, _), e in zip(docs, library.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True):
        assert got[doc]["n_tokens"] == len(e.ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_any_text(spark, library):
    """Combining marks, special strings, other white space, scripts without spaces, cases that change length."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert encoded(spark, texts) == [(e.ids, library.decode(e.ids, skip_special_tokens=False)) for e in want]


def test_long_words(spark, library):
    rnd = random.Random(4)
    texts = ["a" * 50_001, "".join(rnd.choice("中文字的是不了人我在有他这") for _ in range(60_000)), "ab" * 30_000 + "!" * 9_999, "".join(rnd.choice("กขคงจฉชซ") for _ in range(30_000))]
    assert [i for i, _ in encoded(spark, texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_odd(spark, odd_docs, no_docs, library):
    rows = odd_docs.select("doc_id", "text").collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in bpe.encode(odd_docs, PATH).collect())
    assert got == sorted((d is None, d or 0, library.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    assert bpe.encode(no_docs, PATH).collect() == [] and bpe.decode(bpe.encode(no_docs, PATH), PATH).columns == ["doc_id", "ids", "text"]


def test_decode_of_any_ids(spark, library):
    """Numbers without a token are left out; null lists and entries give nothing; a column named text is replaced."""
    rows = spark.createDataFrame([(1, [320, 999_999, 49407, -5], "x"), (2, None, "y"), (3, [], "z")], "doc_id long, ids array<int>, text string")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(rows, PATH).collect()}
    assert got == {1: library.decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_memo_is_bounded(library, monkeypatch):
    """A task that forgets encodes as one that doesn't."""
    monkeypatch.setattr(bpe, "MEMO_WORDS", 20)
    encoder, rnd = bpe._Encoder(PATH), random.Random(6)
    for _ in range(30):
        words = list({"".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 8))).encode() for _ in range(15)})
        number, begin, pool = encoder.table(words)
        assert [pool[begin[n] : begin[n + 1]].tolist() for n in number] == [library.encode(w.decode(), add_special_tokens=False).ids for w in words]
        assert len(encoder._word) <= 20


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"type": "WordPiece"})
    model = {"type": "BPE", "vocab": {n: k for k, n in enumerate(bpe.byte_names())} | {"ab": 256, "abc": 257}, "merges": [["ab", "c"], ["a", "b"]]}
    with pytest.raises(ValueError, match="before its parts"):
        bpe.Merges(model)
