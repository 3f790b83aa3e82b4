"""Token counts at every prefix of any text, against the library, and the memory of long words."""

from __future__ import annotations

import random
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
import pytest

from keelson.llm import tokencount
from keelson.llm.pieces import load

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
HAN = "中文字的是不了人我在有他这个们来到时大地为子你说生国年着就那和要她出也得里后自以会家可下而过天去能对小多然于心学么之都好看起发当没成只如事把还用第样道想作种开美总从无情己面最女但现前些所同日手又行意动方期它头经长儿回位分爱老因很给名法间斯知世什两次使身者被高已亲其进此话常与活正感"
THAI = "กขคงจฉชซญดตถทธนบปผพฟมยรลวสหอะาำิีึืุูเแโใไ่้๊๋"
ANY = [*"aaabbc'.!sS ldRE\t\n\x1c\x85\xa0ẹ́́̈ͅİΣς中文。กำ😀　각각½٣’ﬁ‍ǅÅ", "é", "각", "<|endoftext|>", "<|", "'ll", "'re"]


@pytest.fixture(scope="module")
def library():
    return load(PATH)


def at_every_prefix(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [x for out in tokencount._prefix_batches(iter([batch]), PATH) for x in out.column("at").to_pylist()]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_characters(library, seed):
    """Marks that compose or change places, special strings whole and cut, contractions, scripts without spaces."""
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(ANY) for _ in range(rnd.randint(0, 25))) for _ in range(800)]
    every = [t[:k] for t in texts for k in range(len(t) + 1)]
    want = iter([len(e.ids) for e in library.encode_batch(every, add_special_tokens=False)])
    assert at_every_prefix(texts) == [[next(want) for _ in range(len(t) + 1)] for t in texts]


@pytest.mark.parametrize("alphabet", [HAN + "，。", THAI, "각", "é!'s"])
def test_long_words(library, alphabet):
    rnd = random.Random(7)
    text = "".join(rnd.choice(alphabet) for _ in range(20_000)) if len(alphabet) > 6 else alphabet * 5_000
    got = at_every_prefix([text])[0]
    for k in [*rnd.sample(range(len(text)), 20), len(text)]:
        assert got[k] == len(library.encode(text[:k], add_special_tokens=False).ids)


def test_memory():
    """2 MB of Chinese paragraphs and words of 100,000 characters stay under 1 GB."""
    code = f"""
import random, resource
from tests.llm.test_token_prefixes import HAN, THAI, at_every_prefix
from keelson.llm.pieces import load
rnd = random.Random(1)
library = load({PATH!r})
han = "".join(rnd.choices(HAN + "，。", k=100_000))
thai = "".join(rnd.choices(THAI, k=100_000))
for text in (" ".join("".join(rnd.choices(HAN + "。", k=300)) for _ in range(2300)), han, thai):
    assert at_every_prefix([text])[0][-1] == len(library.encode(text, add_special_tokens=False).ids)
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_000_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=600)


def test_library_in_batches(library, monkeypatch):
    """A vocabulary with other rules is encoded at every prefix, some characters at a time."""
    monkeypatch.setattr(tokencount, "AT_ONCE", 50)
    counter = tokencount._Counter(PATH)
    words = ["naïve", "文" * 30, "a", "x-ray's"]
    flat, sizes = counter._by_library(words)
    assert sizes.tolist() == [len(w) for w in words]
    assert flat.tolist() == [len(library.encode(w[:k], add_special_tokens=False).ids) for w in words for k in range(1, len(w) + 1)]
