"""Pieces that a vocabulary's normaliser and pre-tokeniser cut words into.

A word is a run without ASCII white space.  Plain words, of listed letters and printable
ASCII, are cut by one pattern, all at once; any other by the library's own normaliser and
pre-tokeniser.  Neither joins across white space, so words can be cut by themselves.
"""

from __future__ import annotations

import json
import os
import re

# --- Fixed values: how the vocabulary's own normaliser and pre-tokeniser cut plain words. ---
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# --- End of fixed values. ---
#: Letters of Latin-1, Cyrillic, kana, Han and Hangul: one character in lower case, none that joins with the one before.
LETTERS = "À-ÖØ-öø-ÿЀ-џぁ-ゖァ-ヺ一-鿿가-힣"
PLAIN = re.compile(rf"[!-~{LETTERS}]+")
PIECE = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^a-z0-9{LETTERS}\n]+")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one past 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(other)) for b in range(256)]


class Cutter:
    """Cuts words into the UTF-8 bytes of pieces; a special string becomes its id."""

    def __init__(self, path: str):
        tokenizer = load(path)
        made = json.loads(tokenizer.to_str())
        self.model = made["model"]
        self.decoder = tokenizer.decoder
        named = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        self.tokens = [named.get(i) for i in range(max(named, default=-1) + 1)]
        self._normalizer, self._cut = tokenizer.normalizer, tokenizer.pre_tokenizer
        self._byte = {c: b for b, c in enumerate(byte_names())}
        if odd := [x["content"] for x in made["added_tokens"] if x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]]:
            raise ValueError(f"added tokens of a kind that isn't read here: {odd[:3]}")
        self._special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self._split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self._special, key=lambda x: (-len(x), x))) + ")") if self._special else None
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self._by_pattern = steps == NORMALIZERS and cuts == [PATTERN, None]

    def cut(self, words: list[bytes]) -> list[list[bytes | int]]:
        texts = [w.decode() for w in words]
        out: list[list[bytes | int]] = [[] for _ in words]
        plain = [k for k, t in enumerate(texts) if self._by_pattern and PLAIN.fullmatch(t) and not any(x in t for x in self._special)]
        if plain:
            each = iter(plain)
            own: list[bytes | int] = []
            for p in PIECE.findall("\n".join([texts[k] for k in plain]).lower() + "\n"):
                if p == "\n":
                    out[next(each)], own = own, []
                else:
                    own.append(p.encode())
        for k in set(range(len(words))) - set(plain):
            out[k] = self._by_library(texts[k])
        return out

    def _by_library(self, text: str) -> list[bytes | int]:
        own: list[bytes | int] = []
        for part in self._split.split(text) if self._split else [text]:
            if part in self._special:
                own.append(self._special[part])
            elif part:
                text = self._normalizer.normalize_str(part) if self._normalizer else part
                own += [bytes([self._byte[c] for c in p]) for p, _ in self._cut.pre_tokenize_str(text)]
        return own
