"""Plain-Python forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def fingerprint(text: str | None) -> int:
    w = words(text, lower=True)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[tuple[int | None, int]], distance: int = 2) -> list[int | None]:
    """Least reachable id for each (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for k, (i, _) in enumerate(prints):
        at = find(k)
        known = [x for x in (least.get(at), i) if x is not None]
        least[at] = min(known) if known else None
    return [least[find(k)] for k in range(len(prints))]


def strip_repeats(docs: list[tuple[int, str | None]], length: int = 20) -> dict[int, tuple[int, int, str]]:
    seen: set[tuple[str, ...]] = set()
    out = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            run = tuple(w[k : k + length])
            if run in seen:
                gone[k : k + length] = [True] * length
            seen.add(run)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, characters in them, symbols, repeated lines, words in repeated 3-word windows."""
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for k in range(len(w) - 2):
        if seen[w[k], w[k + 1], w[k + 2]] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
