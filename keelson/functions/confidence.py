"""Similarity to confidence, difficulty and score; random parts come from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: bands of similarity as (above, base, slope, noise, low, high), highest first. ---
BANDS = [
    (0.85, 0.30, 0.33, 0.015, 0.300, 0.349),
    (0.70, 0.25, 0.33, 0.020, 0.25, 0.30),
    (0.55, 0.20, 0.33, 0.020, 0.20, 0.25),
    (0.40, 0.18, 0.27, 0.015, 0.18, 0.22),
]
LOWEST = (0.15, 0.05, 0.015, 0.15, 0.20)  # base, rise up to 0.40, noise, low, high
HARD_BONUS, FAR_MALUS, FAR = 0.02, 0.01, 0.30
DIFFICULTY_EDGES = [(0.75, "Hard"), (0.60, "Medium")]
#: (share up to, low, high) of confidences for known classes; others 0.65 to 0.85.
MIXTURE = [(0.70, 0.78, 0.88), (0.90, 0.70, 0.78), (1.00, 0.88, 0.95)]
OTHERS = (0.65, 0.85)
HARD_FIFTH, REST = (0.75, 0.85), (0.88, 0.98)
# --- End of fixed values. ---


def uniform(seed: int, key: Column, salt: str = "") -> Column:
    """A number in [0, 1) from an md5 of seed and key; the same in any SQL engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def normal(seed: int, key: Column) -> Column:
    """A standard normal number from two hashes."""
    u = F.greatest(uniform(seed, key, "u"), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * uniform(seed, key, "v"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def pseudo_confidence(s: Column, hard: Column | None = None, noise: Column | None = None) -> Column:
    """Confidence target of an unknown item from its best similarity, three digits.

    ``hard`` marks classes that get the bonus in the highest band; ``noise`` is a
    standard normal column (none: 0).
    """
    z = F.lit(0.0) if noise is None else noise
    out = None
    for above, base, slope, sd, low, high in BANDS:
        value = base + slope * (s - above) + sd * z
        if above == BANDS[0][0] and hard is not None:
            value = value + F.when(hard, HARD_BONUS).otherwise(0.0)
        band = F.round(clamp(value, low, high), 3)
        out = F.when(s > above, band) if out is None else out.when(s > above, band)
    base, rise, sd, low, high = LOWEST
    value = base + rise * (s / BANDS[-1][0]) + sd * z - F.when(s < FAR, FAR_MALUS).otherwise(0.0)
    return out.otherwise(F.round(clamp(value, low, high), 3))


def difficulty(s: Column) -> Column:
    out = None
    for above, name in DIFFICULTY_EDGES:
        out = F.when(s > above, name) if out is None else out.when(s > above, name)
    return out.otherwise("Easy")


def ood_score(s: Column) -> Column:
    return F.round(clamp(1 - s, 0.1, 0.95), 3)


def mixture_confidence(known: Column, u: Column, v: Column) -> Column:
    """Confidence of an answer: a mixture for known classes, else one range; two digits."""
    between = lambda low, high: low + (high - low) * v
    out = F.when(~known, between(*OTHERS))
    for upto, low, high in MIXTURE[:-1]:
        out = out.when(u < upto, between(low, high))
    return F.round(out.otherwise(between(*MIXTURE[-1][1:])), 2)


def id_confidence(rank: Column, shots: Column, u: Column) -> Column:
    """The first fifth of a class is hard (rank from 1); two digits."""
    hard = rank <= F.floor(shots / 5)
    between = lambda edge: edge[0] + (edge[1] - edge[0]) * u
    return F.round(F.when(hard, between(HARD_FIFTH)).otherwise(between(REST)), 2)
