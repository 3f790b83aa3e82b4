"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; its ratio to the source's size gives each of its
texts the same expected number of copies.  The whole part is taken as it is; the
fraction is rounded so that the words taken keep their sum: two texts pass *mass*
(fraction times words) between them at random, without bias, until one fraction is 0
or 1; the other goes on to the next partner.

The reduction is a tree.  Leaves are blocks of a source, dealt by a hash, each reduced
to one open text at most; levels of such blocks follow while many are open.  A reserve
of each source's texts, half of them but twenty at least and some thousand at most, stays
out until the root, where the open ones and the reserve are closed from the largest to
the smallest, each against all that follow, and what is left open at the end is rounded
by itself.  So pairs are closed in every source that has two texts to round, and only the
root can miss a target.  Where the words that it takes are off by more than its smallest
text, it draws anew with pairs, up to ``DRAWS`` times, and keeps the nearest draw.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK, RESERVE, LEAST_RESERVE, ROOT_ROWS, DRAWS = 20_000, 2_000, 20, 4_000, 64
MAX_SOURCES = 1_000_000
BROADCAST_SOURCES = 20_000
SEED = 17
EDGE = 1e-12
ROOT_LEVEL = 1_000


def targets(sizes: list[int], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """Share out the sum of ``sizes`` by ``weights``, none above ``most`` times its size; the excess is reshared."""
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        full = set(over)
        open_ = [k for k in open_ if k not in full]
    return out


def close_pairs(mass: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pass mass between neighbours until one fraction at most is open; keeps the sum of mass times fraction."""
    p = chance.copy()
    held = -1
    draws = rng.random(len(p))
    for k in range(len(p)):
        if not EDGE < p[k] < 1 - EDGE:
            p[k] = round(p[k])
            continue
        if held < 0:
            held = k
            continue
        i, j = held, k
        up = min(mass[i] * (1 - p[i]), mass[j] * p[j])
        down = min(mass[i] * p[i], mass[j] * (1 - p[j]))
        step = up if draws[k] * (up + down) < down else -down
        p[i] += step / mass[i]
        p[j] -= step / mass[j]
        for x in (i, j):
            if p[x] < EDGE or p[x] > 1 - EDGE:
                p[x] = round(p[x])
        still = [x for x in (i, j) if 0 < p[x] < 1]
        held = still[0] if still else -1
    return p


def close_all(mass: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round all fractions, from the largest mass to the smallest, each against all smaller ones together."""
    order = np.argsort(-mass, kind="stable")
    w, p = mass[order].astype(float), chance[order].copy()
    for i in range(len(p)):
        while EDGE < p[i] < 1 - EDGE:
            rest = i + 1 + np.flatnonzero((p[i + 1 :] > EDGE) & (p[i + 1 :] < 1 - EDGE))
            if not len(rest):
                p[i] = float(rng.random() < p[i])
                break
            q, v = p[rest], w[rest] * p[rest] * (1 - p[rest])
            total = v.sum()
            up = min(w[i] * (1 - p[i]), total / (1 - q).max())
            down = min(w[i] * p[i], total / q.max())
            step = up if rng.random() * (up + down) < down else -down
            p[i] += step / w[i]
            p[rest] = np.clip(q - step * q * (1 - q) / total, 0, 1)
        p[i] = round(p[i])
    out = np.empty_like(p)
    out[order] = p
    return out


def close_root(mass: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round all fractions, and again with pairs from the largest mass to the smallest while the sum is off by more than the smallest."""
    order = np.argsort(-mass, kind="stable")
    want, least = float(mass @ chance), float(mass.min(initial=np.inf))
    best = close_all(mass, chance, rng)
    for _ in range(DRAWS):
        if abs(float(mass @ best) - want) <= least:
            break
        got = np.empty_like(chance)
        got[order] = close_pairs(mass[order], chance[order], rng)
        open_ = (got > EDGE) & (got < 1 - EDGE)  # one at most
        got[open_] = rng.random(int(open_.sum())) < got[open_]
        best = min(best, got, key=lambda p: abs(float(mass @ p) - want))
    return best


ROW = "doc_id long, source string, h long, size long, m long, sid int, chance double"


def _reduced(key, rows, level, last):
    """One block of a source: texts with their fraction closed, one of them perhaps still open (none if ``last``)."""
    rows = rows.sort_values(["pick", "h", "doc_id", "size"], na_position="last").reset_index(drop=True)
    rng = np.random.default_rng([SEED, level, *(int(k) for k in key)])
    mass = (rows["size"] * rows["m"]).to_numpy(float)
    rows["chance"] = (close_root if last else close_pairs)(mass, rows["chance"].to_numpy(float), rng)
    return rows[["doc_id", "source", "h", "size", "m", "sid", "chance"]]


def _uniform(salt: int):
    """A number in [0, 1) from a row's identity."""
    h = F.xxhash64(F.lit(SEED), F.lit(salt), "doc_id", "source", "h")
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def _level(rows: DataFrame, level: int, blocks) -> DataFrame:
    dealt = rows.withColumn("pick", _uniform(100 + level)).withColumn("block", F.floor(_uniform(200 + level) * blocks).cast("int"))
    done = dealt.groupBy("sid", "block").applyInPandas(partial(_reduced, level=level, last=False), ROW)
    return stored(done, "level")


def _root(rows: DataFrame) -> DataFrame:
    dealt = rows.withColumn("pick", _uniform(99))
    return stored(dealt.groupBy("sid").applyInPandas(partial(_reduced, level=ROOT_LEVEL, last=True), ROW), "root")


def copies_of(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """``(doc_id, source, h, size, m, source_size, target, copies)``: one row for each distinct row of ``docs``.

    ``h`` is a hash of the text and ``m`` how often the row occurs; rows that agree in
    doc_id, source and text get the same number of copies.  ``weights`` are repeated
    over the sources in code point order, null last.  Texts without words (null, empty,
    however many) have no copies, a very long text counts all its words, a null doc_id is
    one like any other, other columns are not read, and an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("h"), size.alias("size"))
    units = stored(base.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("m")), "units")
    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.count("*").alias("n"))
    rows = found.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in rows]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))], most)
    plan = []
    for sid, (r, words, target) in enumerate(zip(rows, sizes, goal, strict=True)):
        ratio = target / words if words else 0.0
        whole = min(int(ratio + 1e-9), most)
        plan.append((r["source"], sid, words, target, whole, max(0.0, ratio - whole), r["n"]))
    spark = docs.sparkSession
    table = spark.createDataFrame(plan, "src string, sid int, source_size long, target double, whole int, chance double, n long")
    held = F.broadcast(table) if len(plan) <= BROADCAST_SOURCES else table
    open_ = units.join(held, units["source"].eqNullSafe(held["src"])).where((F.col("size") > 0) & (F.col("chance") > EDGE))
    reserve = F.col("reserve") < F.greatest(F.least(F.lit(0.5), RESERVE / F.col("n")), LEAST_RESERVE / F.col("n"))
    dealt = open_.withColumn("reserve", _uniform(1)).select("doc_id", "source", "h", "size", "m", "sid", "chance", "n", reserve.alias("kept_back"))
    first = dealt.where(~F.col("kept_back")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    back = dealt.where("kept_back").select(*[c.split()[0] for c in ROW.split(", ")])
    done, level = _level(first, 0, F.col("blocks")), 0
    closed = [done]
    still = (F.col("chance") > 0) & (F.col("chance") < 1)
    while (done.where(still).groupBy("sid").count().agg(F.max("count")).first()[0] or 0) > ROOT_ROWS:
        level += 1
        left = done.where(still)
        many = left.groupBy("sid").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        done = _level(left.join(many, "sid"), level, F.col("blocks"))
        closed.append(done)
    root = _root(done.where(still).unionByName(back))
    rounded = root
    for x in closed:
        rounded = rounded.unionByName(x.where(~still))
    rounded = rounded.select("doc_id", "source", "h", "size", F.col("chance").cast("int").alias("more"))
    keys = [units[c].eqNullSafe(rounded[c]) for c in ("doc_id", "source", "h", "size")]
    joined = units.join(rounded, keys, "left").select(*(units[c] for c in units.columns), "more")
    out = joined.join(held, joined["source"].eqNullSafe(held["src"]))
    copies = (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long")
    return out.select("doc_id", "source", "h", "size", "m", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies`` (1 to ``most``).

    Texts without words (null, empty) count nothing and are not taken.  Null sources
    form one source, the last.  Repeated rows each stay a row and get the same number.
    The outcome depends on the rows alone, not on how they are partitioned.  An empty
    table gives no rows; a column named ``copies`` is replaced.
    """
    chosen = copies_of(docs, weights, most).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("h").alias("_h"), "copies")
    base = docs.drop("copies").withColumn("_text", F.xxhash64("text"))
    on = base["doc_id"].cast("long").eqNullSafe(chosen["_id"]) & base["source"].eqNullSafe(chosen["_source"]) & (base["_text"] == chosen["_h"])
    return base.join(chosen, on).drop("_id", "_source", "_h", "_text")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    found = copies_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
