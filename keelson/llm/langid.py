"""Language identification by a byte convolutional network trained in numpy.

A text is cut into consecutive windows of ``WINDOW`` bytes (the last one padded), so
whole texts are read, never prefixes.  Each window passes byte embeddings, filters of
several widths, a rectifier, the maximum over positions and a softmax layer; window
log-probabilities, weighted by the bytes in each window, are summed for the text.

The network is fitted on the driver on a bounded sample of labelled rows:
``PER_LANGUAGE`` texts of every language, fewer of each where that makes more than
``MAX_ROWS`` (but one at least), of each text one passage of ``PASSAGE`` characters,
chosen by hashes.
Everything else reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import chunks, raw_text

WINDOW = 192
WIDTHS, FILTERS, EMBED = (2, 3, 4, 5), 10, 8
PER_LANGUAGE, MAX_ROWS, PASSAGE = 500, 32_000, 600
SPARE, SPARE_ROWS = 3, 20  # times the rows needed, and so many more, pass the first cut
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.01, 7
SCORED_AT_ONCE = 384  # windows
UNKNOWN, PAD = "und", 256


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (257, EMBED); 256 is padding
    conv: np.ndarray  # (max width * EMBED, filters)
    conv_bias: np.ndarray
    dense: np.ndarray  # (filters, languages)
    dense_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes at each position and after it: (windows * positions, max width * EMBED)."""
        wide = max(WIDTHS)
        padded = np.full((len(windows), WINDOW + wide - 1), PAD, np.int64)
        padded[:, :WINDOW] = windows
        x = self.embed[padded]
        view = np.lib.stride_tricks.sliding_window_view(x, wide, axis=1)  # n, positions, EMBED, wide
        return view.transpose(0, 1, 3, 2).reshape(-1, wide * EMBED)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        patches = self.patches(windows)
        out = (patches @ self.conv).reshape(len(windows), WINDOW, -1)
        at = out.argmax(axis=1)
        top = np.take_along_axis(out, at[:, None, :], axis=1)[:, 0, :] + self.conv_bias
        return np.maximum(top, 0), at, patches

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = (self.patches(windows) @ self.conv).reshape(len(windows), WINDOW, -1).max(axis=1)
        return log_softmax(np.maximum(out + self.conv_bias, 0) @ self.dense + self.dense_bias)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _mask() -> np.ndarray:
    """Which of a filter's weights are its own: a filter of width w reads w bytes."""
    keep = np.zeros((max(WIDTHS), EMBED, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        keep[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
    return keep.reshape(-1, len(WIDTHS) * FILTERS)


def window_index(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, first byte and number of bytes of every window of all texts."""
    n = -(-np.diff(off) // WINDOW)
    doc = np.repeat(np.arange(len(n)), n)
    begin = off[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    return doc, begin, np.minimum(off[doc + 1] - begin, WINDOW)


def window_bytes(raw: np.ndarray, begin: np.ndarray, full: np.ndarray) -> np.ndarray:
    inside = np.arange(WINDOW) < full[:, None]
    out = np.full(inside.shape, PAD, np.int64)
    out[inside] = raw[(begin[:, None] + np.arange(WINDOW))[inside]]
    return out


def train(texts: list[str], labels: list[str]) -> Network | None:
    """Fit the network; texts are cut into windows, all with their text's label.  No texts: None."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(SEED)
    raw, off = raw_text(pa.array(texts, pa.string()))
    doc, begin, full = window_index(off)
    x = window_bytes(raw, begin, full)
    y = np.searchsorted(np.array(languages, object), np.array(labels, object)[doc])
    total = len(WIDTHS) * FILTERS
    f32 = np.float32
    mask = _mask()
    net = Network(
        languages,
        rng.normal(0, 0.5, (257, EMBED)).astype(f32),
        rng.normal(0, 0.25, (max(WIDTHS) * EMBED, total)).astype(f32) * mask,
        np.zeros(total, f32),
        rng.normal(0, 0.1, (total, len(languages))).astype(f32),
        np.zeros(len(languages), f32),
    )
    net.embed[PAD] = 0
    values = [net.embed, net.conv, net.conv_bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    wide = max(WIDTHS)
    weight = np.bincount(y, minlength=len(languages)).astype(f32)
    weight = weight.sum() / np.maximum(weight, 1) / len(languages)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            w = x[pick].copy()
            cut = rng.random(len(pick)) < 0.3  # short texts have to be known, too
            w[cut[:, None] & (np.arange(WINDOW) >= rng.integers(24, WINDOW, len(pick))[:, None])] = PAD
            top, where, patches = net.pooled(w)
            logp = log_softmax(top @ net.dense + net.dense_bias)
            d_z = np.exp(logp)
            d_z[np.arange(len(pick)), y[pick]] -= 1
            d_z *= weight[y[pick]][:, None] / len(pick)
            d_top = (d_z @ net.dense.T) * (top > 0)
            rows = (np.arange(len(pick))[:, None] * WINDOW + where).ravel()
            chosen = patches[rows].reshape(len(pick), total, -1)
            d_conv = np.einsum("nf,nfk->kf", d_top, chosen) * mask
            d_patch = d_top[:, :, None] * net.conv.T[None]
            d_embed = np.zeros_like(net.embed)
            padded = np.full((len(pick), WINDOW + wide - 1), PAD, np.int64)
            padded[:, :WINDOW] = w
            which = padded[np.repeat(np.arange(len(pick)), total)[:, None], (where.ravel()[:, None] + np.arange(wide))]
            np.add.at(d_embed, which.ravel(), d_patch.reshape(-1, EMBED))
            d_embed[PAD] = 0
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for v, g, m, s in zip(values, [d_embed, d_conv, d_top.sum(0), top.T @ d_z, d_z.sum(0)], first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(f32)
    return net


def training_sample(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """The bounded sample of ``labelled(doc_id, text, lang)`` that :func:`train` gets, in an order of its own.

    Of each language the rows with the least hashes; a first cut by the hash leaves a
    few times as many, so rows of a language that meet for the ranking are few, too.
    """
    named = labelled.where("text is not null and lang is not null and length(text) > 0")
    known = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not known:
        return [], []
    each = max(1, min(PER_LANGUAGE, MAX_ROWS // len(known)))
    h = F.xxhash64("doc_id", "text")
    share = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], (SPARE * each + SPARE_ROWS) / r["count"])])
    low = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53) < F.try_element_at(share, F.col("lang"))
    part = F.expr(f"substring(text, 1 + pmod(xxhash64(text), greatest(1, length(text) - {PASSAGE})), {PASSAGE})")
    chosen = named.where(low).select("lang", h.alias("h"), part.alias("text"))
    best = Window.partitionBy("lang").orderBy("h", "text")
    rows = chosen.withColumn("k", F.row_number().over(best)).where(F.col("k") <= each).orderBy("lang", "k").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predict(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        column = part.column("text")
        raw, off = raw_text(column)
        n = len(column)
        letter = np.array([_has_letter(t) for t in column.to_pylist()], bool)
        if net is None:
            letter[:] = False
        names = net.languages if net else [UNKNOWN]
        evidence, chance = np.zeros((n, len(names))), np.zeros((n, len(names)))
        doc, begin, full = window_index(off)
        for at in range(0, len(doc) if net else 0, SCORED_AT_ONCE):
            some = slice(at, at + SCORED_AT_ONCE)
            logp = net.log_probabilities(window_bytes(raw, begin[some], full[some]))
            np.add.at(evidence, doc[some], logp * full[some, None])
            np.add.at(chance, doc[some], np.exp(logp) * full[some, None])
        best = evidence.argmax(axis=1)
        score = chance[np.arange(n), best] / np.maximum(np.diff(off), 1)
        found = [names[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
        arrays = [found, np.where(letter, np.clip(score, 0, 1), 0.0)]
        rest = [part.column(k) for k in range(part.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(arrays[0], pa.string()), pa.array(arrays[1])], [*part.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the text alone decides.

    ``lang_pred`` is one of the network's languages, or ``und`` with score 0 where the
    text is null, empty or has no letter, or where no network could be trained.
    ``score`` is the byte-weighted mean probability of that language over the windows.
    Repeated rows are each returned, an empty table gives no rows, and columns of
    ``docs`` named like the two results are replaced.
    """
    source = docs.drop("lang_pred", "score")
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(partial(_predict, net=net), schema)


def fit(docs: DataFrame) -> Network | None:
    """Train on labelled rows of ``docs(doc_id, text, lang)``."""
    return train(*training_sample(docs.select("doc_id", "text", "lang")))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4 (null: it is)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def known_language(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """Rows of ``docs`` whose language is known with a score of ``least`` or more; columns as before."""
    return identify(docs, net).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by a network that has not seen the held-out ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
