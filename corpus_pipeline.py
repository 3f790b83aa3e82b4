"""Corpus pipeline: documents to a deduplicated, decontaminated, mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``; the last adds ``copies``, how often the mix takes
the document.  Every stage takes nulls in any column, empty and very long texts and
repeated rows, and returns no rows for an empty table; what becomes of such rows stands
with each.  Columns beyond those of ``documents`` pass through, except ``lang_pred`` and
``score`` (language_id) and an own ``copies`` (source_mix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import decontam, langid, mixing, shingles, substring
from keelson.llm.scratch import drop, stored

LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows: some letter, and a mean probability of 0.4 or more.

    Null and empty texts go; without a labelled text all do.
    """
    return langid.known_language(docs, langid.fit(docs.where(~langid.held_out())), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies: 0.8 of their five-word shingles in common.

    Texts without words (null, empty) are copies of each other.  Rows with a null doc_id stay;
    rows that share the least doc_id of a group all stay.
    """
    return shingles.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; ``n_chars`` follows the text.

    Of equal rows the first keeps its words; rows that lose all go, null and empty texts stay.
    """
    out = substring.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies; those without words are never taken."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: A trained network, fingerprints and random rounding have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        docs = stored(stage(spark, docs, sf_dir), name)
        if k:
            drop(before)
    return docs
