from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names of results."""
    long_text = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    rows = [
        (1, "the cat sat on the mat and the dog sat on the log while it rained all day long in the old town", "en", "a", 9),
        (1, "the cat sat on the mat and the dog sat on the log while it rained all day long in the old town", "en", "a", 9),
        (2, None, "en", None, None),
        (3, "", None, "b", 0),
        (None, "a text without any number of its own", "en", "b", 3),
        (5, long_text, "de", "a", len(long_text)),
        (6, " \t\n\x0b\x0c\r ", "fr", "a", 7),
        (7, "###$$$%%%    !!!", "fr", "a", 7),
        (8, "le chat est sur la table avec le chien et la souris dans la maison de la rue", "fr", None, 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("fingerprint", "component_id", "kept", "copies", "lang_pred", "score", "runs", "_runs", "fp", "h", "_key", "n_words"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
