"""The corpus pipeline, each stage against brute force on its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from . import brute
from .test_shingles import plain_kept

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SMALL).persist())
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "source_mix"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns and df.schema.simpleString() == stages[0].schema.simpleString()
    assert stages[5].columns == [*stages[0].columns, "copies"]


def test_language_keeps_prose(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert len(after) >= 0.97 * len(before) and all(before[i] == t for i, t in after.items())


def test_one_of_each_group_stays(stages):
    """All pairs of exact sets of five-word shingles, linked at a similarity of 0.8."""
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) == plain_kept(before) and set(after) < set(before)


def test_repeats_are_cut(stages):
    before, after = texts(stages[2]), texts(stages[3])
    want = brute.strip_repeats(list(before.items()))
    for i, (n, removed, _) in want.items():
        if removed == 0:
            assert after[i] == before[i]
        elif removed == n:
            assert i not in after
        else:
            assert len(brute.words(after[i])) == n - removed
    assert stages[3].where(F.col("n_chars") != F.length("text")).count() == 0


def test_leaks_go(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    leaky = {i for i, t in before.items() if any(x in t for x in items)}
    assert leaky and set(before) - set(after) == leaky


def test_mix_is_of_kept_documents(stages):
    before = texts(stages[4])
    rows = stages[5].collect()
    assert rows and all(before[r["doc_id"]] == r["text"] and 1 <= r["copies"] <= 3 for r in rows)
    size = sum(len(brute.words(t)) for t in before.values())
    assert abs(sum(len(brute.words(r["text"])) * r["copies"] for r in rows) - size) < 0.15 * size


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].collect()))
