"""Running sums, ids and gaps over ranges against plain Python."""

from __future__ import annotations

import random
import re
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from keelson.operators import sampling, windows


@pytest.fixture(scope="module")
def mixed(spark):
    """One class with half the rows, ties, nulls, and strings that share long beginnings."""
    rnd = random.Random(5)
    names = [None, "", *("common/" * 5 + str(k) for k in range(3000)), *(chr(0x4E00 + k) for k in range(50))]
    rows = [(k, "hot" if k % 2 else f"c{k % 7}", rnd.choice([None, rnd.randint(0, 9000)]) if k % 9 == 0 else 2 * k // 3, rnd.choice(names), rnd.choice([None, -1.5, 2.0, 4.25])) for k in range(6000)]
    return rows, spark.createDataFrame(rows, "id long, c string, i long, name string, x double").repartition(6).persist()


def test_running_sums(mixed):
    rows, df = mixed
    for bucket in (sampling.range_bucket(df, "id"), sampling.sampled_ranges(df, "id")):
        got = {r["id"]: (r["n"], r["total"]) for r in sampling.with_running(df, ["id"], bucket, n=F.lit(1), total=F.col("x")).collect()}
        total = list(accumulate(r[4] or 0.0 for r in rows))
        assert got == {k: (k + 1, total[k]) for k in range(len(rows))}


def test_ids_of_strings(mixed):
    rows, df = mixed
    by_name = {r["name"]: r["id"] for r in windows.sorted_ids(df.select("name"), "name").collect()}
    want = sorted({r[3] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    assert by_name == {x: k for k, x in enumerate(want)}
    first = {}
    for r in rows:
        first.setdefault(r[3], r[0])
    assert {r["name"]: r["k"] for r in windows.first_seen_ids(df.select("name", "id"), "name", "id", "k").collect()} == {x: k for k, x in enumerate(sorted(first, key=first.get))}


def test_first_seen_ties(spark):
    df = spark.createDataFrame([("b", 1, 2), ("a", 1, 2), ("c", 1, 1)], "v string, p int, q int").withColumn("o", F.struct("p", "q"))
    assert {r["v"]: r["id"] for r in windows.first_seen_ids(df, "v", "o").collect()} == {"c": 0, "a": 1, "b": 2}


def test_gaps(mixed):
    rows, df = mixed
    got = sorted((r["id"], r["previous"]) for r in windows.gaps(df, "c", "i").collect() if r["previous"] != r["i"])
    want = []
    for c in {r[1] for r in rows}:
        own = sorted({r[2] for r in rows if r[1] == c and r[2] is not None})
        ids = {}
        for r in rows:
            if r[1] == c:
                ids.setdefault(r[2], []).append(r[0])
        want += [(b, a) for a, b in zip(own, own[1:], strict=False) if b - a != 1]
    back = {(r[0]): r for r in rows}
    assert sorted((back[k][2], p) for k, p in got) == sorted(want)


def test_no_window_over_everything(mixed):
    """Windows stand over buckets, or over one row for each of them."""
    _, df = mixed
    for out in (windows.sorted_ids(df, "name"), windows.running_accuracy(df, "id", F.col("x") > 0), windows.first_seen_ids(df, "name", "id")):
        first = re.findall(r"windowspecdefinition\((\w+)#", out._jdf.queryExecution().optimizedPlan().toString())
        assert first and set(first) == {"_bucket"}


def test_empty(spark):
    none = spark.createDataFrame([], "id long, c string, i long, name string, x double")
    assert windows.sorted_ids(none, "name").collect() == [] and windows.gaps(none, "c", "i").collect() == []
    assert windows.running_accuracy(none, "id", F.col("x") > 0).collect() == []
