"""Properties of samples and quotas, over generated class sizes."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.functions import text as X
from keelson.operators import sampling
from keelson.plans import builders as P

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
sizes = st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 30), min_size=1)


def frame(spark, n):
    rows = [(c, f"{c}{k}") for c, m in n.items() for k in range(m)]
    return spark.createDataFrame(rows, "c string, id string")


@few
@given(n=sizes, k=st.integers(1, 12))
def test_kshot(spark, n, k):
    df = frame(spark, n)
    small, large = ({r["id"] for r in sampling.k_shot(df, "c", "id", x).collect()} for x in (k, k + 3))
    assert small <= large and len(small) == sum(min(k, m) for m in n.values())
    assert small == {r["id"] for r in sampling.k_shot(df.repartition(5), "c", "id", k).collect()}


@few
@given(n=sizes, total=st.integers(0, 60))
def test_quotas(spark, n, total):
    counts = frame(spark, n).groupBy("c").count().withColumnRenamed("count", "n")
    got = {r["c"]: r["quota"] for r in sampling.quotas(counts, "c", F.lit(total)).collect()}
    assert sum(got.values()) == total
    assert all(abs(got[c] - total * m / sum(n.values())) <= 1 for c, m in n.items())


@few
@given(n=sizes, target=st.integers(1, 40), coverage=st.floats(0, 1))
def test_balanced(spark, n, target, coverage):
    got = sampling.balanced_sample(frame(spark, n), "c", "id", target, coverage).collect()
    assert len(got) <= target and len({r["id"] for r in got}) == len(got)
    covered = min(int(len(n) * coverage), len(n), target)
    assert len({r["c"] for r in got if r["round"] == 1}) == covered


@few
@given(n=sizes)
def test_splits(spark, n):
    df = frame(spark, n)
    got = sampling.split_per_class(df, "c", "id", 0.25).collect()
    assert len(got) == sum(n.values())
    for c, m in n.items():
        assert sum(r["split"] == "val" for r in got if r["c"] == c) == (0 if m < 2 else -(-m // 4))
    test = sampling.stratified_split(df, "c", "id", 0.2).where("split = 'test'").collect()
    many = sum(m for m in n.values() if m > 1)
    assert len(test) == -(-many // 5) and not any(n[r["c"]] == 1 for r in test)


@few
@given(body=st.text(st.characters(blacklist_characters="<>", blacklist_categories=("Cs", "Cc")), max_size=20))
def test_tag_round_trip(spark, body):
    got = spark.createDataFrame([(body,)], "b string").select(X.answer(P.tagged("answer", F.col("b"))), X.stripped(F.col("b"))).first()
    assert got[0] == got[1]
