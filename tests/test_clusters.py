"""Cluster centres and robust prototypes against numpy, class by class."""

from __future__ import annotations

import numpy as np
import pytest

from keelson.operators import vectors


def plain_centre(v: np.ndarray) -> np.ndarray:
    """Of the largest of min(2, n // 2) clusters, by Lloyd's method from a farthest-first start; of one or two rows the mean."""
    k = min(2, len(v) // 2) if len(v) >= 3 else 1
    if k == 1:
        return v.mean(0)
    far = ((v - v[0]) ** 2).sum(1).argmax()
    centres = v[[0, far]].copy()
    for _ in range(25):
        own = ((v[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.array([v[own == j].mean(0) if (own == j).any() else centres[j] for j in range(2)])
        if np.allclose(moved, centres):
            break
        centres = moved
    own = ((v[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    return centres[np.bincount(own, minlength=2).argmax()]


def plain_prototype(v: np.ndarray) -> np.ndarray:
    c = plain_centre(v)
    d = np.sqrt(((v - c) ** 2).sum(1)).round(9)
    near = v[d < d.mean() + 2 * d.std(ddof=1)] if len(v) > 1 else v[:0]
    p = near.mean(0) if len(near) else c
    return p / np.linalg.norm(p)


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(3)
    made = {f"c{n}": rng.normal(size=(n, 6)).round(3) for n in (1, 2, 3, 4, 5, 30)}
    made["hot"] = np.concatenate([rng.normal(5, 1, size=(700, 6)), rng.normal(-5, 1, size=(500, 6)), rng.normal(40, 1, size=(9, 6))]).round(3)
    made["equal"] = np.ones((7, 6))
    made["even"] = np.array([[0.0] * 6] * 3 + [[1.0] * 6] * 3)
    rows = [(c, int(k), [float(x) for x in v]) for c, vs in made.items() for k, v in enumerate(vs)]
    return made, spark.createDataFrame(rows, "c string, id int, v array<float>").repartition(7).persist()


def test_centres(classes):
    made, df = classes
    got = {r["c"]: r["proto"] for r in vectors.cluster_centres(df, "c", "v", "id", 6).collect()}
    assert set(got) == set(made)
    for c, v in made.items():
        assert np.allclose(got[c], plain_centre(v.astype(np.float32).astype(float)), atol=1e-9), c


def test_prototypes(classes):
    made, df = classes
    got = {r["c"]: r["proto"] for r in vectors.robust_prototypes(df, "c", "v", "id", 6).collect()}
    for c, v in made.items():
        assert np.allclose(got[c], plain_prototype(v.astype(np.float32).astype(float)), atol=1e-7), c


def test_missing_vectors(spark):
    """A missing vector counts as zeros where that is asked for."""
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], "id int, v array<double>")
    assert [r["z"] for r in df.orderBy("id").withColumn("z", vectors.or_zero(df["v"], 2)).collect()] == [[3.0, 4.0], [0.0, 0.0]]
    assert vectors.cluster_centres(df.where("id = 0").selectExpr("'a' AS c", "id", "v"), "c", "v", "id", 2).collect() == []


def test_query(spark):
    """The catalogue's query, class by class."""
    from keelson.plans import queries

    sf = "/root/testdata/sf0.001"
    rows = queries._few(spark, sf, 16).orderBy("vec_id").collect()
    got = {r["label"]: r for r in queries.prototype_kmeans(spark, sf).collect()}
    assert set(got) == {r["label"] for r in rows}
    for label, found in got.items():
        v = np.array([r["embedding"] for r in rows if r["label"] == label], float)
        assert found["n"] == len(v) and found["x0"] == pytest.approx(plain_prototype(v)[0], abs=2e-6)
