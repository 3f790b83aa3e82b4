"""Arrow folders, changes in one step, caches and copies."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.sources import arrow_folder as A
from keelson.sources import publish as P
from keelson.sources import readers as R
from keelson.sources import writers as W

NESTED = "id long, name string, image struct<bytes:binary,path:string>, boxes array<struct<x:double,y:double>>, tags map<string,int>, at timestamp, split string"


@pytest.fixture
def nested(spark):
    from datetime import datetime

    rows = [(k, None if k % 7 == 3 else f"n{k}", (bytes([k]), None), [(1.5 * k, None)] * (k % 3), {"a": k} if k % 2 else None, datetime(2020, 1, 1 + k % 28, 3), "train" if k % 4 else "val") for k in range(60)]
    return spark.createDataFrame(rows, NESTED).repartition(5)


def tidy(df):
    return sorted((repr(r) for r in df.collect()))


def test_round_trip(spark, tmp_path, nested):
    path = str(tmp_path / "set")
    A.save_arrow(nested.drop("split"), path)
    got = A.read_arrow(spark, path)
    assert got.schema.simpleString() == nested.drop("split").schema.simpleString() and tidy(got) == tidy(nested.drop("split"))
    assert got.rdd.getNumPartitions() == 5 == len(json.loads((tmp_path / "set" / A.STATE).read_text())[A.FILES])
    assert sorted(os.listdir(path)) == sorted([A.STATE, A.INFO, *(x[A.FILE] for x in json.loads((tmp_path / "set" / A.STATE).read_text())[A.FILES])])


def test_splits(spark, tmp_path, nested):
    path = str(tmp_path / "set")
    A.save_arrow(nested, path, "split")
    assert A.splits_of(path) == ["train", "val"]
    assert tidy(A.read_arrow(spark, path)) == tidy(nested)
    assert tidy(A.read_arrow(spark, path, "val").drop("split")) == tidy(nested.where("split = 'val'").drop("split"))
    assert tidy(R.dataset(spark, path, "val")) == tidy(nested.where("split = 'val'"))
    with pytest.raises(Exception, match="no split test"):
        A.read_arrow(spark, path, "test").count()


def test_by_sparks_own_readers(spark, tmp_path, nested, monkeypatch):
    """Where pyarrow can't open a path."""
    flat, path = str(tmp_path / "flat"), str(tmp_path / "set")
    A.save_arrow(nested.drop("split"), flat)
    A.save_arrow(nested, path, "split")

    def unknown(_):
        raise pa.ArrowInvalid("Unrecognized filesystem type")

    monkeypatch.setattr(A, "file_system", unknown)
    assert tidy(A.read_arrow(spark, flat)) == tidy(nested.drop("split")) and tidy(A.read_arrow(spark, path)) == tidy(nested)
    assert tidy(A.read_arrow(spark, path, "val").drop("split")) == tidy(nested.where("split = 'val'").drop("split"))
    with pytest.raises(FileNotFoundError):
        A.read_arrow(spark, path, "none")


def test_a_failed_task_leaves_what_was_there(spark, tmp_path, nested):
    path = str(tmp_path / "set")
    fails = nested.withColumn("name", F.when(F.col("id") == 59, F.raise_error(F.lit("broken row"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken row"):
        A.save_arrow(fails, path, "split")
    assert os.listdir(tmp_path) == []
    A.save_arrow(nested, path, "split")
    with pytest.raises(Exception, match="broken row"):
        A.save_arrow(fails, path, "split")
    assert os.listdir(tmp_path) == ["set"] and tidy(A.read_arrow(spark, path)) == tidy(nested)
    A.save_arrow(nested.where("id < 10"), path, "split")
    assert A.read_arrow(spark, path).count() == 10 and os.listdir(tmp_path) == ["set"]


def test_files_of_other_writers(spark, tmp_path):
    """Dictionaries, large and fixed-size types, unsigned numbers; a dataset without rows; one that isn't there."""
    table = pa.table({"c": pa.array(["x", "y", "x"]).dictionary_encode(), "t": pa.array(["a", None, "b"], pa.large_string()), "v": pa.array([[1, 2], [3, 4], None], pa.list_(pa.float32(), 2)), "u": pa.array([1, 2, 255], pa.uint8())})
    (tmp_path / "d").mkdir()
    with pa.OSFile(str(tmp_path / "d" / "data-00000-of-00001.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table, max_chunksize=2)
    (tmp_path / "d" / A.STATE).write_text(json.dumps({A.FILES: [{A.FILE: "data-00000-of-00001.arrow"}]}))
    got = A.read_arrow(spark, str(tmp_path / "d"))
    assert got.schema.simpleString() == "struct<c:string,t:string,v:array<float>,u:smallint>"
    assert [tuple(r) for r in got.collect()] == [("x", "a", [1, 2], 1), ("y", None, [3, 4], 2), ("x", "b", None, 255)]
    A.save_arrow(got.where("u > 999"), str(tmp_path / "none"))
    assert A.read_arrow(spark, str(tmp_path / "none")).schema == got.schema and A.read_arrow(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no dataset"):
        A.read_arrow(spark, str(tmp_path / "nowhere")).count()


@pytest.mark.parametrize("stop", ["written", "journal", "move old", "move new", "drop journal", "drop old", None])
def test_rewrite_stopped_after_each_step(spark, tmp_path, stop):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)

    def after(step):
        if step == stop:
            raise KeyboardInterrupt(step)

    change = lambda: P.replaced(spark, path, lambda new: spark.read.parquet(path).where("id < 2").write.parquet(new), after)
    if stop:
        with pytest.raises(KeyboardInterrupt):
            change()
    else:
        change()
    assert R.dataset(spark, path).count() == (5 if stop == "written" else 2)
    W.rewrite(spark.read.parquet(path).where("id = 1"), path)
    assert R.dataset(spark, path).count() == 1 and not [x for x in os.listdir(tmp_path) if "journal" in x]


def test_cache(spark, tmp_path):
    source, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(3).write.parquet(source)
    calls = []

    def features(n):
        calls.append(n)
        return spark.read.parquet(source).withColumn("n", F.lit(n))

    got = lambda n: R.cached(spark, cache, lambda: features(n), [source], n=n).count()
    assert [got(1), got(1), got(2), got(1)] == [3, 3, 3, 3] and calls == [1, 2]
    spark.range(7).write.mode("overwrite").parquet(source)
    assert got(1) == 7 and calls == [1, 2, 1]
    broken = lambda: spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        R.cached(spark, cache, broken, [source], n=9)
    assert R.cached(spark, cache, lambda: features(9), [source], n=9).count() == 7
    assert len(os.listdir(cache)) == 4 and not [x for x in os.listdir(cache) if x.startswith("_")]


def test_copies(spark, tmp_path):
    (tmp_path / "a").mkdir()
    rows = []
    for k in range(20):
        (tmp_path / "a" / f"{k}.bin").write_bytes(bytes([k]) * (k * 1000 + 1))
        rows.append((f"{tmp_path}/a/{k}.bin", f"{tmp_path}/b/{k % 3}/{k}.bin"))
    rows += [(f"file://{tmp_path}/a/nowhere", f"{tmp_path}/b/x"), (f"{tmp_path}/a/5.bin", f"{tmp_path}/b/1/4.bin")]
    (tmp_path / "b" / "0").mkdir(parents=True)
    (tmp_path / "b" / "0" / "3.bin").write_bytes(b"half")  # of a run that was killed
    (tmp_path / "b" / "0" / "6.bin.draft-of-copy-1234").write_bytes(b"half")
    manifest = spark.createDataFrame(rows, "source string, destination string").repartition(4)
    count = lambda df: {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}
    assert count(P.copy_files(manifest, str(tmp_path / "record"))) == {"copied": 20, "missing": 1, "conflict": 1}
    assert count(P.copy_files(manifest, str(tmp_path / "record"))) == {"there": 20, "missing": 1, "conflict": 1}
    for k in range(20):
        assert (tmp_path / "b" / str(k % 3) / f"{k}.bin").read_bytes() == (tmp_path / "a" / f"{k}.bin").read_bytes()
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "b")) == 20
