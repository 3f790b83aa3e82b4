"""Maps by user functions, and whole and broken images."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from keelson.functions import images
from keelson.operators import maps


@maps.map_function("size int, word string")
def first_word(row):
    if row["t"] is None:
        return None
    if row["t"].startswith("!"):
        raise ValueError(f"bad row {row['id']}")
    return {"size": len(row["t"]), "word": (row["t"].split() or [None])[0]}


@maps.map_function("half double", by_batch=True)
def halved(batch):
    if pc.any(pc.equal(batch.column("id"), 13)).as_py():
        raise KeyError("thirteen")
    return [pc.divide(pc.cast(batch.column("id"), pa.float64()), 2)]


@maps.map_function("word string")
def upper(row):
    return None if row["word"] == "w4" else {"word": row["word"] and row["word"].upper()}


@maps.map_function("size int")
def wrong(row):
    return {"size": "many"}


@pytest.fixture(scope="module")
def rows(spark):
    texts = {3: None, 5: "!oops", 7: "", 13: "!unlucky"}
    return spark.createDataFrame([(k, texts.get(k, f"w{k} rest")) for k in range(40)], "id long, t string").repartition(3)


def test_rows(rows):
    got = {r["id"]: (r["size"], r["word"], r["error"]) for r in maps.map_rows(rows, "first_word").collect()}
    assert set(got) == set(range(40)) - {3}
    assert got[5] == (None, None, "ValueError: bad row 5") and got[7] == (0, None, None) and got[9] == (7, "w9", None)


def test_batches_are_halved_to_the_row(rows, monkeypatch):
    monkeypatch.setattr(maps, "AT_ONCE", 8)
    got = {r["id"]: (r["half"], r["error"]) for r in maps.map_rows(rows, "halved", "why").withColumnRenamed("why", "error").collect()}
    assert got.pop(13) == (None, "KeyError: 'thirteen'") and got == {k: (k / 2, None) for k in range(40) if k != 13}


def test_errors_may_end_the_job(rows):
    with pytest.raises(Exception, match="first_word failed on .*!"):
        maps.map_rows(rows, "first_word", error=None).collect()
    assert maps.map_rows(rows.where("id > 20"), "first_word", error=None).columns == ["id", "t", "size", "word"]
    with pytest.raises(Exception, match="wrong returned what it didn't declare"):
        maps.map_rows(rows, "wrong").collect()


def test_chain(rows):
    got = {r["id"]: (r["word"], r["error"]) for r in maps.map_chain(rows, "first_word", "upper").collect()}
    assert set(got) == set(range(40)) - {3, 4} and got[13] == (None, "ValueError: bad row 13") and got[8] == ("W8", None)


def test_empty(spark, rows):
    assert maps.map_rows(rows.where("id < 0"), "first_word").collect() == [] and maps.map_rows(rows.where("id = 3"), "first_word").collect() == []
    assert maps._by_batch(pa.RecordBatch.from_pylist([], pa.schema([("id", pa.int64())])), halved, ["half"]) == []


def jpeg(rnd):
    """Segments, a table, a frame, two scans with stuffed bytes, restarts and fillers, and the end."""
    part = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    coded = lambda: b"".join(bytes([b]) + b"\0" * (b == 255) for b in rnd.randbytes(400)) + b"\xff\xd3" + rnd.randbytes(9).replace(b"\xff", b"a")
    return b"\xff\xd8" + part(0xE0, b"JFIF\0" + bytes(9)) + part(0xDB, bytes(65)) + b"\xff" + part(0xC0, bytes(15)) + part(0xC4, b"\xff\xd9" * 9) + part(0xDA, bytes(10)) + coded() + part(0xDA, bytes(10)) + coded() + b"\xff\xd9"


def test_images():
    rnd = random.Random(1)
    whole = images.png(9, [rnd.randbytes(9) for _ in range(7)])
    assert images.is_whole(whole) and images.is_whole(whole + b"more")
    assert not any(images.is_whole(whole[:k]) for k in range(len(whole)))
    for k in range(len(whole)):
        assert not images.is_whole(whole[:k] + bytes([whole[k] ^ 4]) + whole[k + 1 :])
    photo = jpeg(rnd)
    assert images.is_whole(photo) and images.is_whole(photo + b"tail")
    assert not any(images.is_whole(photo[:k]) for k in range(len(photo)))
    assert not images.is_whole(photo[:2] + b"xx" + photo[4:]) and not images.is_whole(b"GIF89a") and not images.is_whole(b"") and images.is_whole(None) is None
    short = images.png(9, [rnd.randbytes(9) for _ in range(7)][:6]).replace((6).to_bytes(4, "big"), (7).to_bytes(4, "big"), 1)
    assert not images.is_whole(short)


def test_decodable(spark):
    good = images.png(3, [b"abc"])
    df = spark.createDataFrame([(1, good), (2, good[:-3]), (3, None), (4, b""), (5, jpeg(random.Random(2)))], "id long, content binary")
    assert sorted(r["id"] for r in images.decodable(df).collect()) == [1, 5]
