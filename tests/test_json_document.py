"""JSON documents read in byte ranges against the whole document."""

from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest

from keelson.sources import json_document as J
from keelson.sources import readers as R


def anything(rnd, deep=0):
    kind = rnd.random()
    if kind < 0.2 and deep < 4:
        return {text(rnd): anything(rnd, deep + 1) for _ in range(rnd.randint(0, 4))}
    if kind < 0.4 and deep < 4:
        return [anything(rnd, deep + 1) for _ in range(rnd.randint(0, 4))]
    return rnd.choice([text(rnd), rnd.random(), None, True, rnd.randint(-9, 9)])


def text(rnd):
    return "".join(rnd.choice(['"', "\\", "{", "}", "[", "]", ":", ",", "é", "中", "😀", "a", "b", " ", "\n", "/", '\\"']) for _ in range(rnd.randint(0, 9)))


def objects(value, level, key=None, at=0):
    """What members() is to give, by walking the document."""
    if at == level:
        return [(key, value)] if isinstance(value, dict) else []
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in objects(v, level, k, at + 1)]
    return [x for v in value for x in objects(v, level, key, at + 1)] if isinstance(value, list) else []


def same(got, want):
    tidy = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert tidy((None if r["key"] is None else json.loads(f'"{r["key"]}"'), json.loads(r["value"])) for r in got) == tidy(want)


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "331")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def by_ranges(content, level, rnd):
    """The two passes over random ranges of fragments, without Spark."""
    fragments = content.split("}")
    blocks, at = [], 0
    while len(blocks) < len(fragments):
        blocks += [at] * rnd.choice([1, 1, 2, 5, 30])
        at += 1
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(fragments), pa.array(["f"] * len(fragments)), pa.array(blocks[: len(fragments)])], ["value", "file", "block"])])
    sums = [r for b in J._sums(batches()) for r in b.to_pylist()]
    parts = [r for b in J._parts(batches(), J._starts(sums, level), level) for r in b.to_pylist()]
    starts = {block: x for _, block, *x in J._keys_at_starts([r for r in parts if r["kind"] >= J.LAST_KEY], level)}
    found = [r for r in parts if r["kind"] == J.WHOLE]
    for owner in {r["owner"] for r in parts if r["kind"] == J.PART}:
        own = sorted((r for r in parts if r["kind"] == J.PART and r["owner"] == owner), key=lambda r: r["block"])
        found.append(own[0] | {"block": owner, "value": "".join(r["value"] for r in own)})
    inner = lambda r: r["key"] if r["origin"] == J.HERE else starts[r["block"]][1] if r["origin"] == J.ACROSS else starts[r["block"]][0][r["origin"] - 1]
    return [{"key": inner(r), "value": r["value"]} for r in found if r["value"][0] == "{"]


@pytest.mark.parametrize("seed", range(300))
def test_any_ranges(monkeypatch, seed):
    """Strings with brackets and escapes, and objects and keys over many ranges."""
    rnd = random.Random(seed)
    monkeypatch.setattr(J, "BYTES", rnd.choice([1, 30, 4 << 20]))
    doc = [anything(rnd) for _ in range(40)] if seed % 2 else {f"{k} {text(rnd)}": anything(rnd) for k in range(40)}
    content = json.dumps(doc, ensure_ascii=seed % 3 == 0, indent=rnd.choice([None, 2]))
    for level in (1, 2, 3):
        same(by_ranges(content, level, rnd), objects(doc, level))


def test_any_document(spark, tmp_path, small_ranges):
    rnd = random.Random(12)
    doc = {f"{k} {text(rnd)}": anything(rnd) for k in range(60)}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc, ensure_ascii=False))
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 5
    same(J.members(spark, str(path), 2).collect(), objects(doc, 2))


def test_long_objects_and_keys(spark, tmp_path, small_ranges):
    doc = {"a}" * 300: {"x": "}" * 2000, "y": [{"z": 1}] * 50}, "plain": {"k": 1}, "n": 5, "b}" * 200: [1, {"q": "\\"}]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc))
    for level in (1, 2, 3):
        same(J.members(spark, str(path), level).collect(), objects(doc, level))


@pytest.mark.parametrize("content,want", [("", []), ("[]", []), ("{}", []), ('﻿[{"a": 1}]\n', [(None, {"a": 1})]), ("[1, null, [{}]]", [])])
def test_small_documents(spark, tmp_path, content, want):
    path = tmp_path / "d.json"
    path.write_text(content)
    same(J.members(spark, str(path), 1).collect(), want)


def test_several_files(spark, tmp_path, small_ranges):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"file": k, "n": n, "t": "x{" * n} for n in range(40)]))
    got = J.members(spark, str(tmp_path), 1).selectExpr("from_json(value, 'file long, n long') AS r").select("r.*").collect()
    assert sorted(map(tuple, got)) == [(k, n) for k in range(3) for n in range(40)]


def test_conditions_on_fields_are_met_above_the_parser(spark, tmp_path):
    """Members of other keys aren't parsed, and no object is parsed again for a condition or a join."""
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}], "annotations": [{"id": n, "image_id": n % 2, "area": n} for n in range(9)], "categories": []}))
    images, annotations, _ = R.coco(spark, str(path))
    met = annotations.where("area > 2").join(images, "image_id")
    assert sorted(r["annotation_id"] for r in met.collect()) == [3, 5, 7]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "from_json" in line]


def test_objects_are_cut_together(monkeypatch):
    """Objects of one key leave a range in one batch for all the bytes scanned together, whatever else is among them."""
    monkeypatch.setattr(J, "_batch", lambda rows, schema: pytest.fail("row by row") if len(rows) > 9 else pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema))
    doc = {"a": [{"k": n, "t": "}{" * (n % 3), "in": [{}, {"x": [n]}]} for n in range(500)] + [7, [{}], None], "b": [{"k": -1}]}
    fragments = json.dumps(doc).split("}")
    whole = lambda: iter([pa.RecordBatch.from_arrays([pa.array(fragments), pa.array(["f"] * len(fragments)), pa.array([0] * len(fragments))], ["value", "file", "block"])])
    sums = [r for b in J._sums(whole()) for r in b.to_pylist()]
    batches = [b for b in J._parts(whole(), J._starts(sums, 2), 2) if J.WHOLE in b.column("kind").to_pylist()]
    assert [b.num_rows for b in batches] == [501]
    same([r for b in batches for r in b.to_pylist()], objects(doc, 2))
