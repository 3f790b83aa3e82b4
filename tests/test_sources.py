"""Readers and writers over temporary folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from keelson import schemas
from keelson.operators import detection
from keelson.plans import builders as P
from keelson.sources import readers as R
from keelson.sources import writers as W

VOC = """<annotation>
<filename>{name}.jpg</filename>
<size><width>400</width><height>200</height><depth>3</depth></size>{objects}</annotation>"""
OBJECT = "<object><name> {c} </name><bndbox><xmin>{x}.9</xmin><ymin>2</ymin><xmax>30</xmax><ymax>50</ymax></bndbox></object>"


@pytest.fixture
def tree(tmp_path):
    for c, names in {"kayak": ["1.jpg", "2.PNG", "3.txt"], "LNG-Tanker": ["a.bmp", "b.jpeg"], "fso": []}.items():
        (tmp_path / "images" / c).mkdir(parents=True)
        for n in names:
            (tmp_path / "images" / c / n).write_bytes(b"\xff\xd8\xff\xe0")
    return str(tmp_path / "images")


def test_image_tree(spark, tree):
    got = sorted((r["category"], r["path"].rsplit("/", 1)[1]) for r in R.image_tree(spark, tree).collect())
    assert got == [("LNG-Tanker", "b.jpeg"), ("kayak", "1.jpg"), ("kayak", "2.PNG")]
    only = spark.createDataFrame([("kayak",), ("fso",)], "category string")
    assert R.image_tree(spark, tree, categories=only).count() == 2
    table = spark.createDataFrame([("LNG_tanker", "id", 1), ("kayak", "id", 1)], "canonical string, role string, priority int")
    wide = sorted((r["canonical"], r["path"].rsplit("/", 1)[1]) for r in R.image_tree_wide(spark, tree, table).collect())
    assert wide == [("LNG_tanker", "a.bmp"), ("LNG_tanker", "b.jpeg"), ("kayak", "1.jpg"), ("kayak", "2.PNG")]
    assert R.image_tree_wide(spark, tree, table, per_class=1).count() == 2 and R.sampled_tree(spark, tree, 1).count() == 2
    assert R.with_fallbacks(R.image_tree(spark, tree), ["fso", "kayak", "cruise"], ["kayak", "LNG-Tanker"]) == ["kayak", "LNG-Tanker"]
    assert R.present(spark, [tree, tree + "/nowhere"]) == [tree]
    need = spark.createDataFrame([("1",), ("b",)], "stem string")
    found = {r["stem"]: r["found"].rsplit("/", 1)[1] for r in R.first_existing(need, R.image_tree(spark, tree), "stem").collect()}
    assert found == {"1": "1.jpg", "b": "b.jpeg"}
    with pytest.raises(Exception, match="no file for zz"):
        R.first_existing(spark.createDataFrame([("zz",)], "stem string"), R.image_tree(spark, tree), "stem").collect()
    either = R.from_either(need, spark.createDataFrame([("1", "x")], "stem string, path string"), spark.createDataFrame([("1", "y"), ("b", "z")], "stem string, path string"), "stem")
    assert {r["stem"]: r["found"] for r in either.collect()} == {"1": "x", "b": "z"}


def test_voc_to_coco(spark, tmp_path):
    for name, classes in {"b": ["fso"], "a": ["kayak", "fso"], "c": []}.items():
        (tmp_path / f"{name}.xml").write_text(VOC.format(name=name, objects="".join(OBJECT.format(c=c, x=10 + k) for k, c in enumerate(classes))))
    ann = R.voc(spark, str(tmp_path))
    assert sorted((r["filename"], r["width"]) for r in ann.collect()) == [("a.jpg", 400), ("b.jpg", 400), ("c.jpg", 400)]
    boxes = R.voc_boxes(ann)
    assert sorted((r["filename"], r["pos"], r["name"], r["xmin"]) for r in boxes.collect()) == [("a.jpg", 0, "kayak", 10), ("a.jpg", 1, "fso", 11), ("b.jpg", 0, "fso", 10)]
    assert sorted(r[0] for r in R.voc_classes(ann).collect()) == ["fso", "kayak"]
    images, out, cats = P.coco_from_voc(boxes)
    assert {r["name"]: r["category_id"] for r in cats.collect()} == {"fso": 0, "kayak": 1}
    assert sorted((r["annotation_id"], r["category_id"], r["bbox"]) for r in out.collect()) == [(0, 1, [10, 2, 20, 48]), (1, 0, [11, 2, 19, 48]), (2, 0, [10, 2, 20, 48])]
    assert {r["name"]: r["category_id"] for r in P.coco_from_voc(boxes, "first")[2].collect()} == {"kayak": 0, "fso": 1}


def test_coco_and_records(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 400, "height": 200}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 5, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 0}, {"id": 2, "image_id": 1, "category_id": 5, "bbox": [0, 0, 400, 200], "area": 80000, "iscrowd": 0}, {"id": 3, "image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1], "area": 1, "iscrowd": 0}],
        "categories": [{"id": 5, "name": "kayak"}, {"id": 3, "name": "fso"}],
    }
    path = str(tmp_path / "coco.json")
    open(path, "w").write(json.dumps(doc))
    images, ann, cats = R.coco(spark, path)
    assert {r["category_id"]: r["label"] for r in R.label_index(cats).collect()} == {3: 0, 5: 1}
    (rec,) = P.detection_records(images, ann, cats).collect()
    assert rec["image"] == "a.jpg" and "'kayak'" in rec["problem"]
    boxes = json.loads(rec["solution"].removeprefix("<answer>").removesuffix("</answer>"))
    assert boxes == [{"Position": [2, 10, 10, 30], "Confidence": 1.0}, {"Position": [0, 0, 1000, 1000], "Confidence": 1.0}]


def test_small_files(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("kayak \nfso\n\n")
    assert [(r["label_id"], r["name"]) for r in R.labels(spark, str(tmp_path / "labels.txt")).orderBy("label_id").collect()] == [(0, "kayak"), (1, "fso")]
    (tmp_path / "d.json").write_text('{"0": {"distance": 0.5, "nearest_id": "fso", "true_category": "fso"}, "7": {"distance": 0.1, "error": "x"}}')
    got = {r["row_id"]: (r["distance"], r["error"]) for r in R.distances(spark, str(tmp_path / "d.json")).collect()}
    assert got == {0: (0.5, None), 7: (0.1, "x")}
    (tmp_path / "p.json").write_text('[{"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "score": 0.5}]')
    assert R.predictions(spark, str(tmp_path / "p.json")).first()["score"] == 0.5
    (tmp_path / "r.json").write_text('[{"image": "a", "problem": "p", "solution": "s"}]')
    assert R.record_array(spark, str(tmp_path / "r.json")).first()["metadata"] is None
    maps = spark.createDataFrame([({"a.jpg": 3, "b.jpg": 1},)], "entries map<string,long>")
    assert sorted(map(tuple, R.manifest(maps).collect())) == [("a.jpg", 3), ("b.jpg", 1)]
    nested = spark.createDataFrame([(1, {0: [[1.0, 2.0, 4.0, 6.0, 0.9]]})], "image_id long, labels map<int,array<array<double>>>")
    flat = detection.flatten_results(nested, spark.createDataFrame([(9,)], "category_id long")).first()
    assert flat["category_id"] == 9 and flat["bbox"] == [1, 2, 3, 4]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "val")], "id long, c string, split string")
    path = str(tmp_path / "set")
    W.save_dataset(df, path)
    assert R.dataset(spark, path, "val").first()["id"] == 2
    flat = str(tmp_path / "flat")
    W.save_dataset(df, flat, split=None)
    W.rewrite(R.dataset(spark, flat).withColumn("c", F.upper("c")), flat)
    assert sorted(r["c"] for r in spark.read.parquet(flat).collect()) == ["A", "B"]
    lines = str(tmp_path / "lines")
    W.save_lines(df, lines, one_file=True)
    assert spark.read.schema(df.schema).json(lines).count() == 2
    W.save_document(str(tmp_path / "doc"), rows=df, names=df.select("c"))
    doc = json.loads(spark.read.text(str(tmp_path / "doc")).first()[0])
    assert len(doc["rows"]) == 2 and {x["c"] for x in doc["names"]} == {"a", "b"}
    W.save_report(df, str(tmp_path / "rep"), ["id", "c"], by="split")
    assert [r[0] for r in spark.read.text(str(tmp_path / "rep")).collect()] == ["[train]", "1\ta", "[val]", "2\tb"]
    assert W.copy_manifest(df, "c", "/to").first()["destination"] == "/to/a"
    calls = []
    compute = lambda: calls.append(1) or df
    for _ in range(2):
        assert R.cached(spark, str(tmp_path / "cache"), compute).count() == 2
    assert calls == [1]
    assert schemas.METADATA["split"].dataType == schemas.STRING
