"""Hand-written expectations for what an oracle would share blindly."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from keelson import taxonomy
from keelson.functions import confidence as C
from keelson.functions import geometry as G
from keelson.functions import text as X
from keelson.operators import aggregates, audits, detection, joins, sampling, sets, vectors, windows
from keelson.plans import builders as P
from keelson.plans.catalogue import ORACLES, QUERIES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("value", "whole", "want"), [(1.0, 400.0, 2), (3.0, 400.0, 8), (400.0, 400.0, 1000)])
def test_half_even(spark, value, whole, want):
    assert one(spark, G.scaled_1000(F.lit(value), F.lit(whole))) == want


def test_boxes(spark):
    assert one(spark, G.corners_to_xywh(*map(F.lit, (10, 20, 30, 50)))) == [10, 20, 20, 30]
    assert one(spark, G.xywh_to_corners(*map(F.lit, (10, 20, 20, 30)))) == [10, 20, 30, 50]
    box = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, G.iou(box(0.0, 0.0, 2.0, 2.0), box(1.0, 1.0, 2.0, 2.0))) == pytest.approx(1 / 7)
    assert one(spark, G.iou(box(0.0, 0.0, 0.0, 0.0), box(0.0, 0.0, 0.0, 0.0))) == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("no tags", None), ("<answer>\n kayak \n</answer>", "kayak"), ("<answer></answer>", ""), ("<answer>a</answer><answer>b</answer>", "a"), (None, None)],
)
def test_answer(spark, text, want):
    assert one(spark, X.answer(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("a", "b", "loose", "strict"), [("", "kayak", True, False), ("tanker", "LNG_tanker", True, True), ("kayak", "fso", False, False)])
def test_match(spark, a, b, loose, strict):
    x, y = X.normalised(F.lit(a)), X.normalised(F.lit(b))
    assert one(spark, X.matches_either_way(x, y)) is loose and one(spark, X.matches_either_way(x, y, strict=True)) is strict


def test_text_functions(spark):
    assert one(spark, X.truncated_number(F.lit("12.9"))) == 12 and one(spark, X.truncated_number(F.lit("x"))) is None
    assert one(spark, X.normalised(F.lit("LNG_Tanker x"))) == "lngtankerx" and one(spark, X.normalised(F.lit("ro-ro"), hyphens=True)) == "roro"
    assert one(spark, X.category_in_prompt(F.lit("the CATEGORY \"fso\" in"))) == "fso" and one(spark, X.category_in_prompt(F.lit("none"))) is None
    assert one(spark, X.guarded_class(F.lit("[1]"))) == "unknown" and one(spark, X.guarded_class(F.lit("fso"))) == "fso"
    assert one(spark, X.confidence(F.lit("<Confidence>0.5</confidence>"))) == 0.5 and one(spark, X.confidence(F.lit("<confidence>1.2.3</confidence>"))) is None
    assert [one(spark, X.shots_in_name(F.lit(n))) for n in ("shot_10", "set_16shot", "shot_1_x", "none")] == [10, 16, 1, None]
    assert one(spark, X.folder_after(F.lit("/a/images/fso/1.jpg"))) == "fso" and one(spark, X.parent_folder(F.lit("/a/fso/1.jpg"))) == "fso"
    assert one(spark, X.is_jpeg(F.unhex(F.lit("FFD8FFE0")))) and one(spark, X.is_png(F.unhex(F.lit("89504E47"))))


@pytest.mark.parametrize(("k", "want"), [(1, 5), (2, 9), (4, 37), (5, 42), (8, 60), (10, 65), (16, 96), (3, 20)])
def test_ood_target(spark, k, want):
    ratio, least, _ = taxonomy.SHOT_CONFIGS.get(k, taxonomy.DEFAULT_SHOT_CONFIG)
    assert one(spark, sampling.ood_target(F.lit(14 * k), F.lit(ratio), F.lit(least))) == want


def test_running_budget(spark):
    counts = spark.createDataFrame([(c, 100) for c in "abcdef"], "c string, n long")
    got = sampling.running_budget(counts, "c", int(2 * taxonomy.osr_multiplier(2)), 14)
    assert [r["take"] for r in got.orderBy("c").collect()] == [3, 3, 3, 3, 2, 0]


def test_main_class_ties(spark):
    df = spark.createDataFrame([(1, "cruise", 0), (1, "fso", 1), (2, "b", 0), (2, "a", 1), (2, "a", 2)], "i int, c string, p int")
    by = {rule: {r["i"]: r["c"] for r in aggregates.main_class(df, "i", "c", "p", rule).collect()} for rule in ("first_seen", "last_name", "latest")}
    assert by == {"first_seen": {1: "cruise", 2: "a"}, "last_name": {1: "fso", 2: "a"}, "latest": {1: "fso", 2: "b"}}


def test_upper_median_and_bins(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "x int")
    assert aggregates.upper_median(df, "x").first()[0] == 3
    assert one(spark, aggregates.bin_of(F.lit(0.10), [0.0, 0.10, 0.12])) == 1 and one(spark, aggregates.bin_of(F.lit(9.0), [0.0, 0.10, 0.12])) == 2
    assert one(spark, aggregates.bin_of(F.lit(0.12), [0.0, 0.10, 0.12], last_closed=True)) == 1


@pytest.mark.parametrize(("s", "want"), [(0.75, "Medium"), (0.60, "Easy"), (0.76, "Hard")])
def test_difficulty(spark, s, want):
    assert one(spark, C.difficulty(F.lit(s))) == want


@pytest.mark.parametrize(
    ("s", "hard", "want"),
    [(0.9, False, 0.317), (0.9, True, 0.337), (0.99, True, 0.349), (0.8, False, 0.283), (0.6, False, 0.217), (0.5, False, 0.207), (0.35, False, 0.194), (0.2, False, 0.165), (-0.5, False, 0.15)],
)
def test_bands(spark, s, hard, want):
    assert one(spark, C.pseudo_confidence(F.lit(s), F.lit(hard))) == pytest.approx(want, abs=5e-4)


def test_no_prototypes(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id int, v array<float>")
    none = spark.createDataFrame([], "label int, proto array<double>")
    r = vectors.nearest_prototype(df, "v", none, "label").first()
    assert (r["distance"], r["nearest"]) == (1.0, "unknown")


def test_prototypes(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.0, 2.0])], "id int, c string, v array<float>")
    got = {r["c"]: r["proto"] for r in vectors.prototypes(df, "c", "v", 2).collect()}
    assert got["a"] == pytest.approx([math.sqrt(0.5)] * 2) and got["b"] == [0, 1]
    tie = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0])], "c string, proto array<double>")
    assert {r["nearest"] for r in vectors.nearest_prototype(df, "v", tie, "c").collect()} == {"a"}
    far = spark.createDataFrame([(k, "a", [float(k % 3), 0.0]) for k in range(12)] + [(99, "a", [50.0, 0.0])], "id int, c string, v array<float>")
    r = vectors.robust_prototypes(far, "c", "v", "id", 2).first()
    assert r["n"] == 13 and r["inliers"] == 12 and r["proto"] == [1, 0]
    assert vectors.robust_prototypes(df.where("c = 'b'"), "c", "v", "id", 2).first()["inliers"] == 0


def test_contiguity(spark):
    df = spark.createDataFrame([("a", 3), ("a", 4), ("a", 6), ("b", 1), ("b", 2)], "c string, i int")
    assert {r["c"]: r["contiguous"] for r in windows.contiguity(df, "c", "i").collect()} == {"a": False, "b": True}
    assert [(r["i"], r["previous"]) for r in windows.gaps(df, "c", "i").collect()] == [(6, 4)]


def test_selected_mean_ap(spark):
    per = spark.createDataFrame([("a", 50.0), ("z", 10.0)], "cls string, ap double")
    assert aggregates.selected_mean_ap(per, ["a", "b"]).first()[0] == 25


def test_matching(spark):
    """Two truths and three detections: the best score takes its best truth, the last finds none free."""
    gt = spark.createDataFrame([(1, 1, 1, [0.0, 0.0, 10.0, 10.0]), (1, 1, 2, [20.0, 0.0, 10.0, 10.0])], "image_id long, category_id long, gt_id long, bbox array<double>")
    det = spark.createDataFrame(
        [(1, 1, 1, [0.0, 0.0, 10.0, 10.0], 0.9), (1, 1, 2, [1.0, 0.0, 10.0, 10.0], 0.8), (1, 1, 3, [20.0, 0.0, 10.0, 8.0], 0.7), (2, 1, 4, [0.0, 0.0, 5.0, 5.0], 0.95)],
        "image_id long, category_id long, det_id long, bbox array<double>, score double",
    )
    got = {(r["det_id"], r["t"]): r["tp"] for r in detection.match(det, gt).collect()}
    assert len(got) == 40
    assert [got[d, 50] for d in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[3, 80] and not got[3, 85]
    ap = {r["t"]: r["ap"] for r in detection.evaluate(det, gt).collect()}
    # order: 4 (miss), 1 (hit), 2 (miss), 3 (hit): precision 1/2 up to recall 0.5, then 1/2
    assert ap[50] == pytest.approx(0.5) and ap[95] == pytest.approx(51 / 101 * 0.5)
    crowd = gt.withColumn("iscrowd", F.when(F.col("gt_id") == 1, 1).otherwise(0))
    flags = {r["det_id"]: (r["tp"], r["ignored"]) for r in detection.match(det, crowd).where("t = 50").collect()}
    assert flags == {1: (False, True), 2: (False, True), 3: (True, False), 4: (False, False)}
    assert detection.per_class_report(detection.average_precision(detection.match(det, gt), spark.createDataFrame([(7, 0)], "category_id long, n_gt long"))).first()["map"] != 0


def test_undefined_class_is_nan(spark):
    counts = spark.createDataFrame([(7, 0)], "category_id long, n_gt long")
    none = spark.createDataFrame([], "category_id long, det_id long, score double, t int, tp boolean")
    assert math.isnan(detection.per_class_report(detection.average_precision(none, counts)).first()["map"])


def test_route_and_aliases(spark):
    df = spark.createDataFrame([("kayak",), ("unknown",), (None,), ("zeppelin",)], "c string")
    assert [r[0] for r in df.select(joins.route(F.col("c"), ["kayak"])).collect()] == ["id", "ood", "invalid", "invalid"]
    assert one(spark, joins.alias_rewritten(F.lit("<answer>fishing_ships</answer>"), taxonomy.ALIASES)) == "<answer>fishing_boat</answer>"


def test_taxonomy(spark):
    t = taxonomy.taxonomy(spark)
    counts = {(r["scheme"], r["role"]): r["count"] for r in t.groupBy("scheme", "role").count().collect()}
    assert counts["destroyer_id", "id"] == counts["tugboat_id", "id"] == counts["osr_near", "id"] == counts["pseudo_ood", "id"] == 14
    assert counts["destroyer_id", "ood_train"] == 10 and counts["osr_near", "ood_reserved"] == 10 and counts["all30", "id"] == 30
    for scheme in ("destroyer_id", "tugboat_id"):
        taxonomy.check_scheme(taxonomy.SCHEMES[scheme], taxonomy.ALL_CLASSES)
    with pytest.raises(ValueError, match="cover"):
        taxonomy.check_scheme(taxonomy.SCHEMES["pseudo_ood"], taxonomy.ALL_CLASSES)


def test_sanity_cascade(spark):
    def verdict(n_ood, label, size):
        rows = [(False, "x" * size)] + [(True, f"<answer>{label}</answer>")] * n_ood
        return audits.sanity(spark.createDataFrame(rows, "o boolean, s string"), "o", "s").first()["diagnosis"]

    assert verdict(3, "unknown", 5).startswith("too few") and verdict(12, "kayak", 5).endswith("unknown label")
    assert verdict(12, "unknown", 151).endswith("too long") and verdict(12, "unknown", 5) == "ok"


def _items(spark, n=40):
    rows = [(f"/d/images/{c}/{k}.jpg", c) for c in taxonomy.ALL_CLASSES for k in range(n)]
    return spark.createDataFrame(rows, "path string, category string")


def test_open_set_recipe(spark):
    got = P.open_set(_items(spark), 4).collect()
    known = [r for r in got if '"ID"' in r["metadata"]]
    assert len(known) == 56 and 30 <= len(got) - 56 <= 37
    assert all("<answer>unknown</answer>" == r["solution"] for r in got if '"OOD"' in r["metadata"])
    assert all('"difficulty"' in r["metadata"] for r in got if '"OOD"' in r["metadata"])
    five, eight = ({r["image"] for r in P.kshot_answers(_items(spark), k).collect()} for k in (5, 8))
    assert five < eight and len(eight) == 240
    assert all(r["solution"].startswith("<confidence></confidence> <think>") for r in P.kshot_thoughts(_items(spark), 1, confidence_tag=True).collect())
    listed = P.open_set_listed(_items(spark), 4, varied=True).collect()
    assert len(listed) == 56 + 20 and "{category}" not in "".join(r["solution"] for r in listed)


def test_osr_recipe(spark):
    roles = taxonomy.SCHEMES["osr_near"]
    items = _items(spark)
    other = items.where(F.col("category").isin(roles["ood_train"])).withColumn("similarity", F.lit(0.8)).withColumn("closest", F.lit("kayak"))
    got = P.osr_rows(items.where(F.col("category").isin(roles["id"])), other, 2).collect()
    ood = [r for r in got if '"OOD"' in r["metadata"]]
    assert len(got) - len(ood) == 28 and len(ood) == 14
    assert all("<confidence>0.28</confidence>" in r["solution"] for r in ood)


def test_sets(spark):
    mk = lambda *n: spark.createDataFrame([(x,) for x in n], "category string")
    assert [r[0] for r in sets.invalid_classes(mk("a", "x"), mk("a", "b")).collect()] == ["x"]
    assert [r[0] for r in sets.missing_classes(mk("a", "x"), mk("a", "b")).collect()] == ["b"]


def test_batched_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(13)
    placed = {r["id"]: r["pos"] for r in sampling.with_position(df, ["id"], sampling.range_bucket(df, "id")).collect()}
    assert placed == {k: k for k in range(1000)}
    keys = {r["id"]: r["k"] for r in df.select("id", sampling.shuffle_key("id").alias("k")).collect()}
    mixed = {r["id"]: r["pos"] for r in sampling.with_position(df, [sampling.shuffle_key("id"), "id"], sampling.hash_bucket("id")).collect()}
    assert sorted(keys, key=keys.get) == sorted(mixed, key=mixed.get) and set(mixed.values()) == set(range(1000))
    none = df.where("false")
    assert sampling.with_position(none, ["id"], sampling.range_bucket(none, "id")).count() == 0


def test_preflight_and_tasks(spark):
    assert P.preflight(4, "100", 2, model="m") == []
    assert len(P.preflight(5, "x", 0, model="", data=None)) == 5
    P.register_task("open_set", "Is {category} known? {answer}")
    assert one(spark, P.task_prompt(F.lit("open_set"), F.lit("fso"), F.lit("no"), P.TASKS)) == "Is fso known? no"
    P.TASKS.pop("open_set")
    assert one(spark, P.thought_solution(F.lit("<think>a</think> x"), F.lit("<answer>b</answer>"))) == "<solution><think>a</think>\n<answer>b</answer></solution>"
    assert one(spark, P.thought_solution(F.lit("none"), F.lit("<answer>b</answer>"))) == "<answer>b</answer>"


def test_repeated_indexes_are_not_contiguous(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 5), ("b", 3), ("b", 3), ("b", 4), ("c", 4), ("c", 3), ("d", 9)], "c string, i int")
    got = {r["c"]: (r["n"], r["contiguous"]) for r in windows.contiguity(df, "c", "i").collect()}
    assert got == {"a": (3, False), "b": (3, False), "c": (2, True), "d": (1, True)}


def test_buckets_follow_the_values(spark):
    """Narrow scores, an outlier and a very frequent value: buckets rise with the values and stay small."""
    values = [0.9 + k / 1e5 for k in range(1000)] + [1e15] + [0.905] * 500 + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = sampling.range_bucket(df, "x").mark(df, "b").collect()
    ordered = sorted(((r["x"] is not None, r["x"] or 0.0), r["b"]) for r in rows)
    assert [b for _, b in ordered] == sorted(b for _, b in ordered)
    sizes = {}
    for (_, x), b in ordered:
        if x != 0.905:
            sizes[b] = sizes.get(b, 0) + 1
    assert max(sizes.values()) <= 12 and len({b for (_, x), b in ordered if x == 0.905}) == 1


def test_spread_rank_is_the_rank(spark):
    df = spark.createDataFrame([(k, None if k % 7 == 0 else f"c{k % 2}") for k in range(200)] + [(5, "c1")], "id long, c string")
    rank = lambda f: sorted((r["id"], r["c"] or "", r["rn"]) for r in f(df, "c", "id").collect())
    assert rank(sampling.with_spread_rank) == rank(sampling.with_rank)


def test_truths_outside_the_band(spark):
    """A truth outside the band takes a detection once, at its own IoU, and only where no other can."""
    det = spark.createDataFrame([(1, 1, 1, [0.0, 0.0, 50.0, 50.0], 0.9), (1, 1, 2, [0.0, 0.0, 50.0, 50.0], 0.8), (1, 1, 3, [200.0, 0.0, 10.0, 10.0], 0.7)], "image_id long, category_id long, det_id long, bbox array<double>, score double")
    gt = spark.createDataFrame([(1, 1, 1, [0.0, 0.0, 50.0, 50.0]), (1, 1, 2, [200.0, 0.0, 10.0, 10.0])], "image_id long, category_id long, gt_id long, bbox array<double>")
    got = {(r["area"], r["det_id"]): (r["tps"][0], r["ignores"][0]) for r in detection.match_wide(det, gt, ["small", "medium"]).collect()}
    assert got == {("small", 1): (False, True), ("small", 2): (False, True), ("small", 3): (True, False), ("medium", 1): (True, False), ("medium", 2): (False, False), ("medium", 3): (False, True)}
    six = detection.summary(detection.evaluate_areas(det, gt)).first().asDict()
    assert six["AP_small"] == 1 and six["AP_m"] == 1 and six["AP_l"] is None and 0.8 < six["mAP"] < 1


def test_error_rows(spark):
    df = spark.createDataFrame([(0.123456, "a", "b", None), (None, None, "b", "bad file")], "d double, n string, t string, e string")
    rows = audits.distance_results(df, "d", "n", "t", "e")
    assert [tuple(r)[4:] for r in rows.collect()] == [(0.1235, "a", "b", None), (0.5, "unknown", "unknown", "bad file")]
    assert audits.without_errors(rows).count() == 1 and tuple(audits.tally(rows).first()) == (1, 1, 2)


def test_two_digits(spark):
    values = [0.175, 0.165, 0.125, 0.375, 0.2, 0.999, 1.005, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(X.two_digits(F.col("v"))).collect()] == [f"{v:.2f}" for v in values]


def test_two_digits_of_large_and_negative_numbers(spark):
    rnd = random.Random(5)
    values = [k + 0.995 for k in range(600)] + [0.125, 1e6 + 0.125, 99.999, 1e15 + 0.375, 4e18, -0.995, -17.995, -3.0] + [rnd.uniform(-1, 1) * 10 ** rnd.randint(-6, 15) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(X.two_digits(F.col("v"))).collect()] == [f"{v:.2f}" for v in values]


def test_number_truncation_at_ties(spark, duck, tmp_path):
    """Prices whose thousands end in .995 lie below or above the tie by their binary value."""
    spark.range(1000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 1000 + 995).cast("double").alias("o_totalprice")).write.parquet(str(tmp_path / "orders.parquet"))
    want = duck.sql(ORACLES["number_truncation"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'"))
    assert sorted(map(tuple, QUERIES["number_truncation"](spark, str(tmp_path)).collect())) == sorted(want.fetchall())


def test_result_row_and_confidence(spark):
    df = spark.createDataFrame([("Tug boat", "tugboat", None), (None, "fso", "x" * 200), ("", "fso", None)], "a string, t string, e string")
    rows = df.select(*P.result_row(F.col("a"), F.col("t"), F.col("e"))).collect()
    assert [r["is_correct"] for r in rows] == [True, False, True] and len(rows[1]["error"]) == 120
    one = spark.createDataFrame([("fso", 0.9, True), ("fso", 0.175, False)], "c string, v double, k boolean")
    got = [r[0] for r in one.select(P.confidence_solution(F.col("c"), F.col("v"), F.col("k"))).collect()]
    assert got == ["<answer>fso</answer> <confidence>0.9</confidence>", "<answer>unknown</answer> <confidence>0.17</confidence>"]
