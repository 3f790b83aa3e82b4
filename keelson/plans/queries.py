"""The query catalogue: every operator on the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy
from ..functions import confidence as C
from ..functions import geometry as G
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import audits, detection, joins, sampling, sets, vectors, windows
from . import builders as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIMS, SHOTS = 64, 4
KNOWN_EVENTS = ["click", "view", "purchase"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- sampling -----------------------------------------------------------------


@query
def kshot_per_class(spark, sf_dir):
    out = sampling.k_shot(table(spark, sf_dir, "events"), "event_type", "event_id", SHOTS)
    return out.select("event_type", "event_id", long("rn").alias("rn"))


@query
def kshot_nested_5_of_8(spark, sf_dir):
    eight = sampling.k_shot(table(spark, sf_dir, "events"), "event_type", "event_id", 8).drop("rn")
    five = sampling.k_shot(eight, "event_type", "event_id", 5)
    return five.select("event_type", "event_id", long("rn").alias("rn"))


@query
def shot_deficit_report(spark, sf_dir):
    classes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category"), "n_name")
    items = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("category"))
    counted = audits.class_balance(items, "category", classes, 5)
    return classes.join(counted, "category").select("n_name", "n", F.col("missing").alias("deficit"))


@query
def ood_ratio_target(spark, sf_dir):
    available = table(spark, sf_dir, "events").where(~F.col("event_type").isin(KNOWN_EVENTS)).agg(F.count("*").alias("available"))
    k = spark.range(1, 17).select(F.col("id").cast("int").alias("k"))
    ratio, least, coverage = taxonomy.DEFAULT_SHOT_CONFIG
    conf = k.join(taxonomy.shot_configs(spark), "k", "left").fillna({"ood_ratio": ratio, "min_ood": least, "coverage": coverage})
    n_id = F.col("k") * 14
    met = conf.join(F.broadcast(available))  # one row
    target = sampling.ood_target(n_id, F.col("ood_ratio"), F.col("min_ood"))
    capped = sampling.capped_ood_target(n_id, F.col("ood_ratio"), F.col("min_ood"), F.col("available"))
    return met.select(long("k").alias("k"), long(n_id).alias("n_id"), "ood_ratio", target.alias("target"), capped.alias("capped"))


@query
def ood_balanced_sample(spark, sf_dir):
    out = sampling.balanced_sample(table(spark, sf_dir, "events"), "event_type", "event_id", 30, 0.7)
    return out.select("event_type", "event_id", long("round").alias("round"), long("pos").alias("pos"))


@query
def ood_equal_quota(spark, sf_dir):
    other = table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", "source")
    return sampling.equal_quota_sample(other, "source", "doc_id", 60, 20).select("source", "doc_id", long("rn").alias("rn"))


@query
def ood_running_budget(spark, sf_dir):
    counts = sampling.class_counts(table(spark, sf_dir, "orders"), "o_orderpriority")
    out = sampling.running_budget(counts, "o_orderpriority", 1200, 4000)
    return out.select("o_orderpriority", long("n").alias("n"), long("raw").alias("raw"), long("take").alias("take"))


@query
def ood_budgeted_sample(spark, sf_dir):
    out = sampling.budgeted_sample(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 40, 130)
    return out.select("o_orderpriority", "o_orderkey", long("rn").alias("rn"))


@query
def split_per_class(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.split_per_class(docs, "source", "doc_id", 0.2).select("doc_id", "source", "split")


def _with_singletons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stratum = F.when(F.col("doc_id") % 101 == 7, F.concat(F.lit("only_"), F.col("doc_id").cast("string"))).otherwise(F.concat_ws("_", "source", "lang"))
    return docs.select("doc_id", stratum.alias("stratum"))


@query
def split_stratified_singletons(spark, sf_dir):
    return sampling.stratified_split(_with_singletons(spark, sf_dir), "stratum", "doc_id", 0.2).select("doc_id", "stratum", "split")


@query
def subsample_stratified(spark, sf_dir):
    return sampling.stratified_subsample(_with_singletons(spark, sf_dir), "stratum", "doc_id", 200).select("doc_id", "stratum")


@query
def support_query_role(spark, sf_dir):
    shot = sampling.k_shot(table(spark, sf_dir, "events"), "event_type", "event_id", 8)
    known = F.col("event_type").isin(KNOWN_EVENTS)
    roles = sampling.support_or_query(shot, 8, known)
    u = C.uniform(sampling.SEED, F.col("event_id"), "id")
    conf = F.when(known, C.id_confidence(F.col("rn"), F.lit(8), u))
    return roles.select("event_type", "event_id", "role", conf.alias("confidence"))


@query
def global_shuffle_positions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    placed = sampling.with_position(events, [sampling.shuffle_key("event_id"), "event_id"], sampling.hash_bucket("event_id"))
    return placed.select("event_id", long("pos").alias("pos"))


@query
def batch_assignment(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    placed = sampling.with_position(events, ["event_id"], sampling.range_bucket(events, "event_id"))
    batched = sampling.batches(placed, "pos", 10)
    return batched.groupBy("batch").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("value"))


@query
def first_examples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.orderBy("doc_id").limit(15).select("doc_id", F.left("text", F.lit(120)).alias("shown"))


# --- main class, boxes, detection records --------------------------------------


@query
def main_class_first_seen(spark, sf_dir):
    out = A.main_class(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber")
    return out.select("l_orderkey", "l_returnflag", long("n").alias("n"))


@query
def main_class_last_name(spark, sf_dir):
    out = A.main_class(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", "last_name")
    return out.select("l_orderkey", "l_returnflag", long("n").alias("n"))


@query
def main_class_latest(spark, sf_dir):
    out = A.main_class(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber", "latest")
    return out.select("l_orderkey", "l_returnflag", long("n").alias("n"))


@query
def main_class_filter_boxes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    main = A.main_class(lines, "l_orderkey", "l_returnflag", "l_linenumber").select("l_orderkey", "l_returnflag")
    kept = lines.join(main, ["l_orderkey", "l_returnflag"]).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return kept.groupBy("p_brand", "l_returnflag").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity"))


def _boxes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") % 300).cast("double")
    return lines.select("l_orderkey", "l_linenumber", "l_returnflag", x.alias("x"), y.alias("y"), (F.col("l_quantity") + 1).alias("w"), (F.col("l_quantity") * 2 + 3).alias("h"))


@query
def box_xywh(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    x, y, w, h = (F.col(c) for c in "xywh")
    corners = G.xywh_to_corners(x, y, w, h)
    back = G.corners_to_xywh(*(F.get(corners, i) for i in range(4)))
    return b.select("l_orderkey", "l_linenumber", *(F.get(back, i).alias(f"b{i}") for i in range(4)))


@query
def box_xyxy_scale1000(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    x, y, w, h = (F.col(c) for c in "xywh")
    wide, high = F.lit(640.0), F.lit(400.0)
    ends = {"x1": (x, wide), "y1": (y, high), "x2": (x + w, wide), "y2": (y + h, high)}
    return b.select("l_orderkey", "l_linenumber", *(long(G.scaled_1000(v, s)).alias(k) for k, (v, s) in ends.items()))


@query
def box_area(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.sum(G.area(F.col("w"), F.col("h")))).alias("area"))


@query
def detection_records(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.concat(F.lit("img_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(640).cast("long").alias("width"), F.lit(400).cast("long").alias("height"))
    cats = b.select("l_returnflag").distinct().select(F.ascii("l_returnflag").cast("long").alias("category_id"), F.col("l_returnflag").alias("name"))
    ann = b.select(F.col("l_linenumber").cast("long").alias("annotation_id"), F.col("l_orderkey").alias("image_id"), F.ascii("l_returnflag").cast("long").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"))
    out = P.detection_records(images, ann, cats)
    from ..schemas import ANSWER_BOXES

    boxes = F.from_json(X.answer(F.col("solution")), ANSWER_BOXES)
    first = F.get(boxes, 0)["Position"]
    return out.select("image", X.category_in_prompt(F.col("problem")).alias("category"), long(F.size(boxes)).alias("n"), *(long(F.get(first, i)).alias(f"p{i}") for i in range(4)))


# --- tags, labels, records ------------------------------------------------------


def _solutions(spark, sf_dir):
    """Documents with a solution text: some have no tag, some an empty one, some odd case or spacing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    body = F.when(F.col("doc_id") % 11 == 3, "").when(F.col("doc_id") % 7 == 2, F.concat(F.lit("\n "), F.col("lang"), F.lit(" \n"))).when(F.col("doc_id") % 5 == 1, "xx").otherwise(F.col("lang"))
    with_tag = F.concat(F.lit("<think>seen in "), F.col("source"), F.lit("</think> <answer>"), body, F.lit("</answer> <Confidence>0."), ((F.col("doc_id") * 37) % 90 + 10).cast("string"), F.lit("</Confidence>"))
    return docs.withColumn("solution", F.when(F.col("doc_id") % 13 == 5, F.concat(F.lit("no tags for "), F.col("lang"))).otherwise(with_tag))


@query
def answer_tag_extract(spark, sf_dir):
    s = F.col("solution")
    return _solutions(spark, sf_dir).select("doc_id", X.answer(s).alias("answer"), X.tag_with_marks(s, "think").alias("think"), X.think_before_close(s).alias("before"), X.confidence(s).alias("confidence"))


@query
def answer_accuracy(spark, sf_dir):
    s = _solutions(spark, sf_dir).where("n_chars >= 300")  # what is too short to be read counts in the manifest alone
    got, truth = X.normalised(X.answer(F.col("solution"))), X.normalised(F.col("lang"))
    ok = F.coalesce(X.matches_either_way(got, truth), F.lit(False))
    strict = F.coalesce(X.matches_either_way(got, truth, strict=True), F.lit(False))
    manifest = table(spark, sf_dir, "documents").select("doc_id")
    out = A.accuracy(s.select(ok.alias("ok"), strict.alias("strict")), F.col("ok"), manifest)
    exact = s.agg(F.count_if(strict).alias("strict_correct"))
    return out.join(F.broadcast(exact)).select("correct", "total", r6("accuracy").alias("accuracy"), "strict_correct")


@query
def title_tag_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.tag_body(F.col("html"), "title").alias("title"))


@query
def path_label(spark, sf_dir):
    p = F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), r"#.*$", "")
    return table(spark, sf_dir, "pages").select("page_id", X.parent_folder(p).alias("parent"), X.base_name(p).alias("base"), X.stem(p).alias("stem"), X.extension(p).alias("suffix"), X.folder_after(p, "en").alias("after_en"))


@query
def prompt_category_extract(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    prompt = P.detection_prompt(F.col("p_type"))
    return part.select("p_partkey", X.category_in_prompt(prompt).alias("category"), long(F.length(prompt)).alias("n_chars"))


@query
def json_metadata_route(spark, sf_dir):
    k = X.metadata_field(F.col("props"), "k").try_cast("int")
    category = F.when(k < 10, None).when(k < 30, "unknown").otherwise(F.col("event_type"))
    route = joins.route(category, KNOWN_EVENTS)
    return table(spark, sf_dir, "events").groupBy(route.alias("route"), "event_type").agg(F.count("*").alias("n"))


@query
def label_canonicalise(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("canonical"), F.when(F.col("n_regionkey") < 2, "id").otherwise("ood_train").alias("role"), F.col("n_regionkey").alias("priority"))
    messy = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(" "), F.lower(F.replace("n_name", F.lit("I"), F.lit("_I"))), F.when(F.col("n_nationkey") % 6 == 5, F.lit("zz")).otherwise(F.lit("-"))).alias("seen"))
    out = joins.canonical_names(messy, "seen", nation)
    return out.select("n_nationkey", "seen", "canonical", F.coalesce("role", F.lit("unknown")).alias("role"))


@query
def alias_rewrite(spark, sf_dir):
    s = F.concat(F.lit("<answer>"), F.when(F.col("doc_id") % 3 == 0, "fishing_ships").otherwise(F.col("lang")), F.lit("</answer>"))
    new = joins.alias_rewritten(s, taxonomy.ALIASES)
    return table(spark, sf_dir, "documents").select("doc_id", new.alias("solution"), F.contains(s, F.lit("fishing_ships")).alias("changed"))


@query
def lookup_defaults(spark, sf_dir):
    level = spark.createDataFrame([("en", "Easy"), ("de", "Medium"), ("fr", "Hard")], "lang string, difficulty string")
    out = joins.with_default(table(spark, sf_dir, "documents").select("doc_id", "lang"), level, "lang", "difficulty", "Unknown")
    return out.groupBy("difficulty").agg(F.count("*").alias("n"))


def _records(spark, sf_dir, solution):
    c, known = F.col("lang"), F.col("lang") == "en"
    meta = P.metadata_json(type=F.when(known, "ID").otherwise("OOD"), category=F.when(known, c).otherwise("unknown"), original_category=c)
    base = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("doc_id").cast("string").alias("path"))
    out = base.select("doc_id", solution(c, known, F.col("source")).alias("solution"), meta.alias("metadata"))
    m = F.col("metadata")
    fields = [X.metadata_field(m, k).alias(k) for k in ("type", "category", "original_category")]
    return out.select("doc_id", "solution", *fields)


@query
def record_build_answer(spark, sf_dir):
    return _records(spark, sf_dir, lambda c, known, _: P.answer_solution(c, known))


@query
def record_build_think(spark, sf_dir):
    return _records(spark, sf_dir, lambda c, _, __: P.think_solution(c))


@query
def record_build_confidence(spark, sf_dir):
    def solution(c, known, _):
        u = C.uniform(sampling.SEED, F.col("doc_id"), "conf")
        return F.concat_ws(" ", P.empty_confidence_solution(c), P.tagged("confidence", F.format_string("%.2f", F.round(0.5 + u / 2, 2))))

    return _records(spark, sf_dir, solution)


@query
def record_build_varied_think(spark, sf_dir):
    return _records(spark, sf_dir, lambda c, known, _: P.varied_think_solution(c, known, F.col("doc_id")))


@query
def prompt_from_classes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("category"), F.col("n_nationkey").alias("ordinal"))
    return P.prompt_from_table(nation, "one of {classes}, unknown")


@query
def confidence_rewrite(spark, sf_dir):
    s, key = F.col("solution"), F.col("doc_id")
    known = F.coalesce(X.answer(s), F.lit("")).isin("en", "de")
    value = C.mixture_confidence(known, C.uniform(7, key, "u"), C.uniform(7, key, "v"))
    new = X.with_confidence(s, F.format_string("%.2f", value))
    return _solutions(spark, sf_dir).select("doc_id", X.confidence(s).alias("before"), X.confidence(new).alias("after"))


@query
def confidence_histogram(spark, sf_dir):
    new = confidence_rewrite(spark, sf_dir)
    out = A.histogram(new, "after", [0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95], last_closed=True)
    return out.select(long("bin").alias("bin"), "n", r6("pct").alias("pct"))


@query
def confidence_before_after(spark, sf_dir):
    new = confidence_rewrite(spark, sf_dir)
    met = audits.before_after(new.select("doc_id", F.col("before").alias("c")), new.select("doc_id", F.col("after").alias("c")), "doc_id", "c")
    return met.groupBy("changed").agg(F.count("*").alias("n"), r6(F.avg("before")).alias("before_avg"), r6(F.avg("after")).alias("after_avg"), r6(F.stddev_pop("after")).alias("after_sd"))


@query
def confidence_frequencies(spark, sf_dir):
    out = A.frequencies(confidence_rewrite(spark, sf_dir).where("after is not null"), "after")
    return out.select("after", "n", r6("pct").alias("pct"))


# --- vectors --------------------------------------------------------------------


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _few(spark, sf_dir, shots=SHOTS):
    return sampling.k_shot(_vectors(spark, sf_dir), "label", "vec_id", shots)


@query
def prototype_centroid(spark, sf_dir):
    out = vectors.centroids(_vectors(spark, sf_dir), "label", "embedding", DIMS)
    return out.select("label", F.posexplode("proto").alias("i", "x")).select(long("label").alias("label"), long("i").alias("i"), r6("x").alias("x"))


@query
def nearest_prototype(spark, sf_dir):
    """How well does a 4-shot prototype classifier separate the labels?"""
    protos = vectors.prototypes(_few(spark, sf_dir), "label", "embedding", DIMS)
    near = vectors.nearest_prototype(_vectors(spark, sf_dir), "embedding", protos, "label")
    ok = F.col("nearest") == F.col("label").cast("string")
    d = "distance"
    return near.groupBy(long("label").alias("label")).agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"), r6(F.min(d)).alias("d_min"), r6(F.avg(d)).alias("d_avg"), r6(F.max(d)).alias("d_max"))


@query
def nearest_prototype_rows(spark, sf_dir):
    protos = vectors.centroids(_vectors(spark, sf_dir), "label", "embedding", DIMS)
    near = vectors.nearest_prototype(_vectors(spark, sf_dir), "embedding", protos, "label")
    return near.select("vec_id", "nearest", r6("distance").alias("distance"))


def _similar(spark, sf_dir, few=True):
    base = _few(spark, sf_dir) if few else _vectors(spark, sf_dir)
    return vectors.most_similar(_vectors(spark, sf_dir), "embedding", vectors.prototypes(base, "label", "embedding", DIMS), "label")


@query
def cosine_similarity_top1(spark, sf_dir):
    return _similar(spark, sf_dir).select("vec_id", "closest", r6("similarity").alias("similarity"))


@query
def pseudo_confidence(spark, sf_dir):
    s = F.round("similarity", 6)
    return _similar(spark, sf_dir).select("vec_id", C.pseudo_confidence(s).alias("confidence"), C.ood_score(s).alias("ood_score"))


@query
def difficulty_bucket(spark, sf_dir):
    s = _similar(spark, sf_dir).withColumn("stretched", F.least(F.lit(1.0), F.round(F.col("similarity") * 2, 6)))
    return s.groupBy(C.difficulty(F.col("stretched")).alias("difficulty")).agg(F.count("*").alias("n"))


@query
def own_prototype_similarity(spark, sf_dir):
    few = _few(spark, sf_dir)
    out = vectors.own_similarity(few, "label", "embedding", vectors.prototypes(few, "label", "embedding", DIMS))
    return out.select(long("label").alias("label"), "n", r6("own_similarity").alias("own_similarity"))


@query
def similarity_flags(spark, sf_dir):
    return vectors.similarity_flags(_similar(spark, sf_dir), "label", "similarity").select(long("label").alias("label"), "very_similar", "very_far")


@query
def prototype_outlier_filtered(spark, sf_dir):
    out = vectors.inlier_prototypes(_vectors(spark, sf_dir), "label", "embedding", DIMS)
    each = out.select("label", "n", "inliers", F.posexplode("proto").alias("i", "x"))
    return each.select(long("label").alias("label"), "n", "inliers", long("i").alias("i"), r6("x").alias("x"))


@query
def prototype_kmeans(spark, sf_dir):
    out = vectors.robust_prototypes(_few(spark, sf_dir, 16), "label", "embedding", "vec_id", DIMS)
    return out.select(long("label").alias("label"), "n", "inliers", r6(F.get("proto", 0)).alias("x0"))


@query
def label_position(spark, sf_dir):
    two = _vectors(spark, sf_dir).select("label", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    out = A.coordinate_median(two, "label", "x", "y", least=3)
    return out.select(long("label").alias("label"), "n", r6("x").alias("x"), r6("y").alias("y"))


@query
def separation_report(spark, sf_dir):
    near = vectors.nearest_prototype(_vectors(spark, sf_dir), "embedding", vectors.prototypes(_few(spark, sf_dir), "label", "embedding", DIMS), "label")
    near = near.withColumn("d", F.round("distance", 6))
    out = A.separation(near, "d", F.col("label") < 5, F.col("label") >= 5)
    return out.select(*("id_n", "ood_n"), *(r6(c).alias(c) for c in out.columns if c not in ("id_n", "ood_n")))


@query
def distance_distribution(spark, sf_dir):
    d = table(spark, sf_dir, "events").select((F.floor(F.col("value") * 100) % 40 / 100).alias("d"))
    out = A.histogram(d, "d", audits.DISTANCE_EDGES)
    return out.select(long("bin").alias("bin"), "n", r6("pct").alias("pct"))


@query
def upper_median(spark, sf_dir):
    return A.upper_median(table(spark, sf_dir, "events"), "value", ["event_type"])


# --- average precision ------------------------------------------------------------


def _one_truth(spark, sf_dir):
    """Line items as detections of their order and flag, with a made-up overlap with its one ground truth."""
    lines = table(spark, sf_dir, "lineitem")
    overlap = ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 101) / 100.0
    return lines.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_returnflag").alias("cls"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("det_id"),
        F.round(F.col("l_discount") * 10 + F.col("l_quantity") / 100, 4).alias("score"),
        overlap.alias("iou"),
    )


def _ap_one_truth(spark, sf_dir):
    dets = _one_truth(spark, sf_dir)
    flagged = detection.single_truth_hits(dets, "image_id", "cls", "score", "iou", "det_id")
    counts = dets.select("image_id", "cls").distinct().groupBy("cls").agg(F.count("*").alias("n_gt"))
    return detection.average_precision_wide(flagged, counts, "cls")


@query
def ap_single_gt(spark, sf_dir):
    return _ap_one_truth(spark, sf_dir).select("cls", long("t").alias("t"), r6("ap").alias("ap"))


@query
def ap_per_class(spark, sf_dir):
    out = detection.per_class_report(_ap_one_truth(spark, sf_dir), "cls")
    return out.select("cls", r6("ap50").alias("ap50"), r6("map").alias("map"))


@query
def ap_summary(spark, sf_dir):
    out = detection.summary(_ap_one_truth(spark, sf_dir))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query
def map_selected(spark, sf_dir):
    per = detection.per_class_report(_ap_one_truth(spark, sf_dir), "cls")
    return A.selected_mean_ap(per, ["A", "R", "Z"], "cls", "map").select(r6("mean_ap").alias("mean_ap"))


def _many_truths(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    key = F.struct("l_linenumber", "x", "y", "w", "h")  # line numbers repeat
    truth = b.select(F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("category_id"), key.alias("gt_id"), F.array("x", "y", "w", "h").alias("bbox"))
    shift = F.col("l_linenumber") % 4
    det = b.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_returnflag").alias("category_id"),
        F.struct("l_orderkey", "l_linenumber", "x", "y", "w", "h").alias("det_id"),
        F.array(F.col("x") + shift, F.col("y") - shift, F.col("w"), F.col("h")).alias("bbox"),
        F.round((F.col("x") + F.col("y")) / 700, 4).alias("score"),
    )
    return det, truth


@query
def ap_multi_gt(spark, sf_dir):
    out = detection.evaluate(*_many_truths(spark, sf_dir))
    return out.select("category_id", long("t").alias("t"), r6("ap").alias("ap"))


@query
def ap_by_area(spark, sf_dir):
    ap = detection.evaluate_areas(*_many_truths(spark, sf_dir), areas=["small", "medium", "large"])
    at = lambda t: F.avg(F.when(F.col("t") == t, F.col("ap")))
    return ap.groupBy("area").agg(r6(F.avg("ap")).alias("mAP"), r6(at(50)).alias("AP50"), r6(at(75)).alias("AP75"))


@query
def ap_by_detections(spark, sf_dir):
    out = detection.evaluate_limits(*_many_truths(spark, sf_dir), limits=(1, 2, 100))
    return out.select("category_id", long("limit").alias("max_dets"), long("t").alias("t"), r6("ap").alias("ap"))


@query
def ap_six_metrics(spark, sf_dir):
    out = detection.summary(detection.evaluate_areas(*_many_truths(spark, sf_dir)))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query
def results_to_rows(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    flags = spark.createDataFrame([(10, "A"), (20, "N"), (30, "R")], "category_id long, flag string")
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    each = b.groupBy(F.col("l_orderkey").alias("image_id"), label.alias("label")).agg(F.collect_list(F.array(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.col("l_linenumber").cast("double"))).alias("boxes"))
    nested = each.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "boxes"))).alias("labels"))
    flat = detection.flatten_results(nested, flags.select("category_id"))
    return flat.select("image_id", "category_id", *(r6(F.get("bbox", i)).alias(f"b{i}") for i in range(4)), "score")


# --- audits, sets, running values ---------------------------------------------------


@query
def audit_integrity(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id")
    classes = events.select("event_type").distinct().where("event_type <> 'click'").unionByName(spark.createDataFrame([("kayak",)], "event_type string"))
    out = audits.integrity(events, "event_type", "event_id", classes, 2000)
    return out.select("category", "issue", long("n").alias("n"))


@query
def audit_contiguity(spark, sf_dir):
    out = windows.contiguity(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return out.select("l_orderkey", long("n").alias("n"), "contiguous")


@query
def index_gaps(spark, sf_dir):
    out = windows.gaps(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id")
    return out.groupBy("event_type").agg(F.count("*").alias("gaps"), F.max(F.col("event_id") - F.col("previous")).alias("widest"))


@query
def audit_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    s = F.when(F.col("quality") == 1, F.concat(F.lit("<answer>"), F.col("lang"), F.lit("</answer>"))).otherwise(F.lit("<answer>unknown</answer>"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id")
    return audits.sanity(docs.select((F.col("toxic") == 1).alias("is_ood"), s.alias("solution")), "is_ood", "solution")


@query
def audit_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), long(F.min(F.length("text"))).alias("shortest"), r6(F.avg(F.length("text"))).alias("mean"), long(F.max(F.length("text"))).alias("longest"))


@query
def source_readiness(spark, sf_dir):
    events, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    out = audits.readiness({"events": events.select(F.col("event_type").alias("c")), "documents": docs.select(F.col("source").alias("c"))}, "c", 50)
    return out.select("source", "rows", "classes", "short_classes")


def _large_classes(spark, sf_dir):
    """Nations with more customers than the mean."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.avg("n").alias("mean")))).where("n > mean").select("k")  # one row


def _class_names(spark, sf_dir):
    seen = _large_classes(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("category"))
    return seen.join(names, "k").select(F.when(F.col("k") % 9 == 4, F.concat(F.lit("odd "), "category")).otherwise(F.col("category")).alias("category")), names.select("category")


@query
def set_invalid_classes(spark, sf_dir):
    return sets.invalid_classes(*_class_names(spark, sf_dir))


@query
def set_missing_classes(spark, sf_dir):
    return sets.missing_classes(*_class_names(spark, sf_dir))


@query
def set_partition_check(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    parts = nation.select(F.when(F.col("n_regionkey") < 3, "id").otherwise("ood").alias("part"), F.col("n_name").alias("category"))
    extra = nation.where("n_nationkey in (3, 8)").select(F.lit("id").alias("part"), F.when(F.col("n_nationkey") == 3, "NOWHERE").otherwise(F.col("n_name")).alias("category"))
    whole = nation.select(F.col("n_name").alias("category"))
    return sets.partition_report(parts.where("category <> 'CHINA'").unionByName(extra), whole)


@query
def taxonomy_partition_check(spark, sf_dir):
    t = taxonomy.taxonomy(spark)
    t = t.where(F.col("role") != "ood_fallback")
    of_parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30).cast("int").alias("ordinal")).distinct()  # the class of each part
    whole = t.where("scheme = 'all30'").join(of_parts, "ordinal").select("category")
    out = None
    for scheme in ("destroyer_id", "tugboat_id", "osr_near", "pseudo_ood"):
        one = sets.partition_report(t.where(F.col("scheme") == scheme).select(F.col("role").alias("part"), "category"), whole).withColumn("scheme", F.lit(scheme))
        out = one if out is None else out.unionByName(one)
    return out


@query
def union_id_ood(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    known = sampling.k_shot(events.where(F.col("event_type").isin(KNOWN_EVENTS)), "event_type", "event_id", 6)
    other = sampling.equal_quota_sample(events.where(~F.col("event_type").isin(KNOWN_EVENTS)), "event_type", "event_id", 8, 2)
    both = sets.tagged_union("kind", id=known, ood=other)
    return both.select("kind", "event_type", "event_id")


@query
def distinct_think(spark, sf_dir):
    s = _solutions(spark, sf_dir)
    return s.agg(F.count_distinct(X.tag_with_marks(F.col("solution"), "think")).alias("thoughts"), F.count_distinct(X.think_before_close(F.col("solution"))).alias("before"))


@query
def class_coverage(spark, sf_dir):
    seen = _large_classes(spark, sf_dir).agg(F.count_distinct("k").alias("seen"))
    return seen.join(F.broadcast(table(spark, sf_dir, "nation").agg(F.count("*").alias("expected")))).withColumn("coverage", r6(F.col("seen") / F.col("expected")))


@query
def running_accuracy(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    labels = sampling.with_position(labels, ["doc_id"], sampling.range_bucket(labels, "doc_id"))
    out = windows.running_accuracy(sampling.batches(labels, "pos", 10), "batch", F.col("quality") == 1)
    return out.select("batch", long("correct").alias("correct"), long("total").alias("total"), r6("accuracy").alias("accuracy"))


@query
def ordered_ids(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = windows.first_seen_ids(events, "event_type", "event_id", "by_appearance")
    name = windows.sorted_ids(events, "event_type", "by_name")
    return first.join(name, "event_type").select("event_type", long("by_appearance").alias("by_appearance"), long("by_name").alias("by_name"))


@query
def shots_in_names(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("set_shot_"), F.col("n_nationkey").cast("string"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.col("n_nationkey").cast("string"), F.lit("shot_set"))).otherwise(F.lit("plain")).alias("name"))
    return names.select("n_nationkey", long(X.shots_in_name(F.col("name"))).alias("shots"))


@query
def number_truncation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", X.truncated_number(X.two_digits(F.col("o_totalprice") / 1000)).alias("n"))


@query
def record_labels(spark, sf_dir):
    s = _solutions(spark, sf_dir)
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/d/images/"), F.upper("lang"), F.lit("/1.jpg"))).otherwise(F.lit("/d/other/1.jpg"))
    return s.select("doc_id", X.label_of(path, F.col("solution"), ["en", "de", "fr"]).alias("label"))


@query
def encoded_contents(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.encoded(F.col("p_name").cast("binary")).alias("encoded"))


@query
def task_prompts(spark, sf_dir):
    task = F.when(F.col("p_size") % 3 == 0, "classification").when(F.col("p_size") % 3 == 1, "detection").otherwise("none")
    prompt = P.task_prompt(task, F.col("p_type"), F.col("p_name"), P.TASKS)
    return P.mapped(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_name"), prompt=prompt).select("p_partkey", long(F.length("prompt")).alias("n_chars"), F.contains(F.col("prompt"), F.col("p_type")).alias("named"))


@query
def plane_coordinates(spark, sf_dir):
    out = vectors.plane(_vectors(spark, sf_dir), "embedding")
    return out.select("vec_id", long("label").alias("label"), r6(F.abs("x")).alias("x"), r6(F.abs("y")).alias("y"))


# --- error rows, positions, nested fields, open-set records ---------------------------


def _distances(spark, sf_dir):
    """Events as measured distances; every 29th couldn't be read."""
    events = table(spark, sf_dir, "events")
    error = F.when(F.col("event_id") % 29 == 7, F.concat(F.lit("cannot read "), F.col("event_id").cast("string")))
    return audits.distance_results(events.withColumn("_d", F.floor(F.col("value") * 100) % 40 / 100).withColumn("_e", error), "_d", "event_type", "event_type", "_e")


@query
def distance_error_rows(spark, sf_dir):
    return _distances(spark, sf_dir).select("event_id", "distance", "nearest_id", "true_category", "error")


@query
def distance_without_errors(spark, sf_dir):
    out = audits.without_errors(_distances(spark, sf_dir)).groupBy("true_category")
    return out.agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"), r6(F.avg("distance")).alias("mean"))


@query
def run_tally(spark, sf_dir):
    return audits.tally(_distances(spark, sf_dir), "error", "event_type")


@query
def answer_by_position(spark, sf_dir):
    s = _solutions(spark, sf_dir)
    odd = F.when(F.col("doc_id") % 17 == 4, F.concat(F.lit("</answer>"), F.col("solution"))).otherwise(F.col("solution"))
    return s.select("doc_id", X.answer_by_position(odd).alias("answer"))


@query
def json_nested_path(spark, sf_dir):
    inner = F.to_json(F.struct(F.concat(F.lit(" "), F.col("event_type")).alias("category"), F.col("props").alias("extra")))
    outer = F.to_json(F.struct(inner.alias("metadata")))
    each = table(spark, sf_dir, "events").select("event_id", outer.alias("row"))
    at = lambda path: X.metadata_field(F.col("row"), path)
    return each.select("event_id", at("metadata.category").alias("category"), at("metadata.extra.k").try_cast("int").alias("k"), at("metadata.none.k").alias("missing"))


@query
def record_build_plain(spark, sf_dir):
    return _records(spark, sf_dir, lambda c, _, __: P.plain_solution(c))


@query
def class_list_union(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    part = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("n_nationkey", "n_name")))), lambda x: x["n_name"])
    lists = nation.agg(part(F.col("n_regionkey") < 2).alias("id"), part(F.col("n_regionkey") >= 2).alias("ood"))
    return lists.select(F.posexplode(P.class_list(F.col("id"), F.col("ood"))).alias("pos", "category")).select(long("pos").alias("pos"), "category")


@query
def osr_records(spark, sf_dir):
    similar = _similar(spark, sf_dir).select("vec_id", "label", F.col("closest").alias("closest"), F.round("similarity", 6).alias("similarity"))
    items = similar.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), "label", "similarity", F.col("closest").cast("string").alias("closest"))
    out = P.osr_rows(items.where("label < 5").select("path", "category"), items.where("label >= 5").select("path", "category", "similarity", "closest"), 8, noise=True)
    m = F.col("metadata")
    texts = [X.metadata_field(m, k).alias(k) for k in ("type", "category", "closest_id", "difficulty", "split")]
    numbers = [X.metadata_field(m, k).try_cast("double").alias(k) for k in ("confidence_target", "pseudo_ood_score", "max_similarity")]
    return out.select("image", "solution", *texts, *numbers)
