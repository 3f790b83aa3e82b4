"""Queries over files that are first written from the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..scratch import new_place
from ..sources import arrow_folder, publish
from ..sources import readers as R
from ..sources import writers as W
from . import builders as P
from .oracles import _SOLUTIONS
from .queries import Query, _solutions, long, r6, table

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def json_record_array(spark, sf_dir):
    """Documents as arrays of records: texts with quotes, line ends and brackets."""
    docs = table(spark, sf_dir, "documents")
    odd = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit('}{"\\[: '), "text")).otherwise(F.col("text"))
    path = new_place(spark, "records")
    W.save_arrays(docs.select(F.col("doc_id").cast("string").alias("image"), odd.alias("problem"), F.col("lang").alias("solution"), F.to_json(F.struct("source")).alias("metadata")), path)
    got = R.record_array(spark, path)
    return got.select(F.col("image").cast("long").alias("doc_id"), F.md5("problem").alias("problem_md5"), "solution", F.get_json_object("metadata", "$.source").alias("source"))


@query
def coco_documents(spark, sf_dir):
    """A detection set as COCO documents, and how many boxes of what area each category has in it."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    paths = {k: new_place(spark, k) for k in ("images", "annotations", "categories")}
    W.save_arrays(orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("a}b/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height")), paths["images"], "images")
    box = F.array(*(x.cast("double") for x in (F.col("l_partkey") % 400, F.col("l_suppkey") % 300, F.col("l_quantity"), F.lit(7))))
    W.save_arrays(lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 25).alias("category_id"), box.alias("bbox"), (F.col("l_quantity") * 7).cast("double").alias("area"), F.lit(0).alias("iscrowd")), paths["annotations"], "annotations")
    W.save_arrays(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), paths["categories"], "categories")
    images, annotations, categories = R.coco(spark, list(paths.values()))
    met = annotations.join(images, "image_id").join(F.broadcast(R.label_index(categories)), "category_id").join(F.broadcast(categories), "category_id")  # a row a category
    return met.groupBy("label", "name").agg(F.count("*").alias("boxes"), F.count_distinct("file_name").alias("files"), r6(F.sum("area")).alias("area"), r6(F.sum(F.get("bbox", 0))).alias("x")).withColumn("label", long("label"))


@query
def distance_document(spark, sf_dir):
    """Distances kept as JSON objects keyed by row, and their distribution."""
    events = table(spark, sf_dir, "events")
    error = F.when(F.col("event_id") % 31 == 3, F.concat(F.lit('cannot read "'), F.col("event_id").cast("string"), F.lit('": {'))).otherwise(F.lit(None))
    path = new_place(spark, "distances")
    W.save_objects(events.select("event_id", (F.col("event_id") % 97 / 64).alias("distance"), F.col("event_type").alias("nearest_id"), F.col("event_type").alias("true_category"), error.alias("error")), path, "event_id")
    got = R.distances(spark, path)
    return got.groupBy("true_category").agg(F.count("*").alias("n"), F.count("error").alias("errors"), long(F.sum("row_id")).alias("rows"), F.max("error").alias("last"), r6(F.sum("distance")).alias("total"))


@query
def prediction_document(spark, sf_dir):
    """Entries of result files, by category."""
    lines, path = table(spark, sf_dir, "lineitem"), new_place(spark, "predictions")
    W.save_arrays(lines.select(F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 25).alias("category_id"), F.array(*(x.cast("double") for x in (F.col("l_partkey") % 400, F.lit(2), F.col("l_quantity"), F.lit(4)))).alias("bbox"), (F.col("l_linenumber") / 8).alias("score")), path)
    return R.predictions(spark, path).groupBy("category_id").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"), r6(F.sum(F.get("bbox", 2))).alias("width"), F.max("score").alias("best"))


@query
def arrow_dataset(spark, sf_dir):
    """Orders with their lines nested, saved as Arrow files by split and one split read back."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("lines"))  # seven a key at most
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey").withColumn("split", F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train"))
    path = new_place(spark, "arrow")
    arrow_folder.save_arrow(orders.select("o_orderkey", "o_orderdate", "lines", "split"), path, "split")
    one = R.dataset(spark, path, "val").where("split = 'val'").select("o_orderkey", "o_orderdate", F.explode("lines").alias("l"))
    return one.groupBy("l.l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("orders"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"), long(F.sum("l.l_linenumber")).alias("numbers"))


@query
def rewrite_in_place(spark, sf_dir):
    """A table replaced by one computed from it."""
    path = new_place(spark, "rewritten")
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").write.parquet(path)
    W.rewrite(spark.read.parquet(path).withColumn("c_mktsegment", F.lower("c_mktsegment")).where("c_nationkey <> 7"), path)
    return R.dataset(spark, path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), long(F.sum("c_custkey")).alias("keys"))


@query
def feature_cache(spark, sf_dir):
    """Features computed once for each input and parameter, and read from then on."""
    root, source = new_place(spark, "cache"), new_place(spark, "cached_input")
    table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").write.parquet(source)
    features = lambda n: publish.cached(spark, root, lambda: spark.read.parquet(source).select("vec_id", "label", F.get("embedding", n).cast("double").alias("x")), [source], dim=n)
    both = features(0).unionByName(features(3)).unionByName(features(0))
    return both.groupBy(long("label").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"))


@query
def copied_tree(spark, sf_dir):
    """Files of each class copied into a class tree, twice, and listed from there."""
    flat, tree, record = (new_place(spark, k) for k in ("flat", "tree", "copies"))
    named = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")  # 25 rows
    named.select(F.col("s_name").alias("value"), F.regexp_replace("n_name", " ", "_").alias("c")).repartition("c").write.partitionBy("c").text(flat)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(flat).select("path", "length")
    c = F.regexp_extract("path", r"/c=([^/]+)/", 1)
    manifest = files.select(F.col("path").alias("source"), F.concat(F.lit(f"{tree}/"), c, F.lit("/1.jpg")).alias("destination"))
    for _ in range(2):
        done = publish.copy_files(manifest, record)
    there = R.image_tree(spark, tree).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return there.join(done.select(F.regexp_replace("destination", "^file:/+", "/").alias("path"), "status"), "path").select("category", "status", long("length").alias("n_bytes"))


@query
def upper_median_by_source(spark, sf_dir):
    """Lengths of the documents of each source, from a JSON lines folder."""
    path = new_place(spark, "lines")
    W.save_lines(table(spark, sf_dir, "documents").select("source", F.length("text").cast("long").alias("n")), path)
    return A.upper_median(spark.read.schema("source string, n long").json(path), "n", ["source"]).withColumnRenamed("upper_median", "median")


@query
def voc_annotations(spark, sf_dir):
    """Suppliers as VOC files of forty boxes each, read into a COCO set."""
    flat, tree, record = (new_place(spark, k) for k in ("xml", "voc", "copies"))
    key = F.col("s_suppkey")
    x = key % 100
    named = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")  # 25 rows
    box = F.format_string("<object><name> %s </name><bndbox><xmin>%d.9</xmin><ymin>2</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>", "n_name", x, x + 30, key % 40 + 10)
    each = named.groupBy(F.floor(key / 40).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", box.alias("b")))), lambda r: r["b"]), "").alias("objects"))  # forty a file
    xml = F.concat(F.lit("<annotation><filename>"), F.col("g").cast("string"), F.lit(".jpg</filename><size><width>400</width><height>200</height></size>"), "objects", F.lit("</annotation>"))
    each.select(xml.alias("value"), "g").repartition("g").write.partitionBy("g").text(flat)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(flat).select("path")
    g = F.regexp_extract("path", r"/g=(\d+)/", 1)
    publish.copy_files(files.select(F.col("path").alias("source"), F.concat(F.lit(f"{tree}/"), g, F.lit(".xml")).alias("destination")), record)
    images, annotations, categories = P.coco_from_voc(R.voc_boxes(R.voc(spark, tree)))
    met = annotations.join(categories, "category_id").join(images, "image_id")
    return met.groupBy("name", long("category_id").alias("category_id")).agg(F.count("*").alias("boxes"), long(F.min("image_id")).alias("first_image"), long(F.sum("annotation_id")).alias("ids"), long(F.sum("area")).alias("area"), long(F.sum(F.get("bbox", 0))).alias("x"))


@query
def label_file(spark, sf_dir):
    """Class names by their line in a label file, joined to predicted numbers."""
    path = new_place(spark, "labels")
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("  ")).alias("value")).orderBy("n_nationkey")
    names.select("value").coalesce(1).write.text(path)  # 25 rows
    found = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 27).alias("label_id"))
    met = found.join(F.broadcast(R.labels(spark, path)), "label_id", "left")
    return met.groupBy("name").agg(F.count("*").alias("n"))


@query
def image_folders(spark, sf_dir):
    """A class tree with several kinds of files: the plain and the wide scan, and the file of a stem with the first suffix."""
    flat, tree, record = (new_place(spark, k) for k in ("flat", "images", "copies"))
    named = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")  # 25 rows
    kind = F.element_at(F.array(*map(F.lit, ("jpg", "PNG", "bmp", "txt"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    named.select(F.col("s_name").alias("value"), F.lower(F.regexp_replace("n_name", " ", "-")).alias("c"), kind.alias("k")).repartition("c", "k").write.partitionBy("c", "k").text(flat)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(flat).select("path")
    part = lambda n: F.regexp_extract("path", f"/{n}=([^/]+)/", 1)
    publish.copy_files(files.select(F.col("path").alias("source"), F.concat(F.lit(f"{tree}/"), part("c"), F.lit("/"), part("c"), F.lit("."), part("k")).alias("destination")), record)
    classes = table(spark, sf_dir, "nation").select(F.regexp_replace("n_name", " ", "_").alias("canonical"), F.when(F.col("n_regionkey") < 2, "id").otherwise("ood").alias("role"), F.lit(1).alias("priority"))
    plain = R.image_tree(spark, tree).groupBy("category").agg(F.count("*").alias("plain"))
    wide = R.image_tree_wide(spark, tree, classes).groupBy("category", "canonical", "role").agg(F.count("*").alias("wide"))
    first = R.first_existing(wide.select("category"), R.image_tree(spark, tree, glob="*"), "category", (".bmp", ".png", ".jpg"), required=False)
    met = wide.join(plain, "category", "left").join(first, "category")
    return met.select("category", "canonical", "role", "wide", F.coalesce("plain", F.lit(0).cast("long")).alias("plain"), F.lower(F.regexp_extract("found", r"\.(\w+)\z", 1)).alias("first"))


@query
def solution_results(spark, sf_dir):
    """Solutions with generated thoughts, and result rows with guarded answers and errors."""
    s = _solutions(spark, sf_dir)
    thought = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>about "), "source", F.lit("</think>")))
    answer = X.guarded_class(F.when(F.col("doc_id") % 19 == 6, F.lit("[[1, 2]]")).when(F.col("doc_id") % 5 == 2, F.lit("")).otherwise(F.col("lang")))
    error = F.when(F.col("doc_id") % 23 == 9, F.concat(F.lit("timeout of "), F.repeat(F.lit("x"), 200)))
    row = P.result_row(answer, F.when(F.col("doc_id") % 2 == 0, F.lit("EN")).otherwise(F.col("lang")), error)
    kept = P.records(s.select("doc_id", "source", "lang", "solution"), "source", F.lit("What is this?"), P.thought_solution(thought, F.col("solution")), F.col("doc_id"))
    texts = kept.select(F.col("metadata").alias("doc_id"), "image", "problem", F.md5("solution").alias("solution"))
    return s.select("doc_id", *row).join(texts, "doc_id")


ORACLES = {
    "json_record_array": r"""SELECT doc_id, md5(CASE WHEN doc_id % 5 = 1 THEN '}{"\[: ' || text ELSE text END) AS problem_md5, lang AS solution, source FROM documents""",
    "coco_documents": """SELECT cast(n_nationkey AS BIGINT) AS label, n_name AS name, count(*) AS boxes, count(DISTINCT l_orderkey) AS files, round(cast(sum(cast(l_quantity * 7 AS DOUBLE)) AS DOUBLE), 6) AS area, round(sum(cast(l_partkey % 400 AS DOUBLE)), 6) AS x
        FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 25 JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""",
    "distance_document": """SELECT event_type AS true_category, count(*) AS n, count(e) AS errors, cast(sum(event_id) AS BIGINT) AS rows, max(e) AS last, round(sum(event_id % 97 / 64), 6) AS total
        FROM (SELECT *, CASE WHEN event_id % 31 = 3 THEN 'cannot read "' || event_id || '": {' END AS e FROM events) GROUP BY ALL""",
    "prediction_document": """SELECT l_suppkey % 25 AS category_id, count(*) AS n, count(DISTINCT l_orderkey) AS images, round(sum(cast(l_quantity AS DOUBLE)), 6) AS width, max(l_linenumber / 8) AS best FROM lineitem GROUP BY ALL""",
    "arrow_dataset": """SELECT l_returnflag, count(*) AS n, count(DISTINCT o_orderkey) AS orders, strftime(max(o_orderdate), '%Y-%m-%d') AS last, cast(sum(l_linenumber) AS BIGINT) AS numbers
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 = 0 GROUP BY ALL""",
    "rewrite_in_place": """SELECT lower(c_mktsegment) AS c_mktsegment, count(*) AS n, cast(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_nationkey <> 7 GROUP BY ALL""",
    "feature_cache": """SELECT cast(label AS BIGINT) AS label, 3 * count(*) AS n, round(sum(2 * cast(embedding[1] AS DOUBLE) + cast(embedding[4] AS DOUBLE)), 4) AS x FROM embeddings GROUP BY ALL""",
    "copied_tree": """SELECT replace(n_name, ' ', '_') AS category, 'there' AS status, cast(sum(length(s_name) + 1) AS BIGINT) AS n_bytes FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""",
    "voc_annotations": """WITH b AS (SELECT s_suppkey, s_suppkey // 40 AS g, n_name, s_suppkey % 100 AS x, s_suppkey % 40 + 10 - 2 AS h FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        i AS (SELECT g, row_number() OVER (ORDER BY g || '.jpg') - 1 AS image_id FROM (SELECT DISTINCT g FROM b)),
        c AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS category_id FROM (SELECT DISTINCT n_name FROM b)),
        a AS (SELECT *, row_number() OVER (ORDER BY image_id, s_suppkey) - 1 AS id FROM b JOIN i USING (g) JOIN c USING (n_name))
        SELECT n_name AS name, category_id, count(*) AS boxes, min(image_id) AS first_image, cast(sum(id) AS BIGINT) AS ids, cast(sum(30 * h) AS BIGINT) AS area, cast(sum(x) AS BIGINT) AS x FROM a GROUP BY ALL""",
    "label_file": """SELECT n_name AS name, count(*) AS n FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 27 GROUP BY ALL""",
    "image_folders": """WITH f AS (SELECT DISTINCT n_name, n_regionkey, s_suppkey % 4 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT lower(replace(n_name, ' ', '-')) AS category, replace(n_name, ' ', '_') AS canonical, CASE WHEN n_regionkey < 2 THEN 'id' ELSE 'ood' END AS role, count(*) FILTER (k < 3) AS wide, count(*) FILTER (k < 2) AS plain,
        CASE WHEN bool_or(k = 2) THEN 'bmp' WHEN bool_or(k = 1) THEN 'png' ELSE 'jpg' END AS first FROM f GROUP BY n_name, n_regionkey HAVING count(*) FILTER (k < 3) > 0""",
    "solution_results": f"""WITH {_SOLUTIONS}, a AS (SELECT *, CASE WHEN doc_id % 19 = 6 THEN 'unknown' WHEN doc_id % 5 = 2 THEN 'unknown' ELSE lang END AS answer, CASE WHEN doc_id % 2 = 0 THEN 'EN' ELSE lang END AS truth,
        CASE WHEN doc_id % 23 = 9 THEN left('timeout of ' || repeat('x', 200), 120) END AS error, regexp_extract(solution, '(?s)(<answer>.*?</answer>)', 1) AS tag FROM s)
        SELECT doc_id, truth, answer, (contains(lower(answer), lower(truth)) OR contains(lower(truth), lower(answer))) AND error IS NULL AS is_correct, error, source AS image, 'What is this?' AS problem,
        md5(CASE WHEN doc_id % 3 = 0 THEN '<solution>' || concat_ws(chr(10), '<think>about ' || source || '</think>', nullif(tag, '')) || '</solution>' ELSE solution END) AS solution FROM a""",
    "upper_median_by_source": """SELECT source, list_sort(list(length(text)))[len(list(text)) // 2 + 1] AS median FROM documents GROUP BY ALL""",
}
