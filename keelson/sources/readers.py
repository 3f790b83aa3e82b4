"""Readers: image trees, annotations, records, label lists, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as X
from ..operators.joins import canonical_names
from ..operators.sampling import k_shot
from .arrow_folder import SPLITS, STATE, read_arrow
from .json_document import members
from .publish import cached as cached
from .publish import recover

GLOB = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"
#: Suffixes of the wider scan.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that exist; absent inputs are skipped before a read."""
    return [p for p in paths if exists(spark, p)]


def image_tree(spark: SparkSession, root: str, glob: str = GLOB, categories: DataFrame | None = None, content: bool = False) -> DataFrame:
    """``(path, length, category[, content])`` of ``root/<class>/<file>``; the folder is the label.

    File contents are not read unless asked for.  ``categories(category)`` keeps its
    classes alone; a class without files gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    out = files.select("path", "length", X.parent_folder(F.col("path")).alias("category"), *(["content"] if content else []))
    return out if categories is None else out.join(categories.select("category").distinct(), "category", "left_semi").select(out.columns)


def image_tree_wide(spark: SparkSession, root: str, table: DataFrame, per_class: int | None = None, seed: int = 42) -> DataFrame:
    """All image suffixes in any case, folder names matched to canonical classes with their role; optionally a sample of each class."""
    files = image_tree(spark, root, glob="*").where(X.extension(F.col("path")).isin(IMAGE_SUFFIXES))
    named = canonical_names(files, "category", table).where("canonical is not null")
    return named if per_class is None else k_shot(named, "canonical", "path", per_class, seed).drop("rn")


def with_fallbacks(available: DataFrame, wanted: Sequence[str], fallbacks: Sequence[str]) -> list[str]:
    """Class names to use: each wanted class without rows takes the next fallback that has rows and isn't used yet."""
    have = {r[0] for r in available.select("category").where(F.col("category").isin(*wanted, *fallbacks)).distinct().collect()}
    used = [c for c in wanted if c in have]
    spare = iter([c for c in fallbacks if c in have and c not in used])
    return used + [c for c in (next(spare, None) for w in wanted if w not in have) if c]


def sampled_tree(spark: SparkSession, root: str, shots: int, seed: int = 42) -> DataFrame:
    """``shots`` files of each class, all where there are fewer."""
    return k_shot(image_tree(spark, root), "category", "path", shots, seed)


def dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A saved dataset, or one split of it: Parquet, or a folder of Arrow files with its state."""
    recover(spark, path)
    if exists(spark, f"{path}/{STATE}") or exists(spark, f"{path}/{SPLITS}"):
        return read_arrow(spark, path, split)
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def _parsed(found: DataFrame, schema: T.StructType) -> DataFrame:
    """The objects in ``value`` as rows.

    A generator, so that conditions on the fields don't move below it: there each would
    parse every object again, those of other keys included.
    """
    return found.select(F.inline(F.array(F.from_json("value", schema))))


def _objects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of a JSON array as rows; other members are left out."""
    return _parsed(members(spark, path, 1), schema)


def record_array(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that each hold one array of records; a large file is read by many tasks."""
    return _objects(spark, path, schemas.RECORD_JSON)


def record_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RECORD_JSON).json(path)


def coco(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of a COCO file, or of several with parts of each."""
    found = members(spark, path, 2)

    def array(key: str) -> DataFrame:
        return _parsed(found.where(F.col("key") == key), schemas.COCO[key].dataType.elementType)

    images = array("images").select(F.col("id").alias("image_id"), "file_name", "width", "height")
    annotations = array("annotations").withColumnRenamed("id", "annotation_id")
    categories = array("categories").select(F.col("id").alias("category_id"), "name")
    return images, annotations, categories


def label_index(categories: DataFrame) -> DataFrame:
    """``(category_id, label)``: dense index in order of the category id."""
    return categories.select("category_id").distinct().withColumn("label", F.row_number().over(Window.orderBy("category_id")) - 1)


def voc(spark: SparkSession, root: str) -> DataFrame:
    """``(path, filename, width, height, objects)`` of every annotation file under ``root``."""
    raw = spark.read.text(root, wholetext=True, pathGlobFilter="*.xml", recursiveFileLookup=True)
    parsed = raw.select(F.input_file_name().alias("path"), F.from_xml("value", schemas.VOC, {"rowTag": "annotation"}).alias("a"))
    number: dict[str, Column] = {k: X.truncated_number(F.col(f"a.size.{k}")) for k in ("width", "height")}
    return parsed.select("path", F.trim("a.filename").alias("filename"), number["width"].alias("width"), number["height"].alias("height"), F.col("a.object").alias("objects"))


def voc_boxes(annotations: DataFrame) -> DataFrame:
    """``(filename, pos, name, xmin, ymin, xmax, ymax)``, one row for each object."""
    each = annotations.select("filename", F.posexplode("objects").alias("pos", "o"))
    box = [X.truncated_number(F.col(f"o.bndbox.{k}")).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")]
    return each.select("filename", "pos", X.stripped(F.col("o.name")).alias("name"), *box)


def voc_classes(annotations: DataFrame) -> DataFrame:
    """Distinct class names, without the boxes being read."""
    return annotations.select(F.explode("objects.name").alias("name")).select(X.stripped(F.col("name")).alias("name")).where("name <> ''").distinct()


def distances(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, distance, nearest_id, true_category, error)`` from a JSON object of objects keyed by row number."""
    each = members(spark, path, 1).select("key", F.from_json("value", schemas.DISTANCES.valueType).alias("v"))
    return each.select(F.col("key").try_cast("long").alias("row_id"), "v.*")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """``(label_id, name)``: stripped lines numbered from 0 by their place in the file."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.split(X.stripped(F.col("value")), r"\r?\n")).alias("label_id", "name"))
    return lines.select("label_id", X.stripped(F.col("name")).alias("name"))


def manifest(df: DataFrame, column: str = "entries") -> DataFrame:
    """``(path, label_id)`` from rows that hold maps of path to label."""
    return df.select(F.explode(column).alias("path", "label_id"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a COCO result file."""
    return _objects(spark, path, schemas.PREDICTION)


def first_existing(df: DataFrame, files: DataFrame, key: str, suffixes: Sequence[str] = (".jpg", ".jpeg", ".png"), required: bool = True) -> DataFrame:
    """Adds ``found``: the file of that stem with the first suffix in order; an error (or null) without one."""
    order = F.array_position(F.array(*map(F.lit, suffixes)), X.extension(F.col("path")))
    best = files.select(X.stem(F.col("path")).alias(key), "path", order.alias("_o")).where("_o > 0").groupBy(key).agg(F.min_by("path", "_o").alias("found"))
    out = df.join(best, key, "left")
    if required:
        missing = F.raise_error(F.concat(F.lit("no file for "), F.col(key)))
        out = out.withColumn("found", F.when(F.col("found").isNull(), missing).otherwise(F.col("found")))
    return out


def from_either(df: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Adds ``found``: the path in the first listing, else in the second."""
    a = first.select(key, F.col("path").alias("_a"))
    b = second.select(key, F.col("path").alias("_b"))
    return df.join(a, key, "left").join(b, key, "left").withColumn("found", F.coalesce("_a", "_b")).drop("_a", "_b")
