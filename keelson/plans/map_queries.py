"""Queries that map rows by functions of a user, and their DuckDB SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions import images
from ..operators import neighbours, vectors
from ..operators.maps import map_chain, map_function, map_rows
from ..scratch import stored
from .queries import DIMS, Query, long, r6, table

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@map_function("label string, size long")
def part_label(row):
    """The material of a part's type and its size; parts without a label go, and some can't be read."""
    words = row["p_type"].split()
    if row["p_partkey"] % 37 == 11:
        raise ValueError(f"cannot read {row['p_partkey']}")
    if row["p_size"] % 10 == 4:
        return None
    return {"label": words[-1].lower(), "size": int(row["p_size"])}


@map_function("prompt string")
def part_prompt(row):
    if row["label"] == "tin":
        return None
    return {"prompt": f"Is this {row['label']}? " + "x" * row["size"]}


@map_function("checksum long", by_batch=True)
def name_checksum(batch):
    return [[zlib.crc32(x.encode()) for x in batch.column("c_name").to_pylist()]]


@map_function("content binary")
def supplier_image(row):
    """A grey image of the supplier's name; every seventh is cut, every eleventh has a bit changed."""
    name = row["s_name"].encode()
    made = images.png(len(name), [name, name[::-1], bytes(len(name))])
    if row["s_suppkey"] % 7 == 3:
        return {"content": made[: -(row["s_suppkey"] % 40 + 1)]}
    if row["s_suppkey"] % 11 == 5:
        at = 16 + row["s_suppkey"] % 30
        return {"content": made[:at] + bytes([made[at] ^ 1]) + made[at + 1 :]}
    return {"content": made}


@query
def mapped_parts(spark, sf_dir):
    return map_rows(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), "part_label").select("p_partkey", "label", "size", "error")


@query
def mapped_chain(spark, sf_dir):
    out = map_chain(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), "part_label", "part_prompt")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.count("error").alias("errors"), long(F.sum(F.length("prompt"))).alias("chars"))


@query
def mapped_batches(spark, sf_dir):
    out = map_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "name_checksum", error=None)
    return out.select("c_custkey", (F.col("checksum") == F.crc32(F.col("c_name").cast("binary"))).alias("same"))


@query
def whole_images(spark, sf_dir):
    made = map_rows(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "supplier_image", error=None)
    return images.decodable(made).groupBy(long("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), long(F.sum("s_suppkey")).alias("keys"))


@query
def missing_features(spark, sf_dir):
    """Features of labelled documents, zeros where there are none."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), vectors.doubles("embedding").alias("v")).where("doc_id % 3 <> 1")
    met = table(spark, sf_dir, "labels").select("doc_id", "quality").join(v, "doc_id", "left").withColumn("v", vectors.or_zero(F.col("v"), DIMS))
    return met.groupBy(long("quality").alias("quality")).agg(F.count("*").alias("n"), F.count_if(F.get("v", 0) == 0).alias("zeros"), r6(F.sum(F.get("v", 5))).alias("x"))


@query
def neighbour_places(spark, sf_dir):
    """A map of the embeddings in which neighbours stay together."""
    return neighbours.neighbour_map(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", steps=30).select(F.col("id").alias("vec_id"), r6("x").alias("x"), r6("y").alias("y"))


@query
def neighbours_kept(spark, sf_dir):
    """Whether that map keeps more of each row's neighbours than the principal plane."""
    rows = table(spark, sf_dir, "embeddings")
    flat = vectors.plane(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "v").select("id", "x", "y")
    graph = stored(neighbours.nearest_neighbours(rows, "vec_id", "embedding", 30), "graph")  # of the map and of both measures
    places = neighbours.neighbour_map(rows, "vec_id", "embedding", steps=30, graph=graph)
    kept = [neighbours.preserved(rows, "vec_id", "embedding", p, graph=graph).select(F.col("kept").alias(f"kept{k}")) for k, p in enumerate((places, flat))]
    both = kept[0].join(F.broadcast(kept[1])).join(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row each
    return both.select("n", (F.col("kept0") > F.col("kept1")).alias("keeps_more"))


_PART = """m AS (SELECT p_partkey, lower(string_split(p_type, ' ')[-1]) AS label, cast(p_size AS BIGINT) AS size, p_partkey % 37 = 11 AS bad FROM part WHERE p_partkey % 37 = 11 OR p_size % 10 <> 4),
e AS (SELECT p_partkey, CASE WHEN NOT bad THEN label END AS label, CASE WHEN NOT bad THEN size END AS size, CASE WHEN bad THEN 'ValueError: cannot read ' || p_partkey END AS error FROM m)"""
ORACLES = {
    "mapped_parts": f"WITH {_PART} SELECT p_partkey, label, size, error FROM e",
    "mapped_chain": f"""WITH {_PART} SELECT label, count(*) AS n, count(error) AS errors, cast(sum(length('Is this ' || label || '? ') + size) AS BIGINT) AS chars FROM e WHERE label IS DISTINCT FROM 'tin' GROUP BY ALL""",
    "mapped_batches": "SELECT c_custkey, true AS same FROM customer",
    "whole_images": "SELECT cast(s_nationkey AS BIGINT) AS nation, count(*) AS n, cast(sum(s_suppkey) AS BIGINT) AS keys FROM supplier WHERE s_suppkey % 7 <> 3 AND s_suppkey % 11 <> 5 GROUP BY ALL",
    "neighbours_kept": "SELECT count(*) AS n, true AS keeps_more FROM embeddings",
    "missing_features": """SELECT cast(quality AS BIGINT) AS quality, count(*) AS n, count(*) FILTER (coalesce(embedding[1], 0) = 0) AS zeros, round(coalesce(sum(cast(embedding[6] AS DOUBLE)), 0), 6) AS x
        FROM labels LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 3 <> 1) e ON vec_id = doc_id GROUP BY ALL""",
}
