"""Writers."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .publish import replaced


def save_dataset(df: DataFrame, path: str, split: str | None = "split") -> None:
    """Parquet, one folder for each split if there is such a column."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split and split in df.columns else writer).parquet(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` that ``df`` may be read from, in one step."""
    replaced(df.sparkSession, path, lambda new: df.write.parquet(new))


def save_lines(df: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines; one file only where the table is small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def save_document(path: str, **arrays: DataFrame) -> None:
    """One JSON document of small tables, each an array (COCO, distances, settings)."""
    out = None
    for name, df in arrays.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    out.select(F.to_json(F.struct(*arrays)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _bracketed(batches: Iterator[pa.RecordBatch], opens: str, closes: str) -> Iterator[pa.RecordBatch]:
    """Lines of one JSON array, a line ahead of what is written; an empty part stays empty."""
    last = None
    for batch in batches:
        values = batch.column(0)
        if not len(values):
            continue
        if last is None:
            last = pa.array([opens + values[0].as_py()], pa.string())
            values = values[1:]
        out = pa.concat_arrays([last, values])
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(out[:-1], ",", "")], ["value"])
        last = out[-1:]
    if last is not None:
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(last, closes, "")], ["value"])


def save_arrays(df: DataFrame, path: str, key: str | None = None) -> None:
    """JSON documents of any size in all: a file for each partition, an array of its rows, or with ``key`` an object that holds it."""
    opens, closes = ("[", "]") if key is None else (f"{{{json.dumps(key)}: [", "]}")
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(partial(_bracketed, opens=opens, closes=closes), "value string")
    lines.write.mode("overwrite").text(path)


def save_objects(df: DataFrame, path: str, key: str) -> None:
    """JSON objects of objects: a file for each partition, its rows by the text of the column ``key``."""
    name = F.expr(f"to_json(named_struct('k', cast(`{key}` AS string)))")  # {"k":"..."}
    value = F.to_json(F.struct(*(c for c in df.columns if c != key)))
    lines = df.select(F.substring(name, 6, 1 << 30).alias("n"), value.alias("v")).select(F.concat(F.expr("left(n, length(n) - 1)"), F.lit(": "), "v").alias("value"))
    lines.mapInArrow(partial(_bracketed, opens="{", closes="}"), "value string").write.mode("overwrite").text(path)


def save_report(df: DataFrame, path: str, columns: Sequence[str], by: str | None = None, separator: str = "\t") -> None:
    """Text lines; with ``by`` one block for each value of that column."""
    line = F.concat_ws(separator, *(F.col(c).cast("string") for c in columns))
    if by is None:
        out = df.select(line.alias("value"))
    else:
        lines = df.groupBy(by).agg(F.sort_array(F.collect_list(line)).alias("lines"))
        out = lines.orderBy(by).select(F.concat_ws("\n", F.concat(F.lit("["), F.col(by).cast("string"), F.lit("]")), F.array_join("lines", "\n")).alias("value"))
    out.coalesce(1).write.mode("overwrite").text(path)


def copy_manifest(df: DataFrame, path: str, target: str) -> DataFrame:
    """``(source, destination)`` for files to copy: the target folder and the file's own name."""
    return df.select(F.col(path).alias("source"), F.concat_ws("/", F.lit(target), X.base_name(F.col(path))).alias("destination"))
