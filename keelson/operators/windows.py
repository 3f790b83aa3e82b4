"""Order-dependent operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import range_bucket, sampled_ranges, with_position, with_running


def contiguity(df: DataFrame, by: str, idx: str) -> DataFrame:
    """``(by, n, lo, hi, contiguous)``: each index of a class has to follow the one before by one, so a repeated index breaks it too; no sort."""
    each = df.groupBy(by, idx).agg(F.count("*").alias("_n"))
    out = each.groupBy(by).agg(F.sum("_n").alias("n"), F.min(idx).alias("lo"), F.max(idx).alias("hi"), F.max("_n").alias("_most"))
    return out.withColumn("contiguous", (F.col("hi") - F.col("lo") + 1 == F.col("n")) & (F.col("_most") == 1)).drop("_most")


def gaps(df: DataFrame, by: str, idx: str) -> DataFrame:
    """Rows whose index doesn't follow the one before in their class, with that one as ``previous``.

    A class is cut into ranges of the index; each range looks within itself, and its
    first row at the largest index of the ranges before, a number for each class and
    range.  So one class may hold most rows.  Rows without an index have no place.
    """
    marked = range_bucket(df, idx).mark(df.where(F.col(idx).isNotNull()), "_b")
    before = F.max("_last").over(Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    ends = marked.groupBy(F.col(by).alias("_by"), F.col("_b").alias("_at")).agg(F.max(idx).alias("_last")).select("_by", "_at", before.alias("_before"))  # some hundred rows a class
    own = marked.withColumn("previous", F.lag(idx).over(Window.partitionBy(by, "_b").orderBy(idx)))
    met = own.join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_at")))
    return met.withColumn("previous", F.coalesce("previous", "_before")).where(F.col(idx) - F.col("previous") != 1).select(*df.columns, "previous")


def first_seen_ids(df: DataFrame, value: str, pos: str, name: str = "id") -> DataFrame:
    """``(value, id)``: distinct values numbered from 0 in order of first appearance, then of the value."""
    firsts = df.groupBy(value).agg(F.min(pos).alias("_first"))
    return with_position(firsts, ["_first", value], sampled_ranges(firsts, "_first"), name).drop("_first")


def sorted_ids(df: DataFrame, value: str, name: str = "id") -> DataFrame:
    """``(value, id)``: distinct values numbered from 0 in their own order, null first."""
    distinct = df.select(value).distinct()
    return with_position(distinct, [value], sampled_ranges(distinct, value), name)


def running_accuracy(df: DataFrame, batch: str, correct: Column, every: int = 5) -> DataFrame:
    """``(batch, correct, total, accuracy)`` after every ``every`` batches: batches are summed, and then their sums along ranges of batches."""
    sums = df.groupBy(batch).agg(F.count_if(correct).alias("_c"), F.count("*").alias("_t"))
    run = with_running(sums, [batch], range_bucket(sums, batch), correct=F.col("_c"), total=F.col("_t")).drop("_c", "_t")
    return run.where((F.col(batch) + 1) % every == 0).withColumn("accuracy", 100 * F.col("correct") / F.col("total"))
