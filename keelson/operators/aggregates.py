"""Counts, distributions and class-level summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import range_bucket


def main_class(df: DataFrame, image: str, cls: str, pos: str, rule: str = "first_seen") -> DataFrame:
    """``(image, cls, n)``: the most frequent class of each image; ties go to the first seen or, by ``last_name``, to the last name.

    ``rule`` ``latest`` ignores counts and takes the last name alone.
    """
    counts = df.groupBy(image, cls).agg(F.count("*").alias("n"), F.min(pos).alias("_first"))
    keys = {
        "last_name": F.struct(F.col("n"), F.col(cls)),
        "latest": F.struct(F.col(cls)),
    }
    if rule == "first_seen":  # by name where even the first positions agree
        best = counts.groupBy(image).agg(F.min_by(F.struct(cls, "n"), F.struct(-F.col("n"), F.col("_first"), F.col(cls))).alias("_best"))
    else:
        best = counts.groupBy(image).agg(F.max_by(F.struct(cls, "n"), keys[rule]).alias("_best"))
    return best.select(image, F.col(f"_best.{cls}").alias(cls), F.col("_best.n").alias("n"))


def share(condition: Column) -> Column:
    """Percentage of rows; null for none."""
    return 100 * F.count_if(condition) / F.nullif(F.count("*"), F.lit(0))


def order_statistics(df: DataFrame, value: str, by: Sequence[str], places: dict[str, Column]) -> DataFrame:
    """The values at given places (from 0) of each group's sorted non-null values; a place is an expression of the group's size ``n``.

    Buckets of about equal size are counted first; only those that hold a place are
    sorted, each by itself, so a group may hold most rows.
    """
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    marked = range_bucket(values, "_v").mark(values, "_b")
    sizes = marked.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumns({"_upto": F.sum("_n").over(upto), "n": F.sum("_n").over(Window.partitionBy(*by))})  # some hundred buckets
    inside = [(p >= F.col("_upto") - F.col("_n")) & (p < F.col("_upto")) for p in places.values()]
    held = sizes.where(reduce(or_, inside)).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_b"])), (F.col("_upto") - F.col("_n")).alias("_start"), "n")
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_b"])])
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_v")) - 1
    placed = marked.join(held, on).withColumn("_at", F.col("_start") + own)
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("_at") == p, F.col("_v"))).alias(name) for name, p in places.items()))


def upper_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The element ``n // 2`` of the sorted values of each group."""
    return order_statistics(df, value, by, {"upper_median": F.floor(F.col("n") / 2)}).drop("n")


def bin_of(value: Column, edges: Sequence[float], last_closed: bool = False) -> Column:
    """Number of the bin ``[edges[k], edges[k + 1])``; beyond the last edge one more, null below the first.

    ``last_closed`` makes the last bin contain its upper edge and leaves the rest null.
    """
    out = F.when(value < edges[0], F.lit(None).cast("int"))
    for k, edge in enumerate(edges[1:]):
        inside = value <= edge if last_closed and k == len(edges) - 2 else value < edge
        out = out.when(inside, k)
    return out if last_closed else out.when(value.isNotNull(), len(edges) - 1)


def histogram(df: DataFrame, value: str, edges: Sequence[float], last_closed: bool = False) -> DataFrame:
    """``(bin, n, pct)`` with empty bins left out; ``pct`` of all non-null values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(bin_of(F.col(value), edges, last_closed).alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def frequencies(df: DataFrame, value: str) -> DataFrame:
    """``(value, n, pct)``."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def coordinate_median(df: DataFrame, by: str, *columns: str, least: int = 1) -> DataFrame:
    """Interpolated median of each column by class, for classes of ``least`` rows or more."""
    out = df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    half = {"_low": F.floor((F.col("n") - 1) / 2), "_high": F.floor(F.col("n") / 2)}
    for c in columns:
        middle = order_statistics(df, c, [by], half).select(F.col(by).alias("_by"), ((F.col("_low") + F.col("_high")) / 2).alias(c))
        out = out.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return out


def accuracy(df: DataFrame, correct: Column, manifest: DataFrame | None = None) -> DataFrame:
    """``(correct, total, accuracy)``; the total is the manifest's if there is one."""
    got = df.agg(F.count_if(correct).alias("correct"), F.count("*").alias("total"))
    if manifest is not None:
        got = got.drop("total").crossJoin(manifest.agg(F.count("*").alias("total")))  # one row each
    return got.withColumn("accuracy", 100 * F.col("correct") / F.nullif(F.col("total"), F.lit(0)))


def separation(df: DataFrame, distance: str, known: Column, unknown: Column) -> DataFrame:
    """Ranges and means of both groups, the gap between them, and thresholds inside it (null without a gap)."""
    d = F.col(distance)
    out = df.agg(
        F.count_if(known).alias("id_n"),
        F.count_if(unknown).alias("ood_n"),
        *(f(F.when(c, d)).alias(f"{g}_{n}") for g, c in (("id", known), ("ood", unknown)) for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))),
    )
    gap = F.col("ood_min") - F.col("id_max")
    out = out.withColumn("gap", gap)
    low = lambda part: F.when(F.col("gap") > 0, F.col("id_max") + part * F.col("gap"))
    high = F.when(F.col("gap") > 0, F.col("ood_min") - 0.2 * F.col("gap"))
    return out.withColumns({"unknown_mid": low(0.3), "unknown_high": high, "threshold_mid": low(0.2), "threshold_high": high})


def selected_mean_ap(per_class: DataFrame, selected: Sequence[str], cls: str = "cls", ap: str = "ap") -> DataFrame:
    """Sum of the selected classes' AP over their number; a class that is missing counts 0."""
    return per_class.where(F.col(cls).isin(*selected)).agg((F.coalesce(F.sum(ap), F.lit(0.0)) / len(selected)).alias("mean_ap"))
