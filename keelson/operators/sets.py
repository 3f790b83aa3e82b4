"""Set checks between class lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def invalid_classes(seen: DataFrame, expected: DataFrame, name: str = "category") -> DataFrame:
    """Distinct names that are seen but not expected."""
    return seen.select(name).distinct().join(expected.select(name), name, "left_anti")


def missing_classes(seen: DataFrame, expected: DataFrame, name: str = "category") -> DataFrame:
    """Distinct names that are expected but not seen."""
    return invalid_classes(expected, seen, name)


def partition_report(parts: DataFrame, whole: DataFrame, part: str = "part", name: str = "category") -> DataFrame:
    """One row: do the parts overlap, and do they cover ``whole`` exactly?"""
    counts = parts.select(part, name).distinct().groupBy(name).agg(F.count("*").alias("in_parts"))
    both = whole.select(name, F.lit(1).alias("in_whole")).distinct().join(counts, name, "full")
    return both.agg(
        F.count_if(F.col("in_parts") > 1).alias("overlapping"),
        F.count_if(F.col("in_parts").isNull()).alias("missing"),
        F.count_if(F.col("in_whole").isNull()).alias("invalid"),
    )


def tagged_union(tag: str = "source", **frames: DataFrame) -> DataFrame:
    """All rows of all frames, each with the name of its frame."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
