"""Integrity reports: one row for each finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import expected_counts
from .windows import contiguity

# --- Fixed values. ---
FEW_OOD, LONG_SOLUTION = 10, 150
ERROR_DISTANCE, UNKNOWN = 0.5, "unknown"
DISTANCE_EDGES = [0.0, 0.10, 0.12, 0.14, 0.16, 0.18, 0.20, 0.22, 0.25]
# --- End of fixed values. ---


def integrity(df: DataFrame, by: str, idx: str, classes: DataFrame, shots: int) -> DataFrame:
    """``(category, issue, n)``: invalid, missing and miscounted classes, and classes whose indexes have gaps."""
    seen = df.groupBy(by).agg(F.count("*").alias("n"))
    known = classes.select(F.col(by).alias("_known")).distinct()
    met = seen.join(known, seen[by] == known["_known"], "full")
    found = met.select(
        F.coalesce(by, "_known").alias("category"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.when(F.col("_known").isNull(), "invalid").when(F.col("n").isNull(), "missing").when(F.col("n") != shots, "count").alias("issue"),
    ).where("issue is not null")
    loose = contiguity(df, by, idx).where("not contiguous").select(F.col(by).alias("category"), "n", F.lit("gap").alias("issue"))
    return found.unionByName(loose).select("category", "issue", "n")


def class_balance(df: DataFrame, by: str, classes: DataFrame, shots: int) -> DataFrame:
    """``(category, n, missing)`` for every expected class."""
    return expected_counts(classes, df, by).withColumn("missing", F.greatest(F.lit(0), F.lit(shots) - F.col("n")).cast("long"))


def sanity(df: DataFrame, is_ood: str, solution: str) -> DataFrame:
    """One row: numbers, share, mislabelled unknowns, solution lengths, and the first diagnosis that applies."""
    ood, size = F.col(is_ood), F.length(solution)
    out = df.agg(
        F.count_if(~ood).alias("n_id"),
        F.count_if(ood).alias("n_ood"),
        F.count_if(ood & ~F.contains(F.col(solution), F.lit("<answer>unknown</answer>"))).alias("ood_mislabelled"),
        F.round(F.avg(F.when(~ood, size)), 4).alias("id_avg_length"),
        F.round(F.avg(F.when(ood, size)), 4).alias("ood_avg_length"),
        F.max(size).cast("long").alias("max_length"),
    )
    verdict = (
        F.when(F.col("n_ood") < FEW_OOD, "too few unknown rows")
        .when(F.col("ood_mislabelled") > 0, "unknown rows without unknown label")
        .when(F.col("max_length") > LONG_SOLUTION, "solutions too long")
        .otherwise("ok")
    )
    return out.withColumns({"ood_pct": F.round(100 * F.col("n_ood") / F.nullif(F.col("n_id") + F.col("n_ood"), F.lit(0)), 4), "diagnosis": verdict})


def readiness(sources: dict[str, DataFrame], by: str, shots: int) -> DataFrame:
    """``(source, rows, classes, short_classes)`` for each source."""
    out = None
    for name, df in sources.items():
        n = df.groupBy(by).agg(F.count("*").alias("n"))
        row = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("classes"), F.count_if(F.col("n") < shots).alias("short_classes")).withColumn("source", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, before, after, changed)`` by key, not by position."""
    met = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    return met.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def distance_results(df: DataFrame, distance: str, nearest: str, truth: str, error: str) -> DataFrame:
    """Adds ``distance`` (four digits), ``nearest_id``, ``true_category`` and ``error``: a row with an error gets fixed values in their place."""
    ok = F.col(error).isNull()
    values = {"distance": (F.round(distance, 4), ERROR_DISTANCE), "nearest_id": (F.col(nearest), UNKNOWN), "true_category": (F.col(truth), UNKNOWN)}
    return df.withColumns({name: F.when(ok, c).otherwise(F.lit(other)) for name, (c, other) in values.items()} | {"error": F.col(error)})


def without_errors(df: DataFrame, error: str = "error") -> DataFrame:
    """Rows that analysis may use."""
    return df.where(F.col(error).isNull())


def tally(df: DataFrame, error: str = "error", *by: str) -> DataFrame:
    """``([by,] succeeded, failed, total)``."""
    ok = F.col(error).isNull()
    return df.groupBy(*by).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count("*").alias("total"))
