"""Look-ups against class tables.

Class tables are a few dozen rows and come as plain DataFrames; whether they are
broadcast is the optimiser's choice, by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised


def with_default(df: DataFrame, table: DataFrame, on: str, value: str, default: object) -> DataFrame:
    """Left join; rows without a match get ``default``."""
    return df.join(table.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def expected_counts(classes: DataFrame, observed: DataFrame, by: str) -> DataFrame:
    """``(by, n)`` for every expected class, 0 where none is observed."""
    counted = observed.groupBy(by).agg(F.count("*").alias("n"))
    return classes.select(by).join(counted, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def canonical_names(df: DataFrame, name: str, table: DataFrame, canonical: str = "canonical", priority: str = "priority") -> DataFrame:
    """Adds the canonical class whose normalised name agrees; of several the least priority number wins, null without one."""
    keyed = table.withColumn("_norm", normalised(F.col(canonical), hyphens=True))
    first = keyed.groupBy("_norm").agg(F.min_by(F.struct(*(c for c in table.columns)), F.col(priority)).alias("_hit"))
    out = df.withColumn("_norm", normalised(F.col(name), hyphens=True)).join(first, "_norm", "left").drop("_norm")
    return out.select(*df.columns, *(F.col(f"_hit.{c}").alias(c) for c in table.columns))


def alias_rewritten(c: Column, aliases: dict[str, str]) -> Column:
    """Literal replacement of outdated class names inside a text."""
    for old, new in aliases.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def route(category: Column, known: list[str], unknown: str = "unknown") -> Column:
    """``invalid`` for null or foreign names, ``ood`` for the unknown mark, else ``id``."""
    return F.when(category.isNull(), "invalid").when(category == unknown, "ood").when(category.isin(*known), "id").otherwise("invalid")
