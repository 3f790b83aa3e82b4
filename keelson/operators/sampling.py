"""Few-shot samples, quotas and splits.

Random choice is an order by ``md5(seed:id)``: the same rows on any cluster and in any
SQL engine, and a smaller sample is always part of a larger one.  Ranks are cut by
``row_number() <= k``, which Spark pushes below the shuffle, so at most k rows of a
class leave a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def shuffle_key(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def with_rank(df: DataFrame, by: str | Sequence[str], id_col: str, seed: int = SEED, name: str = "rn") -> DataFrame:
    """Adds the rank of each row within its class in random order, from 1."""
    keys = [by] if isinstance(by, str) else list(by)
    order = Window.partitionBy(*keys).orderBy(shuffle_key(id_col, seed), id_col)
    return df.withColumn(name, F.row_number().over(order))


def with_spread_rank(df: DataFrame, by: str, id_col: str, seed: int = SEED, name: str = "rn") -> DataFrame:
    """:func:`with_rank` for ranks without a small bound: rows are dealt out by class and hash bucket, so a class may hold most of them."""
    marked = df.withColumn("_bucket", hash_bucket(id_col, seed))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))  # 4,096 rows a class at most
    starts = starts.select(F.col(by).alias("_by"), F.col("_bucket").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(shuffle_key(id_col, seed), id_col))
    met = marked.withColumn("_own", own).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_in")))
    return met.withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_by", "_in", "_before")


def k_shot(df: DataFrame, by: str, id_col: str, k: int, seed: int = SEED, name: str = "rn") -> DataFrame:
    """``min(k, n)`` rows of each class."""
    return with_rank(df, by, id_col, seed, name).where(F.col(name) <= k)


def ood_target(n_id: Column, ratio: Column, least: Column) -> Column:
    """Number of unknown rows so that they make up ``ratio``, at least ``least``."""
    return F.greatest(F.floor(n_id * ratio / F.greatest(F.lit(1e-6), 1 - ratio)).cast("long"), least.cast("long"))


def capped_ood_target(n_id: Column, ratio: Column, least: Column, available: Column) -> Column:
    return F.least(ood_target(n_id, ratio, least), available.cast("long"))


def sample_total(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` random rows (all, if there are fewer)."""
    return df.orderBy(shuffle_key(id_col, seed), id_col).limit(n)


def class_counts(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def balanced_sample(df: DataFrame, by: str, id_col: str, target: int, coverage: float, classes: int | None = None, seed: int = SEED) -> DataFrame:
    """Two rounds: one row of each covered class, then shares of the rest by class size; cut at ``target``.

    ``min(int(classes * coverage), available)`` classes in random order give one row.
    With ``rem = target - covered`` each class then gives up to
    ``max(1, int(rem * n_c / N))`` more rows.  Adds ``round`` and ``pos``.
    """
    counts = class_counts(df, by)
    spread = Window.partitionBy()  # over classes, not rows
    counts = counts.withColumns(
        {
            "pick": F.row_number().over(Window.orderBy(shuffle_key(by, seed), by)),
            "total": F.sum("n").over(spread),
            "available": F.count("*").over(spread),
        }
    )
    covered = F.least(F.floor((F.lit(classes) if classes is not None else F.col("available")) * F.lit(coverage)), F.col("available"))
    counts = counts.withColumn("covered", covered)
    extra = F.greatest(F.lit(1), F.floor((F.lit(target) - F.col("covered")) * F.col("n") / F.col("total")))
    counts = counts.withColumns(
        {"first": (F.col("pick") <= F.col("covered")).cast("int"), "extra": F.when(F.lit(target) > F.col("covered"), extra).otherwise(0)}
    )
    ranked = with_spread_rank(df, by, id_col, seed).join(counts.select(by, "first", "extra"), by)
    chosen = ranked.where(F.col("rn") <= F.col("first") + F.col("extra"))
    chosen = chosen.withColumn("round", F.when(F.col("rn") <= F.col("first"), 1).otherwise(2))
    order = Window.orderBy("round", by, "rn")  # a sample: target and a row or so of each class
    return chosen.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= target).drop("first", "extra")


def equal_quota_sample(df: DataFrame, by: str, id_col: str, target: int, classes: int, seed: int = SEED) -> DataFrame:
    """``max(1, target // classes)`` rows of each class."""
    return k_shot(df, by, id_col, max(1, target // classes), seed)


def running_budget(counts: DataFrame, by: str, per_class: int, cap: int | DataFrame) -> DataFrame:
    """``(by, n, raw, take)``: ``min(n, per_class)`` of each class in name order while the total stays under ``cap``, a number or a table of one."""
    counts = counts.withColumn("raw", F.least(F.col("n"), F.lit(per_class)))
    out = with_running(counts, [by], sampled_ranges(counts, by), cum=F.col("raw"))
    out = out.withColumn("_cap", F.lit(cap)) if isinstance(cap, int) else out.join(F.broadcast(cap.toDF("_cap")))  # one row
    return out.withColumn("take", F.least("cum", "_cap") - F.least(F.col("cum") - F.col("raw"), F.col("_cap"))).drop("cum", "_cap")


def budgeted_sample(df: DataFrame, by: str, id_col: str, per_class: int, cap: int | DataFrame, seed: int = SEED) -> DataFrame:
    """Rows that :func:`running_budget` grants each class."""
    grant = running_budget(class_counts(df, by), by, per_class, cap).select(by, "take")
    return with_rank(df, by, id_col, seed).where(F.col("rn") <= per_class).join(grant, by).where(F.col("rn") <= F.col("take")).drop("take")


def split_per_class(df: DataFrame, by: str, id_col: str, ratio: float, seed: int = SEED) -> DataFrame:
    """Adds ``split``: ``ceil(n * ratio)`` rows of each class are ``val``; classes of one row stay in ``train``."""
    n_val = F.when(F.col("n") < 2, 0).otherwise(F.ceil(F.col("n") * ratio))
    ranked = with_spread_rank(df, by, id_col, seed).join(class_counts(df, by), by)
    return ranked.withColumn("split", F.when(F.col("rn") <= n_val, "val").otherwise("train")).drop("rn", "n")


def quotas(counts: DataFrame, by: str, total: Column) -> DataFrame:
    """Adds ``quota``: shares of ``total`` by ``n``, rounded by largest remainder (ties by class name)."""
    everything = F.sum("n").over(Window.partitionBy())
    exact = F.col("n") * total / everything
    out = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    missing = total - F.sum("_floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.round(F.col("_exact") - F.col("_floor"), 9).desc(), by))
    out = out.withColumns({"_missing": missing, "_place": place})
    quota = F.col("_floor") + F.when(F.col("_place") <= F.col("_missing"), 1).otherwise(0)
    return out.withColumn("quota", quota.cast("long")).drop("_exact", "_floor", "_missing", "_place")


def stratified_split(df: DataFrame, by: str, id_col: str, test_share: float, seed: int = SEED) -> DataFrame:
    """Adds ``split`` with ``ceil(test_share * n)`` rows in ``test``, by class in proportion.

    Classes of one row are in ``train`` and don't count.
    """
    counts = class_counts(df, by)
    many = counts.where("n >= 2")
    wanted = F.ceil(F.sum("n").over(Window.partitionBy()) * test_share)
    quota = quotas(many.withColumn("_want", wanted), by, F.col("_want")).select(by, "quota")
    ranked = with_spread_rank(df, by, id_col, seed).join(quota, by, "left")
    return ranked.withColumn("split", F.when(F.col("rn") <= F.coalesce("quota", F.lit(0)), "test").otherwise("train")).drop("rn", "quota")


def stratified_subsample(df: DataFrame, by: str, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """About ``n`` rows: all classes of one row, and of the others ``n`` less those, in proportion."""
    counts = class_counts(df, by).withColumn("_single", F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).over(Window.partitionBy()))
    many = counts.where("n >= 2").withColumn("_want", F.greatest(F.lit(0), F.least(F.lit(n) - F.col("_single"), F.sum("n").over(Window.partitionBy()))))
    quota = quotas(many, by, F.col("_want")).select(by, "quota").unionByName(counts.where("n = 1").select(by, F.lit(1).cast("long").alias("quota")))
    return with_spread_rank(df, by, id_col, seed).join(quota, by).where(F.col("rn") <= F.col("quota")).drop("rn", "quota")


def support_or_query(shot: DataFrame, shots: int, known: Column, rank: str = "rn") -> DataFrame:
    """Adds ``role``: the first half of a known class is ``support``, all else ``query``."""
    return shot.withColumn("role", F.when(known & (F.col(rank) <= shots // 2), "support").otherwise("query"))


def shuffled(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """Rows in random order (a range sort, not one task); use :func:`with_position` where the position itself is wanted."""
    return df.orderBy(shuffle_key(id_col, seed), id_col)


BUCKETS = 512


def hash_bucket(id_col: str, seed: int = SEED) -> Column:
    """Bucket that rises with :func:`shuffle_key`: its first three digits."""
    return F.coalesce(F.substring(shuffle_key(id_col, seed), 1, 3), F.lit(""))


@dataclass
class Ranges:
    """Buckets of a numeric column between its approximate quantiles, found in the same job that uses them."""

    column: str
    edges: DataFrame  # one row: BUCKETS - 1 quantiles (null for an empty table)

    def mark(self, df: DataFrame, name: str = "_bucket") -> DataFrame:
        """Adds the bucket of each row; it rises with the column, null first.

        Values equal to an edge have a bucket of their own, so that a very frequent value
        doesn't take others along.  Edges are searched by halves.
        """
        value, steps = F.col(self.column), F.array(*(F.lit(BUCKETS >> k) for k in range(1, BUCKETS.bit_length())))
        search = lambda at, step: F.when(F.get("_edges", at + step - 1) <= value, at + step).otherwise(at)
        past = lambda at: at * 2 + F.coalesce(F.get("_edges", F.greatest(at - 1, F.lit(0))) < value, F.lit(False)).cast("int")
        found = F.when(value.isNull(), -1).otherwise(F.aggregate(steps, F.lit(0), search, past))
        return df.join(F.broadcast(self.edges)).select(*df.columns, found.alias(name))  # one row


def range_bucket(df: DataFrame, column: str) -> Ranges:
    """Buckets that rise with a numeric column and hold about as many rows each, whatever its distribution."""
    at = F.array(*(F.lit(k / BUCKETS) for k in range(1, BUCKETS)))
    return Ranges(column, df.agg(F.percentile_approx(column, at, F.lit(10 * BUCKETS)).alias("_edges")))


SAMPLE = 4096


def sampled_ranges(df: DataFrame, column: str) -> Ranges:
    """As :func:`range_bucket`, for a column of any type that can be ordered, such as strings.

    The edges are those of the ``SAMPLE`` distinct values with the least hashes: a
    uniform sample of the values, the same on every run, whose size is fixed.
    """
    value = F.col(column)
    some = df.where(value.isNotNull()).select(column).distinct().orderBy(F.xxhash64(column), column).limit(SAMPLE)
    values = F.sort_array(F.collect_list(column))
    at = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS - 1)), lambda k: F.get("_values", F.floor(k * F.size("_values") / BUCKETS).cast("int")))
    return Ranges(column, some.agg(values.alias("_values")).select(F.when(F.size("_values") > 0, at).alias("_edges")))


def with_running(df: DataFrame, order: Sequence[Column | str], bucket: Column | Ranges, **sums: Column) -> DataFrame:
    """Adds running sums, each row's own value included, in that order without bringing all rows to one task.

    ``bucket`` has to rise with the order (:func:`hash_bucket`, :func:`range_bucket`,
    :func:`sampled_ranges`).  Each bucket sums its own rows, and the sums of the buckets
    before it, a row each, are added.  Buckets come from values, not from a sort's
    ranges, which can differ between the two readings of the same rows.  Nulls add
    nothing; before the first value a sum is 0.
    """
    marked = bucket.mark(df) if isinstance(bucket, Ranges) else df.withColumn("_bucket", bucket)
    marked = marked.withColumns({f"_add_{n}": c for n, c in sums.items()})
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("_bucket").agg(*(F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in sums))
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = totals.select("_bucket", *(zero(F.sum(f"_sum_{n}").over(upto)).alias(f"_before_{n}") for n in sums))  # a row a bucket
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumns({f"_own_{n}": zero(F.sum(f"_add_{n}").over(inside)) for n in sums}).join(starts, "_bucket")
    made = [(F.col(f"_before_{n}") + F.col(f"_own_{n}")).alias(n) for n in sums]
    return own.select(*(c for c in df.columns if c not in sums), *made)


def with_position(df: DataFrame, order: Sequence[Column | str], bucket: Column | Ranges, name: str = "pos") -> DataFrame:
    """Adds a running number from 0 in that order; see :func:`with_running`."""
    return with_running(df, order, bucket, **{name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def batches(df: DataFrame, pos: str, size: int = 10) -> DataFrame:
    """Adds ``batch``: consecutive positions in groups of ``size``."""
    return df.withColumn("batch", F.floor(F.col(pos) / size).cast("long"))
