"""Prototypes, distances and similarities over vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored

MAX_PROTOTYPES = 10_000


def doubles(v: str | Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def squared(a: Column, b: Column) -> Column:
    """Squared distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a, b))


def or_zero(v: Column, dims: int) -> Column:
    """A zero vector for a missing one."""
    return F.coalesce(v, F.array_repeat(F.lit(0.0), dims))


def centroids(df: DataFrame, by: str, vector: str, dims: int) -> DataFrame:
    """``(by, n, proto)``: mean vector of each class, in one aggregation without exploding."""
    means = [F.avg(F.get(vector, i).cast("double")) for i in range(dims)]
    return df.groupBy(by).agg(F.count("*").alias("n"), F.array(*means).alias("proto"))


def prototypes(df: DataFrame, by: str, vector: str, dims: int) -> DataFrame:
    """Centroids at length 1."""
    return centroids(df, by, vector, dims).withColumn("proto", unit(F.col("proto")))


def _listed(protos: DataFrame, by: str) -> DataFrame:
    """All prototypes in one row; there are as many as classes, and their number is checked."""
    one = protos.agg(F.sort_array(F.collect_list(F.struct(F.col(by).alias("label"), F.col("proto").alias("proto")))).alias("_protos"))
    return one.withColumn("_protos", F.when(F.size("_protos") <= MAX_PROTOTYPES, F.col("_protos")).otherwise(F.raise_error(F.lit("too many prototypes"))))


def nearest_prototype(df: DataFrame, vector: str, protos: DataFrame, by: str) -> DataFrame:
    """Adds ``nearest`` and ``distance`` (Euclidean; the first class wins ties).

    Without prototypes: ``unknown`` at 1.0.  Each row meets one array of prototypes, so
    rows neither multiply nor move.
    """
    met = df.crossJoin(F.broadcast(_listed(protos, by)))  # one row
    scored = F.transform("_protos", lambda p: F.struct(euclidean(doubles(vector), p["proto"]).alias("d"), p["label"].cast("string").alias("label")))
    ranked = met.withColumn("_best", F.array_min(scored)).drop("_protos")
    return ranked.withColumns({"nearest": F.coalesce("_best.label", F.lit("unknown")), "distance": F.coalesce("_best.d", F.lit(1.0))}).drop("_best")


def most_similar(df: DataFrame, vector: str, protos: DataFrame, by: str) -> DataFrame:
    """Adds ``closest`` and ``similarity`` (cosine for unit vectors; the first class wins ties)."""
    met = df.crossJoin(F.broadcast(_listed(protos, by)))  # one row
    scored = F.transform("_protos", lambda p: F.struct((-dot(doubles(vector), p["proto"])).alias("d"), p["label"].cast("string").alias("label")))
    ranked = met.withColumn("_best", F.array_min(scored)).drop("_protos")
    return ranked.withColumns({"closest": F.col("_best.label"), "similarity": -F.col("_best.d")}).drop("_best")


def own_similarity(df: DataFrame, by: str, vector: str, protos: DataFrame) -> DataFrame:
    """``(by, n, own_similarity)``: mean cosine of a class to its own prototype."""
    met = df.join(protos.select(by, "proto"), by)
    return met.groupBy(by).agg(F.count("*").alias("n"), F.avg(dot(doubles(vector), F.col("proto"))).alias("own_similarity"))


def inlier_prototypes(df: DataFrame, by: str, vector: str, dims: int, centres: DataFrame | None = None) -> DataFrame:
    """``(by, n, inliers, proto)``: drop rows at mean + 2 sd of the distances to the centre or beyond, then average again.

    ``centres`` (default: the means) come as ``(by, proto)``.  A class without inliers
    (one row: no deviation) keeps its centre.
    """
    centres = centroids(df, by, vector, dims) if centres is None else centres
    held = df.select(by, vector).join(centres.select(by, "proto"), by).withColumn("_d", F.round(euclidean(doubles(vector), F.col("proto")), 9))
    limits = held.groupBy(by).agg((F.avg("_d") + 2 * F.stddev_samp("_d")).alias("_limit"), F.count("*").alias("n"))
    near = held.join(limits, by).where(F.col("_d") < F.col("_limit"))
    again = near.groupBy(by).agg(F.count("*").alias("inliers"), F.array(*(F.avg(F.get(vector, i).cast("double")) for i in range(dims))).alias("_mean"))
    out = centres.select(by, "proto").join(limits, by).join(again, by, "left")
    return out.select(by, "n", F.coalesce("inliers", F.lit(0)).alias("inliers"), unit(F.coalesce("_mean", "proto")).alias("proto"))


ROUNDS = 25


def _near(a: Column, b: Column) -> Column:
    """All elements agree to 1e-5 of ``b``, or 1e-8."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)), lambda ok: ok)


def cluster_centres(df: DataFrame, by: str, vector: str, id_col: str, dims: int) -> DataFrame:
    """``(by, proto)``: of four rows or more the centre of the larger of two clusters (the first on a tie), else the mean.

    Lloyd's method for all classes at once: the first centre is the row of the least id,
    the second the row farthest from it, and every round is one aggregation by class and
    cluster, so a class may hold most rows.  A class whose centres no longer move keeps
    them; rounds end when none does, or after ``ROUNDS``.
    """
    rows = df.select(F.col(by).alias("_by"), doubles(vector).alias("_x"), F.col(id_col).alias("_id"))
    means = centroids(rows, "_by", "_x", dims)
    first = rows.groupBy("_by").agg(F.count("*").alias("_n"), F.min_by("_x", "_id").alias("_c0")).where("_n >= 4")
    met = rows.join(first.drop("_n"), "_by")
    second = F.min_by("_x", F.struct(-squared(F.col("_x"), F.col("_c0")), F.col("_id")))
    centres = stored(met.groupBy("_by").agg(F.first("_c0").alias("_c0"), second.alias("_c1")).withColumn("_moved", F.lit(True)), "centres")
    cluster = F.when(squared(F.col("_x"), F.col("_c1")) < squared(F.col("_x"), F.col("_c0")), 1).otherwise(0)
    sums = [F.avg(F.get("_x", i)) for i in range(dims)]
    for _ in range(ROUNDS):
        means_now = rows.join(centres, "_by").groupBy("_by", cluster.alias("_k")).agg(F.array(*sums).alias("_m"))
        pair = means_now.groupBy("_by").agg(*(F.max(F.when(F.col("_k") == k, F.col("_m"))).alias(f"_m{k}") for k in (0, 1)))
        both = centres.join(pair, "_by").withColumns({f"_m{k}": F.coalesce(f"_m{k}", f"_c{k}") for k in (0, 1)})
        moved = ~(_near(F.col("_m0"), F.col("_c0")) & _near(F.col("_m1"), F.col("_c1")))
        centres = stored(both.select("_by", *(F.when(moved, F.col(f"_m{k}")).otherwise(F.col(f"_c{k}")).alias(f"_c{k}") for k in (0, 1)), moved.alias("_moved")), "centres")
        if not centres.where("_moved").take(1):
            break
    sizes = rows.join(centres, "_by").groupBy("_by").agg(F.count_if(cluster == 1).alias("_n1"), F.count_if(cluster == 0).alias("_n0"), F.first("_c0").alias("_c0"), F.first("_c1").alias("_c1"))
    largest = sizes.select(F.col("_by").alias("_of"), F.when(F.col("_n1") > F.col("_n0"), F.col("_c1")).otherwise(F.col("_c0")).alias("_largest"))
    return means.join(largest, F.col("_by").eqNullSafe(F.col("_of")), "left").select(F.col("_by").alias(by), F.coalesce("_largest", "proto").alias("proto"))


def robust_prototypes(df: DataFrame, by: str, vector: str, id_col: str, dims: int) -> DataFrame:
    """Cluster centres with outliers dropped, at length 1."""
    return inlier_prototypes(df, by, vector, dims, cluster_centres(df, by, vector, id_col, dims))


def similarity_flags(df: DataFrame, by: str, similarity: str) -> DataFrame:
    """Counts of very similar (over 0.90) and very far (under 0.30) rows by class."""
    s = F.col(similarity)
    return df.groupBy(by).agg(F.count_if(s > 0.90).alias("very_similar"), F.count_if(s < 0.30).alias("very_far"))


def plane(df: DataFrame, vector: str, x: str = "x", y: str = "y") -> DataFrame:
    """Adds two coordinates for drawing: the first two principal components.

    :mod:`.neighbours` has a map that keeps neighbours together.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    given = df.withColumn("_v", array_to_vector(doubles(vector)))
    got = PCA(k=2, inputCol="_v", outputCol="_p").fit(given).transform(given).withColumn("_p", vector_to_array("_p"))
    return got.withColumns({x: F.get("_p", 0), y: F.get("_p", 1)}).drop("_v", "_p")
