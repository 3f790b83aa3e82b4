"""URL filters: rules first, then a character language-model ratio.  DataFrame functions only.

URLs that a rule decides are the labelled ones.  One smoothed Markov model of
characters is fitted to the allowed and one to the blocked; each interpolates orders 2,
1 and 0 by Witten-Bell weights, so the order in effect varies with what a context has
shown.  The log-likelihood difference per character decides the rest, against a
threshold calibrated on the labelled URLs, each scored by models of the other half.

URLs are folded to ``SYMBOLS`` characters, so a model has at most 41^3 = 68,921
entries whatever the input; that table is what the tasks get whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = LOWER + "0/.-?&=_%:#~+"
SIZE = len(SYMBOLS) + 2  # one for other characters (0), one for the beginning
BEGIN = SIZE - 1

#: Rules: verdict, host, path prefix.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        name, verdict = F.when(fits, domain + prefix).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def with_codes(pages: DataFrame) -> DataFrame:
    """Adds ``_grams``: a code for each character of the folded URL and the two before it."""
    at = F.locate("://", F.col("url"))
    text = F.coalesce(F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise(F.col("url")), F.lit(""))
    folded = F.translate(text, UPPER + "123456789", LOWER + "0" * 9)
    letters = F.filter(F.split(folded, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.instr(F.lit(SYMBOLS), c))
    padded = F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), codes)
    size = F.size(codes)  # as many grams as characters
    pairs = F.zip_with(F.slice(padded, 1, size), F.slice(padded, 2, size), lambda a, b: a * SIZE + b)
    return pages.withColumn("_grams", F.zip_with(pairs, codes, lambda ab, c: ab * SIZE + c))


def count_grams(labelled: DataFrame) -> DataFrame:
    """``(label, fold, gram, n)`` over ``labelled(label, fold, _grams)``."""
    return labelled.select("label", "fold", F.explode("_grams").alias("gram")).groupBy("label", "fold", "gram").agg(F.count("*").alias("n"))


def ratio_models(grams: DataFrame) -> DataFrame:
    """``(fit, gram, r)``: log-probability under the allowed minus that under the blocked, for every gram code.

    ``fit`` 0 and 1 learn from the other fold, ``fit`` 2 from both.  A label without URLs
    has the uniform model.  All three come from one plan.
    """
    spark = grams.sparkSession
    each = grams.withColumn("fit", F.explode(F.array(1 - F.col("fold"), F.lit(2))))
    tri = each.groupBy("fit", "label", "gram").agg(F.sum("n").alias("n"))
    a, b, c = (F.floor(F.col("gram") / k).cast("int") % SIZE for k in (SIZE * SIZE, SIZE, 1))
    tri = tri.select("fit", "label", a.alias("a"), b.alias("b"), c.alias("c"), "n")
    pair = tri.groupBy("fit", "label", "b", "c").agg(F.sum("n").alias("n_bc"))
    one = pair.groupBy("fit", "label", "c").agg(F.sum("n_bc").alias("n_c"))
    tallies = [
        (tri, ["a", "b", "c"]),
        (pair, ["b", "c"]),
        (one, ["c"]),
        (tri.groupBy("fit", "label", "a", "b").agg(F.sum("n").alias("n_ab"), F.count("*").alias("t_ab")), ["a", "b"]),
        (pair.groupBy("fit", "label", "b").agg(F.sum("n_bc").alias("n_b"), F.count("*").alias("t_b")), ["b"]),
        (one.groupBy("fit", "label").agg(F.sum("n_c").alias("n_0"), F.count("*").alias("t_0")), []),
    ]
    both = F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("label")
    grid = spark.range(SIZE**3).select(F.col("id").alias("gram"), F.explode(F.array(*map(F.lit, range(3)))).alias("fit"))
    grid = grid.select("gram", "fit", both).select("gram", "fit", "label", a.alias("a"), b.alias("b"), c.alias("c"))
    for table, keys in tallies:
        grid = grid.join(table, ["fit", "label", *keys], "left")
    p = F.lit(1.0 / SIZE)
    for seen, total, kinds in (("n_c", "n_0", "t_0"), ("n_bc", "n_b", "t_b"), ("n", "n_ab", "t_ab")):
        p = F.when(F.col(total).isNull(), p).otherwise((F.coalesce(seen, F.lit(0)) + F.col(kinds) * p) / (F.col(total) + F.col(kinds)))
    sign = F.when(F.col("label") == "allow", 1.0).otherwise(-1.0)
    return stored(grid.groupBy("fit", "gram").agg(F.round(F.sum(sign * F.log(p)), 6).alias("r")), "model")


def mean_ratio(urls: DataFrame, models: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, score)``: mean over ``_grams`` of each URL under the model that its ``fit`` names, however often it occurs."""
    each = urls.select(*keys, "fit", F.explode("_grams").alias("gram")).join(F.broadcast(models), ["fit", "gram"])  # 3 * 41^3 rows
    return each.groupBy(*keys).agg(F.round(F.avg("r"), 6).alias("score"))


def threshold(scored: DataFrame) -> float | None:
    """Where the two labels' score distributions meet: means weighted by the other's spread."""
    s = scored.where("score is not null").groupBy("label").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"))
    found = {r["label"]: (r["m"], r["sd"] + 1e-9) for r in s.collect()}
    if len(found) < 2:
        return None
    (m1, s1), (m0, s0) = found["allow"], found["block"]
    return round((m1 * s0 + m0 * s1) / (s0 + s1), 6)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score``.

    The longest rule that fits decides; else the score does: allow at the threshold or
    above.  Without labelled URLs of both kinds there is no threshold and every other
    URL is allowed.  Null and empty URLs have no score and are blocked: there is nothing
    to fetch.  Repeated rows are judged alike; an empty table gives no rows; columns of
    ``pages`` with those five names are replaced.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = with_codes(base.withColumns({"rule": rule, "_label": verdict}))
    fold = F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")
    labelled = base.where("_label is not null").select("url", F.col("_label").alias("label"), fold.alias("fold"), "_grams")
    models = ratio_models(stored(count_grams(labelled), "grams"))
    crossed = mean_ratio(labelled.withColumn("fit", F.col("fold")), models, "url", "label")
    cut = threshold(labelled.select("url").join(crossed, "url"))  # a URL counts as often as it occurs
    whole = base.where("url is not null").withColumn("fit", F.lit(2))
    scores = mean_ratio(whole, models.where("fit = 2"), "url").withColumnRenamed("url", "_url")
    judged = F.when(F.col("score").isNull(), "block").when(F.col("score") >= F.lit(cut if cut is not None else float("-inf")), "allow").otherwise("block")
    met = base.drop("_grams").join(scores, F.col("url") == F.col("_url"), "left").drop("_url")
    return met.withColumn("verdict", F.coalesce("_label", judged)).drop("_label")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    found = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")
