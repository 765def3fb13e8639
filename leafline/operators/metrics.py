"""Metrics, calibration and sampling: grouped counts first, ratios of sums last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import hash_bucket, wilson_lower


def ratio(a: Column | str, b: Column | str, empty: float | None = 0.0) -> Column:
    """A ratio of counts; what an empty denominator gives differs between metrics."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def prf(found: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Precision, recall and F1 of rows of ``found`` against ``truth``, equal in ``keys``, for each group ``by``."""
    f, t = found.select(*by, *keys).distinct().withColumn("f", F.lit(1)), truth.select(*by, *keys).distinct().withColumn("t", F.lit(1))
    both = f.join(t, [*by, *keys], "full").groupBy(*by).agg(
        F.count_if(F.expr("f = 1 AND t = 1")).alias("hits"), F.count("f").alias("found"), F.count("t").alias("truth")
    )
    p, r = ratio("hits", "found"), ratio("hits", "truth")
    return both.select(*by, "hits", "found", "truth", F.round(p, 8).alias("precision"), F.round(r, 8).alias("recall"), F.round(ratio(2 * F.col("hits"), F.col("found") + F.col("truth")), 8).alias("f1"))


def edge_prf_partial(found: DataFrame, truth: DataFrame) -> DataFrame:
    """As ``prf`` on edges, but only found edges whose source and target are labelled count."""
    nodes = truth.select("page", F.explode(F.array("source", "target")).alias("n")).distinct()
    scorable = found.join(nodes.withColumnRenamed("n", "source"), ["page", "source"], "left_semi").join(nodes.withColumnRenamed("n", "target"), ["page", "target"], "left_semi")
    return prf(scorable, truth, ["source", "target"], ["page"])


def comembership_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of elements (page, group, idx) of one group, least first."""
    a, b = groups.select("page", "group", F.col("idx").alias("source")), groups.select("page", "group", F.col("idx").alias("target"))
    return a.join(b, ["page", "group"]).where("source < target").select("page", "source", "target")


def sequence_quality(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected texts (page, place, text) against actual ones: the k-th occurrence matches the k-th; missing, extra, and concordant pairs."""
    nth = lambda df, at: df.withColumn("k", F.row_number().over(Window.partitionBy("page", "text").orderBy("place"))).select("page", "text", "k", F.col("place").alias(at))
    both = nth(expected, "e").join(nth(actual, "a"), ["page", "text", "k"], "full")
    counts = both.groupBy("page").agg(
        F.count_if(F.expr("e IS NOT NULL AND a IS NOT NULL")).alias("matched"), F.count_if(F.expr("a IS NULL")).alias("missing"), F.count_if(F.expr("e IS NULL")).alias("extra")
    )
    hit = both.where("e IS NOT NULL AND a IS NOT NULL").select("page", "e", "a")
    pair = hit.join(hit.select("page", F.col("e").alias("e2"), F.col("a").alias("a2")), "page").where("e < e2").groupBy("page").agg(
        F.count("*").alias("pairs"), F.count_if(F.expr("a < a2")).alias("concordant")
    )
    return counts.join(pair, "page", "left").select(
        "page", "matched", "missing", "extra", F.coalesce("pairs", F.lit(0).cast("bigint")).alias("pairs"),
        F.coalesce("concordant", F.lit(0).cast("bigint")).alias("concordant"), F.round(ratio(F.coalesce("concordant", F.lit(0)), F.coalesce("pairs", F.lit(0)), 1.0), 8).alias("pair_accuracy"),
    )


def kendall_by_slice(disagreement: DataFrame, sizes: DataFrame) -> DataFrame:
    """Kendall's tau over all pages, and over those of at least 2 and 10 elements: sums of counts first."""
    joined = disagreement.join(sizes, "page").withColumn("slice", F.explode(F.expr("filter(array('all', if(n >= 2, 'two', null), if(n >= 10, 'ten', null)), x -> x IS NOT NULL)")))
    out = joined.groupBy("slice").agg(F.count("*").alias("pages"), F.sum("pairs").alias("pairs"), F.sum("discordant").alias("discordant"))
    return out.withColumn("tau", F.round(1 - 2 * F.col("discordant") / F.col("pairs"), 8))


def confusion(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of (expected, actual) labels; what one side lacks is "none"."""
    both = expected.join(actual, keys, "full")
    return both.groupBy(F.coalesce("expected", F.lit("none")).alias("expected"), F.coalesce("actual", F.lit("none")).alias("actual")).agg(F.count("*").alias("n"))


def fragments(matches: DataFrame) -> DataFrame:
    """Units that are split over several anchors, and anchors that merge several units, per page."""
    split = matches.groupBy("page", "idx").agg(F.count_distinct("anchor").alias("n")).groupBy("page").agg(F.count_if(F.expr("n > 1")).alias("split_units"))
    merged = matches.groupBy("page", "anchor").agg(F.count_distinct("idx").alias("n")).groupBy("page").agg(F.count_if(F.expr("n > 1")).alias("merging_anchors"), F.max("n").alias("most_merged"))
    return split.join(merged, "page")


def error_summary(errors: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median, 90th percentile and maximum; percentiles are interpolated."""
    v = F.col(value)
    return errors.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 8).alias("mean"), F.round(F.median(v), 8).alias("median"), F.round(F.percentile(v, 0.9), 8).alias("p90"), F.round(F.max(v), 8).alias("max")
    )


def token_f1(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap of two bags of tokens (keys, token): F1 over occurrences."""
    count = lambda df, n: df.groupBy(*keys, "token").agg(F.count("*").alias(n))
    both = count(a, "x").join(count(b, "y"), [*keys, "token"], "full").groupBy(*keys).agg(
        F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("common"), F.sum(F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("total")
    )
    return both.withColumn("f1", F.round(ratio(2 * F.col("common"), F.col("total")), 8))


def wilson_gate(counts: DataFrame, least: float = 0.5, support: int = 10) -> DataFrame:
    """Precision with Wilson's lower bound; a group passes with enough support and a bound of ``least``."""
    low = F.round(wilson_lower(F.col("hits"), F.col("total")), 8)
    return counts.select("*", F.round(ratio("hits", "total"), 8).alias("precision"), low.alias("lower"), ((low >= least) & (F.col("total") >= support)).alias("passes"))


def threshold_scan(scored: DataFrame, steps: int = 20) -> DataFrame:
    """F1 of ``score >= threshold`` against ``label`` (0 or 1) on a grid: each score is put into its cell, and cells are summed from above."""
    cell = F.least(F.floor(F.col("score") * steps), F.lit(steps)).cast("int")
    counts = scored.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("p"))
    grid = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("cell"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(counts, "cell", "left").na.fill(0, ["n", "p"])
    everything = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scan = full.select("cell", F.sum("n").over(above).alias("selected"), F.sum("p").over(above).alias("hits"), F.sum("p").over(everything).alias("positives"))
    return scan.select((F.col("cell") / steps).alias("threshold"), "selected", "hits", F.round(ratio(2 * F.col("hits"), F.col("selected") + F.col("positives")), 8).alias("f1"))


def hash_partition(df: DataFrame, key: str, shares: dict[str, int]) -> DataFrame:
    """Rows with a partition name by a hash of ``key``; shares are out of 100."""
    bucket, name, low = hash_bucket(F.col(key), 100), F.lit(None).cast("string"), 0
    for part, share in shares.items():
        name = F.when((bucket >= low) & (bucket < low + share), part).otherwise(name)
        low += share
    return df.withColumn("partition", name)


def stratified_sample(df: DataFrame, key: str, stratum: str, size: int) -> DataFrame:
    """Round-robin over strata, each in the order of a hash of its keys, until ``size`` rows.

    Only the ``size`` first rows of a stratum can be taken, so they alone are compared.
    """
    h = F.sha2(F.col(key).cast("string"), 256)
    ranked = df.withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))).where(F.col("round") <= size)
    return ranked.orderBy("round", stratum).limit(size).withColumn("round", F.col("round").cast("bigint"))


def risk_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of rates between 0 and 1, and its band: high from 0.35, medium from 0.15."""
    score = F.lit(0.0)
    for column, weight in weights.items():
        score = score + weight * F.least(F.greatest(F.coalesce(column, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    score = F.round(score, 8)
    return df.withColumn("risk", score).withColumn("band", F.when(score >= 0.35, "high").when(score >= 0.15, "medium").otherwise("low"))


def cross_validated_rules(df: DataFrame, key: str, rules: dict[str, Column], label: str, folds: int = 5) -> DataFrame:
    """Precision of each rule on each fold, and on all others; folds by a hash of ``key``."""
    fold = hash_bucket(F.col(key), folds)
    hits = F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()])
    fired = df.select(fold.alias("fold"), F.col(label).cast("bigint").alias("y"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule"))
    by_fold = fired.groupBy("rule", "fold").agg(F.count("*").alias("total"), F.sum("y").alias("hits"))
    every = Window.partitionBy("rule")
    rest = lambda c: F.sum(c).over(every) - F.col(c)
    return by_fold.select(
        "rule", "fold", "hits", "total", F.round(ratio("hits", "total"), 8).alias("precision"), F.round(ratio(rest("hits"), rest("total")), 8).alias("fit_precision")
    )
