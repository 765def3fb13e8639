"""Review of evidence: agreement of candidates, rule fitting, overlaps, hierarchy, provenance and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.geometry import Box, coverage, iou
from leafline.functions.text import page_ranges, wilson_lower
from leafline.operators.matching import side
from leafline.operators.metrics import ratio


def pages_in(df: DataFrame, spec: str) -> DataFrame:
    """Rows of the pages of a range such as ``1-3,7``."""
    return df.where(F.col("page").isin(page_ranges(spec)))


def css_rgb(value: Column) -> Column:
    """(r, g, b) of ``#rgb``, ``#rrggbb`` or ``rgb(r, g, b)``; null of anything else."""
    v = F.lower(F.trim(value))
    six = F.when(v.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substring(v, 2, 3), "(.)", "$1$1")).when(v.rlike("^#[0-9a-f]{6}$"), F.substring(v, 2, 6))
    by_hex = [F.conv(F.substring(six, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]
    by_name = [F.regexp_extract(v, r"^rgb\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*\)$", i).try_cast("int") for i in (1, 2, 3)]
    parts = [F.coalesce(h, n) for h, n in zip(by_hex, by_name, strict=True)]
    return F.when(parts[0].isNotNull(), F.struct(*[p.alias(c) for p, c in zip(parts, "rgb", strict=True)]))


def luminance(rgb: Column) -> Column:
    return (0.2126 * rgb["r"] + 0.7152 * rgb["g"] + 0.0722 * rgb["b"]) / 255


def complexity(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")


def position_band(index: Column, count: Column) -> Column:
    """Third of a sequence that a zero-based index lies in; a sequence of one has no thirds."""
    at = index / F.greatest(count - 1, F.lit(1))
    return F.when(count <= 1, "single").when(at < 1 / 3, "start").when(at > 2 / 3, "end").otherwise("middle")


def agreement(votes: DataFrame, candidates: int) -> DataFrame:
    """Per page: share of edges that every candidate has, of those with a majority, of sources with rival targets, and a level."""
    rivals = votes.groupBy("page", "source").agg(F.count("*").alias("targets"), F.max("votes").alias("best"))
    out = rivals.groupBy("page").agg(
        F.count("*").alias("sources"), F.count_if(F.col("best") == candidates).alias("unanimous"),
        F.count_if(2 * F.col("best") > candidates).alias("majority"), F.count_if(F.col("targets") > 1).alias("contested"),
    )
    share, rival = F.round(ratio("majority", "sources"), 8), F.round(ratio("contested", "sources"), 8)
    level = F.when((share >= 0.9) & (rival <= 0.25), "high").when(share >= 0.6, "medium").otherwise("low")
    return out.select("*", share.alias("support"), rival.alias("conflict"), level.alias("level"))


def support_curve(channels: DataFrame, truth: DataFrame) -> DataFrame:
    """Edges (page, source, target, channel) that at least k channels have, scored against ``truth``, for every k."""
    counted = channels.groupBy("page", "source", "target").agg(F.count_distinct("channel").alias("support"))
    marked = counted.join(truth.select("page", "source", "target", F.lit(1).alias("t")).distinct(), ["page", "source", "target"], "left")
    each = marked.select(F.explode(F.sequence(F.lit(1), F.col("support").cast("int"))).alias("k"), "t")
    total = truth.select("page", "source", "target").distinct().agg(F.count("*").alias("truth"))
    out = each.groupBy("k").agg(F.count("*").alias("found"), F.count("t").alias("hits")).join(F.broadcast(total))
    return out.select(
        F.col("k").cast("bigint").alias("k"), "found", "hits", "truth", F.round(ratio("hits", "found"), 8).alias("precision"), F.round(ratio("hits", "truth"), 8).alias("recall")
    )


def fitted_rules(records: DataFrame, supports: list[int], confidences: list[float], least_precision: float, least_lower: float, least_count: int) -> DataFrame:
    """For each stratum the grid point (support, confidence) that meets all floors and keeps most, then is surest.

    Records have stratum, support, confidence and correct (0 or 1).
    """
    points = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s in supports for c in confidences])
    met = F.filter(points, lambda p: (F.col("support") >= p["s"]) & (F.col("confidence") >= p["c"]))
    counts = records.select("stratum", "correct", F.explode(met).alias("p")).groupBy("stratum", F.col("p.s").alias("support"), F.col("p.c").alias("confidence")).agg(
        F.count("*").alias("predicted"), F.sum(F.col("correct").cast("bigint")).alias("hits")
    )
    graded = counts.withColumn("precision", F.round(ratio("hits", "predicted"), 8)).withColumn("lower", F.round(wilson_lower(F.col("hits"), F.col("predicted")), 8))
    kept = graded.where((F.col("precision") >= least_precision) & (F.col("lower") >= least_lower) & (F.col("predicted") >= least_count))
    best = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("predicted"), F.desc("lower"), F.desc("precision"), F.desc("support"), F.desc("confidence")))
    return kept.withColumn("n", best).where("n = 1").drop("n")


def overlaps(anchors: DataFrame, overlap: float = 0.1, copy: float = 0.9, nested: float = 0.9, share: float = 0.25) -> DataFrame:
    """Per page: pairs that overlap, pairs that are copies, and small boxes inside much larger ones."""
    a, b = Box.of("a_"), Box.of("b_")
    joined = side(anchors, "a_", "idx").join(side(anchors, "b_", "idx"), "page").where("a_idx < b_idx").withColumn("iou", F.round(iou(a, b), 8))
    inside = (F.greatest(coverage(a, b), coverage(b, a)) >= nested) & (F.least(a.area, b.area) <= share * F.greatest(a.area, b.area))
    return joined.groupBy("page").agg(
        F.count_if(F.col("iou") >= overlap).alias("overlapping"), F.count_if(F.col("iou") >= copy).alias("copies"), F.count_if(inside).alias("nested")
    )


def hierarchy(ordered: DataFrame, region: str, rank: str) -> DataFrame:
    """Regions in the order of their last member, members in their own; edges within regions, and from last to first across."""
    members = ordered.select("page", "idx", F.col(region).alias("region"), F.col(rank).alias("r"))
    whole = Window.partitionBy("page", "region")
    w = Window.partitionBy("page").orderBy("last", "region", "r")
    placed = members.withColumn("last", F.max("r").over(whole)).withColumn("place", F.row_number().over(w).cast("bigint"))
    nxt = placed.withColumn("target", F.lead("idx").over(w)).withColumn("to", F.lead("region").over(w))
    kind = F.when(F.col("to") == F.col("region"), "within").otherwise("across")
    return nxt.where("target IS NOT NULL").select("page", F.col("idx").alias("source"), "target", kind.alias("kind"))


def array_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays; what only one of them has counts in full."""
    n = F.greatest(F.size(a), F.size(b))
    gaps = F.zip_with(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), F.lit(1.0)).otherwise(F.abs(x - y).cast("double")))
    return F.when(n > 0, F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)


def provenance_status(manifest: DataFrame, payloads: DataFrame, schema: str) -> DataFrame:
    """Entries (key, schema, sha256, runtime_reorder) against payloads (key, payload): valid, or the first thing that is wrong."""
    joined = manifest.join(payloads.select("key", F.sha2(F.col("payload").cast("binary"), 256).alias("actual")), "key", "left")
    status = (
        F.when(F.col("schema") != schema, "schema").when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "digest format").when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") != F.col("sha256"), "digest").when(F.col("runtime_reorder"), "reorder").otherwise("valid")
    )
    return joined.select("key", status.alias("status"))


def edit_revisions(edited: DataFrame) -> DataFrame:
    """One revision for each page with applied edits: counts by status."""
    return edited.groupBy("page").agg(
        F.count_if(F.col("status") == "applied").alias("applied"), F.count_if(F.col("status") == "stale").alias("stale"), F.count("*").alias("elements")
    ).where("applied > 0")
