"""Queries of the review operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafline.functions.text import hash_bucket
from leafline.operators import content, covers, order, review
from leafline.plans.layout_queries import QUERIES as LAYOUT
from leafline.plans.layout_queries import Query, _candidate_orders, _el, _visual
from leafline.sources import layout, sinks
from leafline.sources.layout import table

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def page_range_scan(spark, d):
    return review.pages_in(_el(spark, d), "1-3,7,20-40").select("page", "idx")


@query
def css_colours(spark, d):
    code = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("page") * 97 + F.col("idx") * 131) % 16777216)), 6, "0")))
    value = F.coalesce(code, F.when(F.col("idx") % 3 == 1, F.concat(F.lit("rgb("), F.col("page") % 256, F.lit(", "), F.col("idx") % 256, F.lit(",7)"))), F.lit("none"))
    rgb = review.css_rgb(value)
    return _el(spark, d).select("page", "idx", F.coalesce(F.round(review.luminance(rgb), 8), F.lit(-1.0)).alias("luminance"))


@query
def complexity_buckets(spark, d):
    return _el(spark, d).groupBy("page").agg(F.count("*").alias("n")).groupBy(review.complexity(F.col("n")).alias("bucket")).agg(F.count("*").alias("pages"), F.sum("n").alias("elements"))


@query
def transition_bands(spark, d):
    v = _visual(spark, d)
    n = v.groupBy("page").agg(F.count("*").alias("n"))
    band = review.position_band(F.col("visual_rank") - 1, F.col("n"))
    return v.join(n, "page").groupBy(band.alias("band")).agg(F.count("*").alias("transitions"))


@query
def consensus_levels(spark, d):
    return review.agreement(covers.consensus_votes(_candidate_orders(spark, d)), 3)


@query
def support_curve(spark, d):
    orders = _candidate_orders(spark, d)
    channels = None
    for name in ("visual", "flow", "columns"):
        one = order.successor_edges(orders.where(F.col("candidate") == name), "place").withColumn("channel", F.lit(name))
        channels = one if channels is None else channels.unionByName(one)
    truth = LAYOUT["mutual_neighbours"](spark, d)
    return review.support_curve(channels, truth)


@query
def stratified_rule_fit(spark, d):
    docs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    records = docs.select(
        F.col("lang").alias("stratum"), (F.col("doc_id") % 4).alias("support"), F.round(hash_bucket(F.col("doc_id"), 100) / 100, 2).alias("confidence"), F.col("quality").alias("correct")
    )
    return review.fitted_rules(records, [0, 1, 2], [0.0, 0.25, 0.5], 0.5, 0.4, 5).withColumn("support", F.col("support").cast("bigint"))


@query
def overlap_diagnostics(spark, d):
    e = _el(spark, d)
    both = e.unionByName(layout.provider(e, 1).withColumn("idx", F.col("idx") + 100_000).select(e.columns))
    return review.overlaps(both)


@query
def hierarchy_edges(spark, d):
    return review.hierarchy(_visual(spark, d).withColumn("region", F.floor(F.col("idx") / 4)), "region", "visual_rank")


@query
def array_differences(spark, d):
    """Each vector against the next one by number."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(review.array_difference(F.col("embedding"), F.col("other")), 6).alias("difference"))


@query
def provenance_status(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("payload"))
    k = F.col("key") % 10
    manifest = docs.select(
        "key", F.when(k == 1, "v0").otherwise("v1").alias("schema"), F.when(k == 2, "short").when(k == 3, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.sha2(F.col("payload").cast("binary"), 256)).alias("sha256"),
        (k == 4).alias("runtime_reorder"),
    )
    return review.provenance_status(manifest, docs.where(k != 5), "v1")


@query
def edit_revisions(spark, d):
    return review.edit_revisions(LAYOUT["apply_edits"](spark, d))


@query
def text_modes(spark, d):
    e = _el(spark, d)
    edited = F.when(F.col("idx") % 3 == 0, F.reverse("text")).otherwise(F.lit(""))
    translated = F.when(F.col("idx") % 4 == 0, F.concat(F.lit("t:"), F.col("text")))
    return e.select("page", "idx", *[sinks.text_for_mode(m, F.col("text"), edited, translated).alias(m) for m in ("source", "edited", "translated", "bilingual")])


@query
def stale_or_missing_outputs(spark, d):
    """Pages that a resumed run has still to do: those without a finished output of the same content."""
    e = _el(spark, d).groupBy("page").agg(F.count("*").alias("n"))
    done = e.where("page % 3 = 0").select("page", F.when(F.col("page") % 2 == 0, F.col("n")).otherwise(F.col("n") - 1).alias("n"))
    return e.join(done, ["page", "n"], "left_anti")


@query
def degradation_profiles(spark, d):
    """What each noise profile leaves: elements, masked texts, and mean shift."""
    e, out = _el(spark, d), None
    for name, (drop, jitter, mask) in {"clean": (0.0, 0.0, 0.0), "mild": (0.05, 1.0, 0.05), "stress": (0.2, 4.0, 0.15)}.items():
        noisy = content.degraded(e, "p", drop, jitter, mask).select("page", "idx", F.col("text").alias("seen"), F.col("x0").alias("moved"))
        one = e.join(noisy, ["page", "idx"]).agg(F.lit(name).alias("profile"), F.count("*").alias("kept"), F.count_if(F.expr("seen = '' AND text <> ''")).alias("masked"), F.round(F.avg(F.abs(F.col("moved") - F.col("x0"))), 6).alias("shift"))
        out = one if out is None else out.unionByName(one)
    return out
