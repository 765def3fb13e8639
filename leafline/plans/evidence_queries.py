"""Queries of strategies, provider evidence, scores and learned edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.functions.text import hash_bucket
from leafline.operators import content, evidence, learned, metrics, order, strategies
from leafline.operators.pages import dealt
from leafline.plans.layout_queries import Query, _el, _visual
from leafline.sources import layout
from leafline.sources.layout import PAGE_HEIGHT, PAGE_WIDTH, table

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """The elements as a provider's JSON, with the origin at the bottom left and some broken boxes."""
    e = _el(spark, d)
    box = F.when(F.col("idx") % 7 == 5, F.array("x0", "y0")).otherwise(F.array(F.col("x0"), PAGE_HEIGHT - F.col("y1"), F.col("x1"), PAGE_HEIGHT - F.col("y0")))
    kind = F.when(F.col("idx") % 9 == 0, " Heading").when(F.col("idx") % 9 == 8, "TBL").otherwise("paragraph")
    block = F.struct("idx", kind.alias("type"), box.alias("bbox"), F.col("text").alias("content"))
    return e.groupBy("page").agg(F.sort_array(F.collect_list(block)).alias("b")).select("page", F.to_json(F.transform("b", lambda x: x.dropFields("idx"))).alias("payload"))


@query
def semantic_order_auto(spark, d):
    return strategies.semantic_order(_el(spark, d), PAGE_WIDTH)


@query
def column_flow_order(spark, d):
    return strategies.semantic_order(_el(spark, d), PAGE_WIDTH, "column-flow-v1")


@query
def table_islands(spark, d):
    """Every third page set as a grid of four cells to a row."""
    e = _el(spark, d)
    x, y = 36 + (F.col("idx") % 4) * 130, 40 + F.floor(F.col("idx") / 4) * 20
    boxes = {"x0": x, "y0": y + F.col("idx") % 2, "x1": x + 100, "y1": y + 12}
    grid = e.where("page % 3 = 0").select("page", "idx", *[v.cast("double").alias(k) for k, v in boxes.items()])
    return strategies.semantic_order(grid, PAGE_WIDTH, "table-island").where("strategy = 'table-island'")


@query
def bottom_left_blocks(spark, d):
    return evidence.bottom_left_blocks(_payloads(spark, d), PAGE_WIDTH, PAGE_HEIGHT)


@query
def slot_successors(spark, d):
    return evidence.slot_successors(evidence.bottom_left_blocks(_payloads(spark, d), PAGE_WIDTH, PAGE_HEIGHT))


@query
def block_reject_reasons(spark, d):
    return evidence.bottom_left_blocks(_payloads(spark, d), PAGE_WIDTH, PAGE_HEIGHT).groupBy("type", "reason").agg(F.count("*").alias("n"))


@query
def parallel_array_blocks(spark, d):
    e = _el(spark, d)
    corners = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    rows = e.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("idx", "text", corners.alias("poly")))).alias("b")).select(
        "page", F.transform("b", lambda x: x["text"]).alias("rec_texts"), F.transform("b", lambda x: (x["idx"] % 10) / 10).alias("rec_scores"), F.transform("b", lambda x: x["poly"]).alias("rec_polys")
    )
    return evidence.parallel_arrays(rows, "rec_texts", "rec_scores", "rec_polys")


@query
def body_tree_runs(spark, d):
    e = _el(spark, d)
    kind = F.when(F.col("idx") % 9 == 0, "group").when(F.col("idx") % 9 == 8, "table").otherwise("text")
    return evidence.sibling_runs(e.select("page", F.floor(F.col("idx") / 25).alias("parent"), F.col("idx").alias("pos"), kind.alias("type")))


def _streams(spark: SparkSession, d: str) -> DataFrame:
    return _visual(spark, d).withColumn("stream", F.when(F.col("idx") % 9 == 0, "heading").when(F.col("x0") >= 300, "right").otherwise("left"))


@query
def sidecar_edges(spark, d):
    return evidence.stream_edges(_streams(spark, d), "stream", "visual_rank")


@query
def stream_confusion(spark, d):
    s = _streams(spark, d)
    expected = s.select("page", "idx", F.col("stream").alias("expected"))
    actual = order.column_gap_split(layout.provider(_el(spark, d), 1)).select("page", "idx", F.when(F.col("col") == 1, "right").otherwise("left").alias("actual"))
    return metrics.confusion(expected, actual, ["page", "idx"])


@query
def relation_quality(spark, d):
    v = _visual(spark, d)
    truth = order.successor_edges(order.box_flow_order(_el(spark, d)), "flow_rank").where("source % 3 <> 0")
    return evidence.relation_quality(v.select("page", "idx", F.col("visual_rank").alias("place")), truth)


@query
def line_edit_distance(spark, d):
    e = _el(spark, d)
    noisy = order.visual_order(layout.provider(e, 2))
    return evidence.line_edit_distance(e.select("page", F.col("idx").alias("place"), "text"), noisy.select("page", F.col("visual_rank").alias("place"), "text"))


@query
def candidate_summary(spark, d):
    """Disagreement of each candidate order with the expected one, summed over pages; the best candidate is marked."""
    e = _el(spark, d)
    base = order.box_flow_order(e, -0.5).withColumnRenamed("flow_rank", "base")
    out = None
    for name, ranked, rank in (("visual", order.visual_order(e), "visual_rank"), ("flow", order.box_flow_order(e), "flow_rank")):
        one = order.order_disagreement(base, ranked, "base", rank).groupBy(F.lit(name).alias("candidate")).agg(F.sum("pairs").alias("pairs"), F.sum("discordant").alias("discordant"), F.sum("broken").alias("broken"))
        out = one if out is None else out.unionByName(one)
    accuracy = F.round(1 - F.col("discordant") / F.col("pairs"), 8)
    best = F.row_number().over(Window.orderBy(F.desc("accuracy"), "candidate")) == 1
    return out.withColumn("accuracy", accuracy).withColumn("best", best)


@query
def ignored_text_zones(spark, d):
    """Elements that no provider copy has, by zone and role: with totals by zone and over all."""
    e = _el(spark, d)
    lone = content.element_roles(e, PAGE_HEIGHT).join(e, ["page", "idx"]).join(layout.provider(e, 1).select("page", "idx"), ["page", "idx"], "left_anti")
    zoned = lone.withColumn("zone", evidence.zone(F.col("y0"), F.col("y1"), PAGE_HEIGHT))
    out = zoned.rollup("zone", "role").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return out.select(F.coalesce("zone", F.lit("all")).alias("zone"), F.coalesce("role", F.lit("all")).alias("role"), "n", "level")


@query
def style_dictionary(spark, d):
    e = _el(spark, d)
    return evidence.style_ids(e, F.concat_ws("|", F.col("y1") - F.col("y0"), F.col("x0")))


@query
def document_stats(spark, d):
    """Counts of elements by role, as one map per stratum of pages."""
    e = _el(spark, d)
    by = content.element_roles(e, PAGE_HEIGHT).join(content.page_strata(e, PAGE_WIDTH).select("page", "stratum"), "page")
    counts = by.groupBy("stratum", "role").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"))
    return counts


@query
def page_folds(spark, d):
    pages = content.page_strata(_el(spark, d), PAGE_WIDTH).select("page", "stratum")
    return learned.fold_of(pages, "page", "stratum", 5)


@query
def feature_envelope(spark, d):
    return learned.feature_envelope(learned.pair_features(_visual(spark, d), 4), ["dx", "dy", "gap_y", "overlap_x", "rank_gap"])


@query
def successor_examples(spark, d):
    """Labelled candidate pairs with their features."""
    v = _visual(spark, d)
    truth = order.successor_edges(v)
    found = learned.labelled(learned.pair_features(v, 3), truth)
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("gap_y"), 6).alias("gap_y"), F.round(F.avg("overlap_x"), 6).alias("overlap_x"))


@query
def learned_successors(spark, d):
    """Edges of a classifier that is fitted on some pages and frozen on others."""
    v = order.box_flow_order(_el(spark, d)).withColumnRenamed("flow_rank", "visual_rank")
    examples = learned.labelled(learned.pair_features(v, 8), order.successor_edges(_visual(spark, d)))
    # each tree reads its task's examples again, and samples them in their order
    features = learned.document_split(dealt(examples, 64_000_000, spark.sparkContext.defaultParallelism).sortWithinPartitions("page", "source", "target"))
    model = learned.fit_successors(features.where("part = 'fit'"), 5)
    graded = learned.scored(model, features.where("part = 'calibration'"))
    frozen = learned.frozen_threshold(graded).first()
    return learned.top_edges(graded, frozen["threshold"] if frozen else 1.1).select("page", "source", "target", "score", "label")


@query
def frozen_threshold(spark, d):
    scored = table(spark, d, "labels").select(F.round(hash_bucket(F.col("doc_id"), 100) / 100 * 0.6 + F.col("quality") * 0.4, 6).alias("score"), F.col("quality").cast("double").alias("label"))
    found = learned.frozen_threshold(scored, steps=20)
    return found.select(F.round("threshold", 6).alias("threshold"), F.col("selected").cast("bigint").alias("selected"), F.col("hits").cast("bigint").alias("hits"), F.round("precision", 8).alias("precision"), F.round("f1", 8).alias("f1"))


@query
def ab_deltas(spark, d):
    """Two candidate orders side by side on each page, and which of them is better."""
    e = _el(spark, d)
    base = order.box_flow_order(e, -0.5).withColumnRenamed("flow_rank", "base")
    a = order.order_disagreement(base, order.visual_order(e), "base", "visual_rank").select("page", F.col("discordant").alias("a"))
    b = order.order_disagreement(base, order.box_flow_order(e), "base", "flow_rank").select("page", F.col("discordant").alias("b"))
    delta = F.col("a") - F.col("b")
    return a.join(b, "page").select("page", "a", "b", delta.alias("delta"), F.when(delta < 0, "a").when(delta > 0, "b").otherwise("tie").alias("better"))


@query
def weighted_means(spark, d):
    """Means of page rates, plain and weighted by elements, without pages that have no rate."""
    s = content.page_strata(_el(spark, d), PAGE_WIDTH)
    n = F.col("left_lines") + F.col("right_lines") + F.col("wide_lines")
    rate = F.when(F.col("right_lines") > 0, F.col("left_lines") / F.col("right_lines"))
    return s.withColumn("n", n).withColumn("rate", rate).groupBy("stratum").agg(
        F.count("rate").alias("pages"), F.round(F.avg("rate"), 8).alias("mean"), F.round(F.sum(F.col("rate") * F.col("n")) / F.sum(F.when(F.col("rate").isNotNull(), F.col("n"))), 8).alias("weighted"), F.round(F.min("rate"), 8).alias("least")
    )


@query
def text_similarity(spark, d):
    """Each line against its pseudo-translation, and every third one against the line after it."""
    other = content.pseudo_translation(_el(spark, d)).select("page", "idx", F.col("text").alias("b"))
    after = _el(spark, d).select("page", (F.col("idx") - 1).alias("idx"), F.col("text").alias("c"))
    both = _el(spark, d).join(other, ["page", "idx"]).join(after, ["page", "idx"], "left").select("page", "idx", F.col("text").alias("a"), F.when(F.col("idx") % 3 == 0, F.coalesce("c", F.lit(""))).otherwise(F.col("b")).alias("b"))
    return both.select("page", "idx", F.round(evidence.text_similarity(F.col("a"), F.col("b")), 8).alias("similarity"))
