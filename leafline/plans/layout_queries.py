"""Queries over layout views of the plain tables; every one reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions.text import caption_kind, char_similarity, hash_bucket, normalized
from leafline.operators import content, covers, matching, metrics, order
from leafline.sources import layout, sinks
from leafline.sources.layout import PAGE_HEIGHT, PAGE_WIDTH, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _el(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_lines(spark, d)


def _visual(spark: SparkSession, d: str) -> DataFrame:
    return order.visual_order(_el(spark, d))


def _captions(e: DataFrame) -> DataFrame:
    return e.where(F.col("idx") % 9 == 0)


def _figures(e: DataFrame) -> DataFrame:
    return e.where(F.col("idx") % 9 == 3)


@query
def visual_order(spark, d):
    return _visual(spark, d).select("page", "idx", "visual_rank")


@query
def successor_edges(spark, d):
    return order.successor_edges(_visual(spark, d))


@query
def box_flow_order(spark, d):
    return order.box_flow_order(_el(spark, d)).select("page", "idx", "flow_rank")


@query
def order_disagreement(spark, d):
    e = _el(spark, d)
    return order.order_disagreement(order.visual_order(e), order.box_flow_order(e), "visual_rank", "flow_rank")


@query
def flow_segments(spark, d):
    return order.flow_segments(_visual(spark, d)).select("page", "idx", "segment")


@query
def xy_cut_level1(spark, d):
    return order.xy_cut_level1(_el(spark, d))


@query
def xy_cut_full(spark, d):
    return covers.recursive_xy_cut(_el(spark, d))


@query
def column_gap_split(spark, d):
    return order.column_gap_split(_el(spark, d)).withColumn("col", F.col("col").cast("bigint"))


@query
def x_gap_clusters(spark, d):
    return order.gap_clusters(_el(spark, d))


@query
def running_mean_rows(spark, d):
    return covers.running_mean_rows(_el(spark, d))


@query
def margin_artifacts(spark, d):
    return order.margin_artifacts(_el(spark, d), PAGE_HEIGHT)


@query
def caption_kinds(spark, d):
    return _el(spark, d).select("page", "idx", caption_kind(F.col("text")).alias("kind"))


@query
def element_roles(spark, d):
    return content.element_roles(_el(spark, d), PAGE_HEIGHT)


@query
def page_strata(spark, d):
    return content.page_strata(_el(spark, d), PAGE_WIDTH)


@query
def region_match(spark, d):
    e = _el(spark, d)
    return matching.best_regions(e, layout.regions(e))


@query
def membership_parent(spark, d):
    e = _el(spark, d)
    return matching.memberships(e, layout.regions(e)).withColumn("region", F.coalesce("region", F.lit(-1).cast("bigint")))


@query
def outside_regions(spark, d):
    e = _el(spark, d)
    return matching.outside_regions(e, layout.regions(e).where("region % 2 = 0")).select("page", "idx")


@query
def near_duplicates(spark, d):
    e = _el(spark, d)
    both = e.unionByName(layout.provider(e, 1).withColumn("idx", F.col("idx") + 100_000).select(e.columns))
    return matching.near_duplicate_pairs(both)


@query
def fallback_completion(spark, d):
    e = _el(spark, d)
    return matching.completed(layout.provider(e, 1), e).select("page", "idx", "origin", "x0", "y0")


@query
def area_suppression(spark, d):
    e = _el(spark, d)
    return matching.suppressed_by_area(e.unionByName(layout.provider(e, 1).withColumn("idx", F.col("idx") + 100_000).select(e.columns)))


@query
def anchor_match_text(spark, d):
    e = _el(spark, d)
    return matching.anchor_matches(e, layout.provider(e, 2))


@query
def anchor_match_graphical(spark, d):
    e = _el(spark, d)
    m = matching.mutual_correspondence(e, layout.provider(e, 2), 0.3)
    return covers.one_to_one(m.withColumnRenamed("iou", "score").select("page", "left", "right", "score"))


@query
def mutual_correspondence(spark, d):
    e = _el(spark, d)
    return matching.mutual_correspondence(e, layout.provider(e, 2))


@query
def caption_targets(spark, d):
    e = _el(spark, d)
    return matching.caption_targets(_captions(e), _figures(e), PAGE_WIDTH, PAGE_HEIGHT)


@query
def endpoint_resolution(spark, d):
    e = _el(spark, d)
    keys = e.where("idx % 4 <> 3").select("page", F.concat(F.lit("k"), F.floor(F.col("idx") / 2)).alias("ref"), "idx")
    aliases = e.where("idx % 3 <> 0").select("page", F.concat(F.lit("k"), F.col("idx")).alias("ref"), "idx")
    refs = e.select("page", F.concat(F.lit("k"), F.col("idx")).alias("ref"))
    return matching.resolved_endpoints(refs, keys, aliases).withColumn("idx", F.coalesce("idx", F.lit(-1).cast("bigint")))


@query
def mutual_neighbours(spark, d):
    return order.mutual_neighbours(_el(spark, d))


@query
def topk_candidates(spark, d):
    return order.topk_candidates(order.edge_scores(_el(spark, d), PAGE_HEIGHT))


@query
def topology_budget(spark, d):
    return order.topology_budget(_el(spark, d))


@query
def corridor_blockers(spark, d):
    v = _visual(spark, d)
    return order.corridor_blockers(v, order.successor_edges(v))


@query
def provider_segments(spark, d):
    return order.provider_segments(_visual(spark, d))


@query
def unassigned_runs(spark, d):
    return order.unassigned_runs(_visual(spark, d), F.col("idx") % 5 != 0)


@query
def stream_index(spark, d):
    v = _visual(spark, d).withColumn("stream", F.when(F.col("idx") % 9 == 0, "heading").when(F.col("x0") >= 300, "right").otherwise("left"))
    return order.stream_index(v, "stream", "visual_rank").select("page", "idx", "stream", "stream_index")


def _provider_edges(spark: SparkSession, d: str) -> DataFrame:
    e, out = _el(spark, d), None
    for k in (1, 2, 3):
        v = order.visual_order(layout.provider(e, k))
        one = order.successor_edges(v).join(v.select("page", F.col("idx").alias("source"), "confidence"), ["page", "source"]).withColumn("provider", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@query
def provider_consensus(spark, d):
    return matching.provider_consensus(_provider_edges(spark, d))


def _candidate_orders(spark: SparkSession, d: str) -> DataFrame:
    e = _el(spark, d)
    named = lambda df, name, rank: df.select("page", F.lit(name).alias("candidate"), "idx", F.col(rank).alias("place"))
    return (
        named(order.visual_order(e), "visual", "visual_rank").unionByName(named(order.box_flow_order(e), "flow", "flow_rank"))
        .unionByName(named(order.box_flow_order(e, -0.5), "columns", "flow_rank"))
    )


@query
def consensus_votes(spark, d):
    return covers.consensus_votes(_candidate_orders(spark, d))


@query
def consensus_cover(spark, d):
    return covers.consensus_cover(covers.consensus_votes(_candidate_orders(spark, d)))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return order.topk_candidates(order.edge_scores(_el(spark, d), PAGE_HEIGHT), 3)


@query
def path_cover(spark, d):
    return covers.path_cover(_scored(spark, d).select("page", "source", "target", "score", (F.col("score") > 0.97).alias("protected")))


@query
def max_regret_cover(spark, d):
    return covers.max_regret_cover(_scored(spark, d).where("score >= 0.5"))


@query
def topological_order(spark, d):
    v = _visual(spark, d)
    return covers.topological_order(v, _scored(spark, d).where("rank = 1"), "visual_rank")


@query
def shape_components(spark, d):
    return covers.components(order.mutual_neighbours(_el(spark, d)).where("gap <= 18"))


@query
def tree_preorder(spark, d):
    e = _el(spark, d)
    return content.tree_preorder(e.select("page", F.col("idx").alias("node"), F.when(F.col("idx") > 0, F.floor((F.col("idx") - 1) / 3)).alias("parent"), F.col("idx").alias("pos")))


@query
def anchor_paths(spark, d):
    v = _visual(spark, d)
    return content.anchor_paths(order.successor_edges(v), v.where("idx % 6 = 0"))


@query
def comembership_prf(spark, d):
    v = _visual(spark, d)
    truth = metrics.comembership_pairs(v.select("page", F.floor(F.col("idx") / 4).alias("group"), "idx"))
    found = metrics.comembership_pairs(v.select("page", F.floor((F.col("visual_rank") - 1) / 4).alias("group"), "idx"))
    return metrics.prf(found, truth, ["source", "target"], ["page"])


@query
def edge_prf_partial(spark, d):
    e = _el(spark, d)
    truth = order.successor_edges(order.box_flow_order(e), "flow_rank").where("source % 4 <> 0")
    return metrics.edge_prf_partial(order.successor_edges(order.visual_order(e)), truth)


@query
def sequence_quality(spark, d):
    e = _el(spark, d)
    expected = e.select("page", F.col("idx").alias("place"), "text")
    actual = order.visual_order(layout.provider(e, 3)).select("page", F.col("visual_rank").alias("place"), "text")
    return metrics.sequence_quality(expected, actual)


@query
def kendall_by_slice(spark, d):
    e = _el(spark, d)
    dis = order.order_disagreement(order.visual_order(e), order.box_flow_order(e), "visual_rank", "flow_rank")
    return metrics.kendall_by_slice(dis, e.groupBy("page").agg(F.count("*").alias("n")))


@query
def confusion_matrix(spark, d):
    e = _el(spark, d)
    roles = content.element_roles(e, PAGE_HEIGHT)
    noisy = content.element_roles(content.degraded(e, "a"), PAGE_HEIGHT)
    return metrics.confusion(roles.withColumnRenamed("role", "expected"), noisy.withColumnRenamed("role", "actual"), ["page", "idx"])


@query
def fragment_merge(spark, d):
    e = _el(spark, d)
    r = layout.regions(e, 3).withColumnRenamed("region", "idx")
    return metrics.fragments(matching.anchor_matches(e, r, 0.3))


@query
def bbox_error_quantiles(spark, d):
    e = _el(spark, d)
    both = e.select("page", "idx", F.col("x0").alias("a")).join(content.degraded(e, "b").select("page", "idx", F.col("x0").alias("b")), ["page", "idx"])
    return metrics.error_summary(both.withColumn("error", F.round(F.abs(F.col("a") - F.col("b")), 6)).withColumn("slice", F.col("page") % 4), "error", ["slice"])


@query
def token_f1(spark, d):
    """Bags of words of each benchmark item and of the document with its number."""
    words = lambda name, key: table(spark, d, name).select(F.col(key).alias("id"), F.explode(F.split(normalized(F.col("text")), " ")).alias("token")).where("token <> ''")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return metrics.token_f1(words("benchmark", "item_id"), words("documents", "doc_id").join(items, "id", "left_semi"), ["id"])


@query
def char_similarity_by_role(spark, d):
    e = content.pseudo_translation(_el(spark, d)).withColumnRenamed("text", "longer")
    both = _el(spark, d).join(e, ["page", "idx"]).select("page", "idx", normalized(F.col("text")).alias("a"), normalized(F.col("longer")).alias("b"))
    return both.select("page", "idx", F.round(char_similarity(F.col("a"), F.col("b")), 8).alias("similarity"))


@query
def degradation_signature(spark, d):
    e = _el(spark, d)
    noisy = content.degraded(e, "c").select("page", "idx", F.col("text").alias("seen"))
    rates = e.join(noisy, ["page", "idx"], "left").groupBy("page").agg(
        F.round(F.count_if(F.expr("seen IS NULL")) / F.count("*"), 8).alias("missing"), F.round(F.count_if(F.expr("seen = '' AND text <> ''")) / F.count("*"), 8).alias("masked")
    )
    return content.nearest_profile(rates, {"clean": [0.0, 0.0], "mild": [0.08, 0.03], "stress": [0.2, 0.1]}, ["missing", "masked"])


@query
def wilson_gate(spark, d):
    counts = table(spark, d, "labels").groupBy((F.col("doc_id") % 8).alias("slice")).agg(F.sum("quality").alias("hits"), F.count("*").alias("total"))
    return metrics.wilson_gate(counts)


@query
def threshold_scan(spark, d):
    scored = table(spark, d, "labels").select((hash_bucket(F.col("doc_id"), 1000) / 1000 * 0.7 + F.col("quality") * 0.3).alias("score"), F.col("quality").alias("label"))
    return metrics.threshold_scan(scored.withColumn("score", F.round("score", 6)))


@query
def stratified_rules_cv(spark, d):
    docs = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    rules = {"long": F.col("n_chars") > 1000, "english": F.col("lang") == "en", "not toxic": F.col("toxic") == 0}
    return metrics.cross_validated_rules(docs, "doc_id", rules, "quality")


@query
def hash_partition(spark, d):
    return metrics.hash_partition(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 80, "calibration": 10, "test": 10})


@query
def stratified_sample(spark, d):
    return metrics.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 40)


@query
def noise_profile(spark, d):
    return content.degraded(_el(spark, d), "n")


@query
def replacement_fit(spark, d):
    e = content.pseudo_translation(_el(spark, d)).select("page", "idx", F.col("text").alias("new_text"))
    return content.replacement_fit(_el(spark, d).join(e, ["page", "idx"]), F.col("new_text"))


@query
def padding_conflicts(spark, d):
    return content.padding_conflicts(_el(spark, d))


@query
def pseudo_translation(spark, d):
    return content.pseudo_translation(_el(spark, d))


@query
def apply_edits(spark, d):
    e = _el(spark, d)
    edits = e.where("idx % 5 = 0").select("page", "idx", F.when(F.col("idx") % 10 == 0, F.col("text")).otherwise(F.lit("old")).alias("source_text"), F.reverse("text").alias("text"))
    return content.apply_edits(e, edits)


@query
def risk_score(spark, d):
    e = content.page_strata(_el(spark, d), PAGE_WIDTH)
    n = F.col("left_lines") + F.col("right_lines") + F.col("wide_lines")
    rates = e.select("page", F.round(F.col("wide_lines") / n, 8).alias("wide"), F.round(F.abs(F.col("left_lines") - F.col("right_lines")) / n, 8).alias("uneven"))
    return metrics.risk_score(rates, {"wide": 0.6, "uneven": 0.4})


@query
def html_blocks(spark, d):
    return layout.html_blocks(spark, d)


@query
def positioned_html(spark, d):
    return sinks.positioned_html(_el(spark, d)).select("page", F.md5("html").alias("html_md5"), F.length("html").cast("bigint").alias("n"))


@query
def turn_streams(spark, d):
    t = table(spark, d, "conversations").withColumnRenamed("conv_id", "page")
    return order.stream_index(t, "role", "turn").select("page", "turn", "role", "stream_index")


@query
def document_revisions(spark, d):
    """The last event of each user, as the last revision of a document."""
    from leafline.streaming.windows import latest_revisions

    events = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.struct("ts", "event_id").alias("created_at"), F.col("event_type").alias("payload"))
    return latest_revisions(events).select("document_id", "payload", F.col("created_at.event_id").alias("event_id"))


@query
def windowed_events(spark, d):
    from leafline.streaming.windows import windowed_counts

    return windowed_counts(table(spark, d, "events")).select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))
