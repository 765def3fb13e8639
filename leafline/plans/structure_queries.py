"""Queries of shapes, structure evidence, features and reports over layout views of the plain tables; every one reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import features, matching, order, reports, shapes, structure
from leafline.operators.pages import dealt
from leafline.sources import layout
from leafline.sources.layout import PAGE_HEIGHT, PAGE_WIDTH, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EDGE = ["page", "source", "target"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _el(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_lines(spark, d)


def _folded(spark: SparkSession, d: str) -> DataFrame:
    """Elements as shapes: rows are folded into a band of 400 points."""
    e = _el(spark, d).withColumn("top", F.pmod("y0", F.lit(400.0)))
    return e.select("page", "idx", "x0", F.col("top").alias("y0"), "x1", (F.col("top") + F.col("y1") - F.col("y0")).alias("y1"))


def _visual(spark: SparkSession, d: str) -> DataFrame:
    return order.visual_order(_el(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return order.successor_edges(_visual(spark, d))


def _flow_edges(spark: SparkSession, d: str) -> DataFrame:
    return order.successor_edges(order.box_flow_order(_el(spark, d)), "flow_rank")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Labelled edges: neighbours by index, of which one in five is not labelled."""
    return order.successor_edges(_el(spark, d), "idx").where("source % 5 <> 2")


def _ref(idx: Column | str) -> Column:
    return F.concat(F.lit("E"), F.col(idx) if isinstance(idx, str) else idx)


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Structure JSON of each page, with edges in several spellings, and a stream of the even elements."""
    e = _el(spark, d).withColumn("last", F.expr("max(idx) OVER (PARTITION BY page)"))
    here, after = _ref("idx"), _ref(F.col("idx") + 1)
    has_next = F.col("idx") < F.col("last")
    kind = F.when(F.col("idx") % 10 == 0, "Order").otherwise("next")
    at = lambda c, v: F.sort_array(F.collect_list(F.when(c, F.struct("idx", v.alias("v")))))
    rows = e.groupBy("page").agg(
        at(F.lit(True), F.struct(here.alias("id"), F.col("text"))).alias("el"),
        at(has_next & (F.col("idx") % 3 == 0), F.array(here, after)).alias("se"),
        at(has_next & (F.col("idx") % 5 == 0), F.struct(kind.alias("type"), F.lower(here).alias("source"), F.concat(F.lit(" "), after).alias("target"))).alias("re"),
        at(F.col("idx") % 2 == 0, here).alias("st"),
    )
    v = lambda c: F.transform(c, lambda x: x["v"])
    stream = F.struct(F.lit("").alias("stream_id"), F.lit("body").alias("stream_type"), v("st").alias("sequence"))
    return rows.select("page", F.to_json(F.struct(v("el").alias("elements"), v("se").alias("successor_edges"), v("re").alias("relations"), F.array(stream).alias("streams"))).alias("payload"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of elements: most by name, one in eleven with its successor as a group, and all texts."""
    e = _el(spark, d)
    name, key = F.lower(_ref("idx")), lambda c, ref, idx: F.when(c, F.struct(ref.alias("ref"), idx.alias("idx")))
    found = F.array(
        key(F.col("idx") % 7 != 0, name, F.col("idx")), key(F.col("idx") % 11 == 0, name, F.col("idx") + 1),
        key(F.trim("text") != "", structure.ref_key(F.col("text")), F.col("idx")),
    )
    return e.select("page", F.explode(F.array_compact(found)).alias("k")).select("page", "k.ref", "k.idx").repartition("page").distinct()


@query
def shape_classes(spark, d):
    return shapes.cluster_classes(_folded(spark, d).withColumn("cluster", F.floor(F.col("idx") / 4)))


@query
def raster_pages(spark, d):
    return shapes.raster_pages(_folded(spark, d), PAGE_WIDTH, PAGE_HEIGHT, 24, 4)


@query
def raster_tables(spark, d):
    return shapes.raster_tables(_folded(spark, d).withColumn("cluster", F.floor(F.col("idx") / 40)), PAGE_WIDTH, PAGE_HEIGHT, 12)


@query
def image_coverage(spark, d):
    return shapes.image_coverage(_folded(spark, d).where("idx % 3 = 0"), PAGE_WIDTH, PAGE_HEIGHT)


@query
def shape_near_pairs(spark, d):
    return shapes.near_pairs(_el(spark, d))


@query
def table_region_of(spark, d):
    e = _el(spark, d)
    return shapes.table_region_of(e, layout.regions(e).where("region % 2 = 0"))


@query
def structure_relations(spark, d):
    return structure.structure_relations(_payloads(spark, d))


@query
def structure_streams(spark, d):
    return structure.structure_streams(_payloads(spark, d))


@query
def resolved_relations(spark, d):
    return structure.resolved_relations(structure.structure_relations(_payloads(spark, d)), _keys(spark, d))


@query
def relation_statistics(spark, d):
    return structure.relation_statistics(resolved_relations(spark, d))


@query
def resolved_streams(spark, d):
    return structure.resolved_streams(structure.structure_streams(_payloads(spark, d)), _keys(spark, d).where("ref LIKE 'e%'"))


@query
def order_companions(spark, d):
    e = _el(spark, d)
    source = lambda c: F.concat(F.lit("s"), F.col(c) % 2)
    anchors = e.select("page", "idx", F.when(F.col("idx") % 3 == 0, "table").otherwise("text").alias("label"), source("idx").alias("source"))
    r = layout.regions(e, 5)
    blocks = r.select(
        "page", F.col("region").alias("block"), F.when(F.col("region") % 2 == 0, "table").otherwise("paragraph").alias("label"), source("region").alias("source"),
        F.when(F.col("region") % 5 != 0, F.floor(F.col("region") / 2)).alias("ord"), "x0", "y0", "x1", "y1",
    )
    return structure.order_companions(e, anchors, blocks)


@query
def tier_edges(spark, d):
    v = _visual(spark, d).select("page", "idx", F.when(F.col("idx") % 4 != 1, F.floor(F.col("idx") / 3)).alias("ord"), F.col("visual_rank").alias("rank"))
    return structure.tier_edges(v)


@query
def block_streams(spark, d):
    e = _el(spark, d).select("page", "idx", F.floor(F.col("idx") / 4).alias("block"), F.floor(F.col("y0") / 60).alias("segment"), (F.col("x0") > 300).alias("col"))
    return structure.block_streams(e.where("idx % 3 <> 1"))


@query
def stream_parts(spark, d):
    e = _el(spark, d).select("page", "idx", (F.col("idx") % 3).alias("stream"), F.col("idx").alias("place"), F.when(F.col("x0") > 300, "right").when(F.col("x0") > 36, "left").alias("col"))
    return structure.split_at_changes(e, "col")


@query
def chain_parts(spark, d):
    e = _el(spark, d).withColumn("chain", F.floor(F.col("idx") / 12)).withColumn("place", F.col("idx"))
    return structure.split_chains(e)


@query
def unique_labels(spark, d):
    e = _el(spark, d).where("trim(text) <> ''")
    key = structure.ref_key(F.col("text"))
    return structure.unique_labels(e.where("idx % 3 = 0").select("page", key.alias("ref")).distinct(), e.select("page", key.alias("ref"), "idx"))


@query
def evidence_by_stem(spark, d):
    docs = table(spark, d, "documents")
    path = lambda a, b: F.concat(F.lit(a), F.col("source"), F.lit("/Doc-"), F.col("doc_id"), F.lit(b))
    files = docs.where("doc_id % 3 <> 0").select(path("evidence/", ".structure.json").alias("path")).unionByName(docs.where("doc_id % 5 = 0").select(path("other/", ".json").alias("path")))
    return structure.evidence_by_stem(docs.select(path("in/", ".pdf").alias("path")), files)


@query
def stream_types(spark, d):
    e, on = _el(spark, d), lambda n, k, v: F.when(F.col("idx") % n == k, v)
    kind = structure.stream_type(
        on(17, 3, "Footnote"), on(13, 4, " Running Head "), on(13, 5, "note"), on(7, 2, "Figure"), on(11, 6, "page/table-island-001"), on(11, 7, "grid-2"), on(9, 8, "x-table-row-major-v1")
    )
    name = structure.stream_name(kind, on(2, 0, (F.col("idx") % 4).cast("int")), on(14, 2, F.lit("fig 1")))
    return e.select("page", "idx", kind.alias("type"), name.alias("stream"))


@query
def point_lookup(spark, d):
    return structure.point_lookup(_el(spark, d), layout.MOST_PAGES, 0)


@query
def normalized_ranks(spark, d):
    return features.normalized_ranks(order.box_flow_order(_visual(spark, d)), "visual_rank", "flow_rank")


@query
def pair_order_features(spark, d):
    e = _el(spark, d).withColumn("role", F.when(F.col("idx") % 9 == 0, "title").when(F.col("idx") % 9 == 8, "note").when(F.col("idx") % 2 == 0, "text").otherwise("aside"))
    return features.pair_order_features(_flow_edges(spark, d), e, normalized_ranks(spark, d), ["title", "text", "other"], PAGE_WIDTH, PAGE_HEIGHT)


@query
def paragraph_features(spark, d):
    pairs = _edges(spark, d).select(*EDGE, F.lit(True).alias("adjacent"), (F.col("target") == F.col("source") + 1).alias("selected"), (F.col("source") % 4 / 4).alias("forward"), F.lit(0.0).alias("reverse"))
    return features.paragraph_features(pairs, _el(spark, d), PAGE_WIDTH)


@query
def floating_features(spark, d):
    e = _el(spark, d).select("*", F.when(F.col("idx") % 9 == 3, "figure").when(F.col("idx") % 9 == 5, "table").alias("kind"), (F.col("idx") % 20).alias("lines"))
    pairs = matching.caption_targets(e.where("idx % 9 = 0"), e.where("kind IS NOT NULL"), PAGE_WIDTH, PAGE_HEIGHT)
    return features.floating_features(pairs.select("page", F.col("target").alias("source"), F.col("caption").alias("target")), e, PAGE_WIDTH, PAGE_HEIGHT)


@query
def borda_order(spark, d):
    v = _visual(spark, d)
    near = v.select("page", F.col("idx").alias("source"), F.col("visual_rank").alias("r"), F.explode(F.array(*[F.col("visual_rank") + k for k in (-3, -2, -1, 1, 2, 3)])).alias("s"))
    pairs = near.join(v.select("page", F.col("idx").alias("target"), F.col("visual_rank").alias("s")), ["page", "s"])
    p = 0.5 + 0.1 * (F.col("s") - F.col("r")) + F.pmod(F.col("source") * 7 + F.col("target"), F.lit(5)) / 50
    return features.borda_order(pairs.select("page", "source", "target", F.round(p, 6).alias("p")), v)


@query
def paragraph_candidates(spark, d):
    return features.local_candidates(_el(spark, d), _edges(spark, d), _flow_edges(spark, d))


@query
def page_profiles(spark, d):
    e = _el(spark, d).withColumn("role", F.when(F.col("idx") % 9 == 0, "title").when(F.col("idx") % 9 == 8, "note").otherwise("text"))
    v = _visual(spark, d)
    far = order.order_disagreement(v, order.box_flow_order(_el(spark, d)), "visual_rank", "flow_rank").select("page", F.col("successor_disagreement").alias("flow_disagreement"))
    return features.page_profile(e, far)


@query
def profile_outliers(spark, d):
    profiles = page_profiles(spark, d)
    return features.envelope_status(profiles, features.profile_envelope(profiles.where("page % 2 = 0")))


@query
def edge_report_by_provider(spark, d):
    e = _el(spark, d)
    own = [order.successor_edges(order.visual_order(layout.provider(e, k))).withColumn("provider", F.lit(k)) for k in (1, 2, 3)]
    truth = _truth(spark, d).withColumn("provider", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return reports.edge_report(own[0].unionByName(own[1]).unionByName(own[2]), truth, "provider")


@query
def corpus_report(spark, d):
    return reports.corpus_report(_page_counts(spark, d))


def _page_counts(spark: SparkSession, d: str) -> DataFrame:
    both = _edges(spark, d).withColumn("p", F.lit(1)).join(_truth(spark, d).withColumn("t", F.lit(1)), EDGE, "full")
    return both.groupBy("page").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("correct"), F.count("p").alias("predicted"), F.count("t").alias("labels"))


@query
def membership_report(spark, d):
    e = _el(spark, d)
    predicted = matching.best_regions(e, layout.regions(e))
    return reports.membership_report(predicted, e.select("page", "idx", F.floor(F.col("idx") / 4).alias("region")), order.successor_edges(e, "idx"))


@query
def pair_report(spark, d):
    e = _el(spark, d)
    return reports.pair_report(e.where("idx % 6 <> 5").select("page", "idx", F.floor(F.col("idx") / 3).alias("region")), e.select("page", "idx", F.floor(F.col("idx") / 4).alias("region")))


@query
def native_support(spark, d):
    channels = _edges(spark, d).withColumn("channel", F.lit("visual")).unionByName(_flow_edges(spark, d).withColumn("channel", F.lit("flow")))
    provided = order.successor_edges(order.visual_order(layout.provider(_el(spark, d), 2)))
    return reports.native_support(provided, channels, _el(spark, d).where("idx % 8 <> 7"), _truth(spark, d))


@query
def support_gate(spark, d):
    return reports.support_gate(native_support(spark, d), 0.3, 0.2)


@query
def kind_report(spark, d):
    e = _el(spark, d)
    hit = matching.anchor_matches(e, layout.provider(e, 2)).select("page", "idx", F.lit(True).alias("hit"))
    kinds = e.select("page", "idx", F.when(F.col("idx") % 9 == 3, "figure").when(F.col("idx") % 9 == 5, "table").otherwise("text").alias("kind"), F.when(F.col("page") % 4 == 0, "test").otherwise("fit").alias("partition"))
    return reports.kind_report(kinds.join(hit, ["page", "idx"], "left").withColumn("matched", F.col("hit").isNotNull()))


@query
def relation_audit(spark, d):
    return reports.relation_audit(_truth(spark, d).where("source % 3 = 0"), _flow_edges(spark, d).where("source % 2 = 0"))


@query
def difference_summary(spark, d):
    docs = table(spark, d, "documents")
    diff = F.when(F.col("doc_id") % 50 != 7, F.pmod(F.col("doc_id") * 37, F.lit(1000)) / 20_000)
    return reports.difference_summary(docs.select(F.col("doc_id").alias("page"), diff.alias("diff"))).drop("p95")


@query
def totals_by_stream(spark, d):
    e = _el(spark, d)
    scale = F.greatest(F.lit(0.62), F.round((F.col("x1") - F.col("x0")) / F.greatest(F.lit(1.0), 5.2 * F.length("text")), 6))
    return reports.totals_by_stream(e.select((F.col("idx") % 3).alias("stream"), (scale < 0.7).alias("overflow"), (F.col("idx") % 5 == 0).alias("conflict"), (F.length("text") > 40).alias("masked"), scale.alias("scale")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    score = F.pmod(F.col("page") * 131 + F.col("source") * 31 + F.col("target") * 17, F.lit(997)) / 997
    known = _truth(spark, d).withColumn("correct", F.lit(True))
    return _edges(spark, d).withColumn("score", score).join(known, EDGE, "left").select(*EDGE, "score", (F.col("source") % 6 != 5).alias("scorable"), F.col("correct").isNotNull().alias("correct"))


@query
def threshold_curve(spark, d):
    return reports.threshold_curve(reports.score_histogram(_scored(spark, d)), _truth(spark, d).agg(F.count("*").alias("labels")))


@query
def best_threshold(spark, d):
    return reports.best_threshold(threshold_curve(spark, d), 0.3, 20)


@query
def noise_gate(spark, d):
    s = _scored(spark, d).withColumn("profile", F.when(F.col("page") % 3 == 0, "clean").when(F.col("page") % 3 == 1, "mild").otherwise("stress"))
    at = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("threshold", F.col("k") / 10)
    labels = F.count("*")
    counted = at.groupBy("profile", "threshold").agg(F.count_if(F.col("scorable") & (F.col("score") >= F.col("threshold"))).alias("predicted"), F.count_if(F.col("scorable") & F.col("correct") & (F.col("score") >= F.col("threshold"))).alias("correct"), labels.alias("labels"))
    return reports.noise_gate(counted, 0.3)


@query
def best_candidate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("setting"))
    tried = docs.select("doc_id", "setting", (F.pmod(F.col("doc_id") * 7 + F.col("setting") * 3, F.lit(4)) / 4).alias("sim"), (F.col("setting") % 3).alias("cost"), F.pmod(F.col("doc_id") + F.col("setting"), F.lit(5)).alias("sec"))
    return reports.best_candidate(tried, "sim", "cost", "sec", "doc_id")


@query
def model_comparison(spark, d):
    e = _el(spark, d)
    path = order.successor_edges(order.visual_order(layout.provider(e, 1)))
    models = _edges(spark, d).withColumn("model", F.lit("a visual")).unionByName(_flow_edges(spark, d).withColumn("model", F.lit("b flow"))).unionByName(path.withColumn("model", F.lit("c provider")))
    return reports.model_comparison(models, _truth(spark, d))


@query
def page_alignment(spark, d):
    """Blocks of four lines of a document as its pages, against blocks of a copy that begins two lines later."""
    e = dealt(_el(spark, d))
    lines = lambda shift: e.where(F.col("idx") >= shift).select(F.col("page").alias("doc"), F.floor((F.col("idx") - shift) / 4).alias("page"), F.lower("text").alias("text"))
    return reports.text_alignment(lines(0), lines(2))
