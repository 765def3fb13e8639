"""Queries of payload sources, exports, and orders by relations, over layout views of the plain tables; every one reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions.geometry import Box
from leafline.operators import covers, matching, order, reports, shapes
from leafline.operators.pages import dealt
from leafline.operators.shapes import shape_geometry
from leafline.sources import layout, payloads, sinks
from leafline.sources.layout import PAGE_HEIGHT, PAGE_WIDTH, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BOX = ["x0", "y0", "x1", "y1"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _el(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_lines(spark, d)


def _listed(*fields: Column | str) -> Column:
    """Rows of a group as an array in order of idx."""
    return F.transform(F.sort_array(F.collect_list(F.struct("idx", F.struct(*fields).alias("v")))), lambda x: x["v"])


def _json(df: DataFrame, **fields: Column) -> DataFrame:
    rows = df.groupBy("page").agg(*[c.alias(n) for n, c in fields.items()])
    return rows.select("page", F.to_json(F.struct(*fields)).alias("payload"))


@query
def source_kinds(spark, d):
    ending = F.element_at(F.array(*map(F.lit, [".pdf", ".PNG", ".tar.gz", ".jpeg", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("in/"), "source", F.lit("/d"), "doc_id", ending)
    return table(spark, d, "documents").select(path.alias("path"), payloads.source_kind(path).alias("kind"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    words = dealt(_el(spark, d)).select("page", F.col("idx").alias("line"), F.posexplode(F.split("text", " ")).alias("pos", "text"), "x0", "y0", "x1", "y1")
    step = (F.col("x1") - F.col("x0")) / 64
    return words.select("page", "line", F.col("pos").cast("bigint").alias("pos"), "text", F.when(F.col("line") % 9 == 0, 24.0).otherwise(10.0).alias("font_size"), (F.col("x0") + F.least(F.col("pos"), F.lit(63)) * step).alias("x0"), "y0", "x1", "y1")


@query
def lines_of_spans(spark, d):
    return payloads.lines_of_spans(_spans(spark, d)).select("page", "idx", "text", "type", "x0", "y0", "x1", "y1")


@query
def pages_for_ocr(spark, d):
    e = _el(spark, d)
    cover = e.select("page").distinct().select("page", ((F.col("page") / layout.MOST_PAGES) % 7 / 7).alias("coverage"))
    return payloads.needs_ocr(e.select("page").distinct(), e.where("page % 3 = 0 AND trim(text) <> ''"), cover.withColumn("coverage", F.round("coverage", 6)))


def _wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of three forms by page: bare blocks, a list of pages with results, and a list of results."""
    e = _el(spark, d)
    block = _listed(F.lit(" Text ").alias("type"), F.array("x0", "y0", F.when(F.col("idx") % 8 == 5, F.col("x0")).otherwise(F.col("x1")), "y1").alias("bbox"), F.col("text"), F.when(F.col("idx") % 2 == 0, F.col("idx").cast("int")).alias("order"), F.lit(0.5).alias("score"))
    other = _listed(F.lit("Title").alias("block_label"), F.array("x0", "y0", F.when(F.col("idx") % 8 == 5, F.col("x0")).otherwise(F.col("x1")), "y1").alias("block_bbox"), F.col("text").alias("block_content"), F.when(F.col("idx") % 2 == 0, F.col("idx").cast("int")).alias("block_order"))
    rows = e.groupBy("page").agg(block.alias("a"), other.alias("b"))
    kind = F.col("page") % 3
    bare = F.to_json(F.struct(F.col("a").alias("blocks")))
    pages = F.to_json(F.struct(F.array(F.struct(F.lit(4).alias("page_index"), F.struct(F.col("b").alias("parsing_res_list")).alias("res"))).alias("pages")))
    results = F.to_json(F.struct(F.array(F.struct(F.col("a").alias("blocks"))).alias("results")))
    return rows.select("page", F.when(kind == 0, bare).when(kind == 1, pages).otherwise(results).alias("payload"))


@query
def evidence_rows(spark, d):
    return payloads.evidence_rows(payloads.wrapped_blocks(_wrapped(spark, d)), 0.5)


@query
def reference_tree(spark, d):
    """Bodies whose children are texts, and groups of them, by reference; one in nine references leads nowhere."""
    e = _el(spark, d)
    ref = lambda kind, i: F.concat(F.lit(f"#/{kind}/"), i)
    group = F.floor(F.col("idx") / 4)
    texts = e.where("idx % 9 <> 8").groupBy("page").agg(_listed(ref("texts", F.col("idx")).alias("self_ref"), F.lit("text").alias("label"), "text").alias("texts"))
    link = lambda c: F.struct(c.alias("$ref"))
    groups = e.groupBy("page", group.alias("g")).agg(F.transform(F.sort_array(F.collect_list("idx")), lambda i: link(ref("texts", i))).alias("children"))
    groups = groups.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("g", "children"))).alias("gs"))
    both = groups.join(texts, "page", "left")
    doc = F.struct(
        F.struct(F.lit("#/body").alias("self_ref"), F.transform("gs", lambda x: link(ref("groups", x["g"]))).alias("children")).alias("body"),
        F.transform("gs", lambda x: F.struct(ref("groups", x["g"]).alias("self_ref"), F.lit("group").alias("label"), x["children"].alias("children"))).alias("groups"), F.col("texts"),
    )
    nodes = payloads.tree_nodes(both.select("page", F.to_json(doc).alias("payload")))
    return nodes.select("page", "ref", "parent", "pos", "label")


@query
def table_cells(spark, d):
    cells = _el(spark, d).select("page", F.floor(F.col("idx") / 12).alias("tab"), F.floor(F.col("idx") % 12 / 3).alias("row"), (F.col("idx") % 3).alias("col"), "text").where("page % 2 = 0 OR col < 2")
    return payloads.table_cells(cells)


def _displayed(spark: SparkSession, d: str) -> DataFrame:
    value = F.format_string("label: %s, bbox: [%.1f, %.1f, %.1f, %.1f], content: %s", F.when(F.col("idx") % 3 == 0, "title").otherwise("text"), "x0", "y0", "x1", "y1", "text")
    return _el(spark, d).select("page", F.col("idx").alias("pos"), F.when(F.col("idx") % 10 == 9, "unreadable").otherwise(value).alias("value"))


@query
def display_blocks(spark, d):
    return payloads.display_blocks(_displayed(spark, d)).select("page", "pos", "label", "x0", "y0", "x1", "y1")


@query
def display_companions(spark, d):
    moved = (F.col("idx") % 4) * 0.5
    boxes = _el(spark, d).select("page", F.when(F.col("idx") % 6 == 0, "title").otherwise("text").alias("label"), F.col("idx").alias("ord"), F.lit(0.75).alias("score"), *[(F.col(c) + moved).alias(c) for c in BOX])
    return payloads.with_companions(payloads.display_blocks(_displayed(spark, d)), boxes).select("page", "pos", "label", "ord", "score")


@query
def stamped_payloads(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("payload"))
    return payloads.stamped(docs, "layout", "1.0").drop("payload")


@query
def annotated_images(spark, d):
    """Annotation sets of one document each: pages as images, lines as annotations, three categories of which one is unknown."""
    e = _el(spark, d).withColumn("doc", F.floor(F.col("page") / layout.MOST_PAGES))
    note = F.struct(
        (F.col("page") % layout.MOST_PAGES * 1000 + F.col("idx")).alias("id"), (F.col("page") % layout.MOST_PAGES).alias("image_id"),
        F.array("x0", "y0", F.when(F.col("idx") % 10 == 7, 0.0).otherwise(F.col("x1") - F.col("x0")), F.col("y1") - F.col("y0")).alias("bbox"), (F.col("idx") % 3).alias("category_id"),
    )
    image = F.struct((F.col("page") % layout.MOST_PAGES).alias("id"), F.lit("page.png").alias("file_name"), F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"))
    names = F.array(F.struct(F.lit(0).alias("id"), F.lit("title").alias("name")), F.struct(F.lit(1).alias("id"), F.lit("text").alias("name")))
    sets = e.groupBy("doc").agg(F.collect_list(note).alias("annotations"), F.collect_set(image).alias("images"))
    return payloads.annotated_images(sets.select("doc", F.to_json(F.struct("images", "annotations", names.alias("categories"))).alias("payload")))


@query
def answer_free_inputs(spark, d):
    rows = _el(spark, d).withColumn("place", F.col("idx")).withColumn("label", F.col("idx") % 2)
    inputs, answers = payloads.split_answers(rows, ["page", "idx"], ["place", "label"])
    if payloads.leaked(inputs, ["place", "label"]):
        raise ValueError("inputs hold answers")
    return inputs.select("page", "idx", "shuffled").join(answers, ["page", "idx"])


@query
def pixel_boxes(spark, d):
    e = _el(spark, d).select("page", "idx", *[(2 * F.col(c) - F.when(F.col("idx") % 9 == 4, 100).otherwise(0)).alias(c) for c in BOX])
    pages = e.select("page").distinct().where("page % 5 <> 4").select("page", F.lit(2.0).alias("scale_x"), F.lit(2.0).alias("scale_y"), F.lit(PAGE_WIDTH).alias("width"), F.lit(400.0).alias("height"))
    return payloads.pixel_boxes(e, pages)


@query
def fixture_order(spark, d):
    f = payloads.fixture_pages(spark, 50)
    return f.select("page", "idx", "place", "text", "x0", "y0")


@query
def document_round_trip(spark, d):
    return payloads.from_documents(payloads.to_documents(_el(spark, d)))


@query
def svg_shapes(spark, d):
    return sinks.svg_shapes(_el(spark, d).where("idx % 2 = 0"), shape_geometry(Box.of()))


@query
def svg_paths(spark, d):
    point = lambda *c: F.array(*[F.col(x) for x in c])
    none = F.array().cast("array<double>")
    op = lambda name, points: F.struct(F.lit(name).alias("op"), points.alias("points"))
    commands = F.array(op("m", point("x0", "y0")), op("l", point("x1", "y0")), op("c", point("x1", "y1", "x0", "y1", "x0", "y0")), op("h", none))
    return _el(spark, d).select("page", "idx", sinks.svg_path(commands).alias("path"))


@query
def page_xml(spark, d):
    e = _el(spark, d).withColumn("role", F.when(F.col("idx") % 9 == 0, "title"))
    return sinks.page_xml(e, sinks.text_for_mode("bilingual", F.col("text"), F.lit(""), F.when(F.col("idx") % 2 == 0, F.concat(F.lit("<"), F.col("text"), F.lit(">")))))


def _columns(spark: SparkSession, d: str) -> DataFrame:
    return _el(spark, d).select("page", "idx", F.when(F.col("idx") % 9 != 0, (F.col("idx") % 2).cast("int")).alias("col"))


@query
def relation_scores(spark, d):
    return order.relation_scores(_el(spark, d), _columns(spark, d), PAGE_WIDTH, PAGE_HEIGHT)


@query
def relation_candidates(spark, d):
    return order.topk_candidates(relation_scores(spark, d))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    chosen = relation_candidates(spark, d).where("score >= 0.3")
    return covers.max_regret_cover(chosen)


@query
def relation_graph_edges(spark, d):
    return _graph(spark, d)


@query
def relation_graph_order(spark, d):
    v = order.visual_order(_el(spark, d)).select("page", "idx", F.col("visual_rank").alias("rank"))
    return covers.serialized_chains(v, _graph(spark, d).select("page", "source", "target"))


@query
def spatial_graph_order(spark, d):
    return covers.spatial_graph_order(_el(spark, d), PAGE_WIDTH)


@query
def footnote_rows(spark, d):
    """Pages moved down so that their last lines lie at the foot."""
    down = 730 - F.expr("max(y1) OVER (PARTITION BY page)")
    return covers.footnotes(_el(spark, d).withColumn("down", down).withColumns({c: F.col(c) + F.col("down") for c in ("y0", "y1")}), PAGE_HEIGHT)


@query
def caption_blocks(spark, d):
    """Lines as they are, but one in thirteen begins as a caption does."""
    e = _el(spark, d).withColumn("text", F.when(F.col("idx") % 13 == 2, F.concat(F.lit("Figure "), "idx", F.lit(" "), "text")).otherwise(F.col("text")))
    return covers.caption_lines(e)


@query
def full_width_elements(spark, d):
    return order.full_width(_el(spark, d), _columns(spark, d).where("col IS NOT NULL"), PAGE_WIDTH)


@query
def region_match_text(spark, d):
    e = _el(spark, d)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    named = e.groupBy("page", F.floor(F.col("idx") / 4).alias("region")).agg(text.alias("text"), (F.min("idx") % 3 == 0).cast("int").alias("fine"), *[F.min(c).alias(c) for c in BOX[:2]], *[F.max(c).alias(c) for c in BOX[2:]])
    return matching.best_regions_by_text(e, named)


@query
def review_records(spark, d):
    return sinks.review_records(relation_candidates(spark, d), order.successor_edges(order.visual_order(_el(spark, d))))


@query
def proposal_digests(spark, d):
    return sinks.proposal_digests(order.successor_edges(order.visual_order(_el(spark, d))))


@query
def vector_clusters(spark, d):
    near = shapes.near_pairs(_el(spark, d))
    return covers.components(near)


@query
def graphical_gate(spark, d):
    """Report of relation candidates of first rank against labels, by the band of their scores."""
    first = relation_candidates(spark, d).where("rank = 1").withColumn("band", F.floor(F.col("score") * 5))
    truth = order.successor_edges(_el(spark, d), "idx")
    labels = truth.withColumn("band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    return reports.edge_counts(first.select("band", "page", "source", "target"), labels, "band")
