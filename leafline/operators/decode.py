"""Decisions over evidence: which edges are promoted, rescued or protected, and which region, stream or parent an element gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.geometry import Box, coverage, horizontal_overlap_ratio
from leafline.operators import covers
from leafline.operators.evidence import decided_similarity, is_meaningful, matched_similarity, plain_text, similarity_bound
from leafline.operators.matching import side

EDGE = ["page", "source", "target"]


def adjacency_scores(edges: DataFrame, elements: DataFrame, page_width: float) -> DataFrame:
    """Edges with 0.45 nearness + 0.35 horizontal overlap + 0.2 agreement of centres; null if the target is above, or over six median lines below."""
    line = elements.groupBy("page").agg(F.median(F.col("y1") - F.col("y0")).alias("line"))
    e = edges.select("page", F.col("source").alias("a_idx"), F.col("target").alias("b_idx")).join(side(elements, "a_", "idx"), ["page", "a_idx"]).join(side(elements, "b_", "idx"), ["page", "b_idx"]).join(line, "page")
    a, b = Box.of("a_"), Box.of("b_")
    gap, far = b.y0 - a.y1, F.greatest(F.lit(12.0), 6 * F.col("line"))
    near = 1 - F.greatest(F.lit(0.0), gap) / far
    center = 1 - F.least(F.lit(1.0), F.abs(a.center_x - b.center_x) / (0.25 * page_width))
    score = 0.45 * near + 0.35 * F.least(F.lit(1.0), horizontal_overlap_ratio(a, b)) + 0.2 * center
    return e.select("page", F.col("a_idx").alias("source"), F.col("b_idx").alias("target"), F.when(gap.between(-0.5 * F.col("line"), far), F.round(score, 8)).alias("geometry"))


def promoted_edges(orders: list[DataFrame], geometry: DataFrame, graph: DataFrame, least_geometry: float = 0.82, least_graph: float = 0.86) -> DataFrame:
    """Edges that all orders have, with enough geometry and graph score, and a graph score that no other target of the source has too."""
    agreed = orders[0].select(*EDGE)
    for other in orders[1:]:
        agreed = agreed.join(other.select(*EDGE), EDGE)
    best = graph.groupBy("page", "source", "score").agg(F.count("*").alias("ties"))
    scored = agreed.join(geometry, EDGE).join(graph.select(*EDGE, "score"), EDGE).join(best, ["page", "source", "score"])
    return scored.where((F.col("geometry") >= least_geometry) & (F.col("score") >= least_graph) & (F.col("ties") == 1)).select(*EDGE, "geometry", F.col("score").alias("graph"))


def stream_partition(elements: DataFrame) -> DataFrame:
    """The stream of each element (page, idx, block, col, wide, segment): its block, the full width, its column, its segment if the page has several, or the body."""
    segments = F.max("segment").over(Window.partitionBy("page")) - F.min("segment").over(Window.partitionBy("page"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    stream = (
        F.when(F.col("block").isNotNull(), name("block", "block")).when(F.col("wide"), "full-width").when(F.col("col").isNotNull(), name("column", "col"))
        .when(segments > 0, name("segment", "segment")).otherwise("body")
    )
    return elements.select("page", "idx", stream.alias("stream"))


def refined_memberships(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ambiguous members (page, idx, rank, region, reason) get the region of both neighbours in order, if these agree and it is one of their candidates (page, idx, region)."""
    w = Window.partitionBy("page").orderBy("rank")
    around = members.withColumn("before", F.lag("region").over(w)).withColumn("after", F.lead("region").over(w))
    agreed = F.when((F.col("reason") == "ambiguous") & (F.col("before") == F.col("after")), F.col("before"))
    known = candidates.select("page", "idx", F.col("region").alias("agreed"), F.lit(True).alias("fits")).distinct()
    out = around.withColumn("agreed", agreed).join(known, ["page", "idx", "agreed"], "left")
    fixed = F.col("fits").isNotNull()
    return out.select("page", "idx", F.when(fixed, F.col("agreed")).otherwise(F.col("region")).alias("region"), F.when(fixed, "continuity").otherwise(F.col("reason")).alias("reason"))


def provider_transitions(matches: DataFrame, anchors: DataFrame) -> DataFrame:
    """Consecutive anchors of a provider (page, anchor, ord) as edges of elements: from the last matched to one to the first matched to the next.

    ``matches``: (page, idx, anchor). Anchors without a match are not bridged.
    """
    ends = matches.groupBy("page", "anchor").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    w = Window.partitionBy("page").orderBy("ord", "anchor")
    placed = anchors.join(ends, ["page", "anchor"], "left").withColumn("target", F.lead("first").over(w))
    return placed.where("last IS NOT NULL AND target IS NOT NULL AND last <> target").select("page", F.col("last").alias("source"), "target")


def chain_streams(chains: DataFrame, assigned: DataFrame, least: int = 2) -> DataFrame:
    """Chains (page, chain, pos, idx) of ``least`` or more elements, none of which has a stream (page, idx), as streams of their own."""
    taken = assigned.select("page", "idx", F.lit(True).alias("taken")).distinct()
    flagged = chains.join(taken, ["page", "idx"], "left")
    whole = Window.partitionBy("page", "chain")
    free = flagged.withColumn("n", F.count("*").over(whole)).withColumn("t", F.count("taken").over(whole)).where((F.col("n") >= least) & (F.col("t") == 0))
    return free.select("page", F.concat(F.lit("chain-"), F.lpad(F.col("chain").cast("string"), 3, "0")).alias("stream"), "idx", "pos")


def branch_features(scored: DataFrame, elements: DataFrame) -> DataFrame:
    """For each source its two best targets (rank 1 and 2 of page, source, target, score, rank): scores, margin, and where both lie."""
    e = scored.where("rank <= 2").join(side(elements, "a_", "idx").withColumnRenamed("a_idx", "source"), ["page", "source"]).join(side(elements, "b_", "idx").withColumnRenamed("b_idx", "target"), ["page", "target"])
    a, b = Box.of("a_"), Box.of("b_")
    at = lambda r, c, n: F.round(F.max(F.when(F.col("rank") == r, c)), 8).alias(n)
    parts = {"score": F.col("score"), "dx": b.center_x - a.center_x, "dy": b.center_y - a.center_y, "gap": b.y0 - a.y1, "shared": horizontal_overlap_ratio(a, b)}
    out = e.groupBy("page", "source").agg(F.count("*").alias("targets"), *[at(r, c, f"{n}_{r}") for n, c in parts.items() for r in (1, 2)])
    return out.withColumn("margin", F.round(F.col("score_1") - F.coalesce("score_2", F.lit(0.0)), 8))


def rescued_edges(selected: DataFrame, base: DataFrame, scores: DataFrame, least: float = 0.95) -> DataFrame:
    """Selected edges, and neighbours of the base order with a score of ``least`` or more where neither end has an edge yet and no cycle comes of it."""
    extra = base.join(scores.select(*EDGE, "score"), EDGE).where(F.col("score") >= least)
    each = selected.select(*EDGE, F.lit(1.0).alias("score"), F.lit(True).alias("protected")).unionByName(extra.select(*EDGE, "score", F.lit(False).alias("protected")))
    both = each.groupBy(*EDGE).agg(F.max_by("score", "protected").alias("score"), F.bool_or("protected").alias("protected"))
    return covers.path_cover(both).where("status = 'selected'").select(*EDGE, F.when(F.col("protected"), "selected").otherwise("rescued").alias("origin"))


def transition_decode(baseline: DataFrame, scored: DataFrame, local: DataFrame, threshold: float) -> DataFrame:
    """A path cover that keeps the baseline's edges inside a column and segment (page, idx, col, segment), and adds edges across them by score from a threshold on."""
    at = lambda end: local.select("page", F.col("idx").alias(end), F.struct("col", "segment").alias(f"{end}_in"))
    inside = lambda df: df.join(at("source"), ["page", "source"]).join(at("target"), ["page", "target"]).withColumn("local", F.col("source_in") == F.col("target_in"))
    kept = inside(baseline).where("local").select(*EDGE, F.lit(1.0).alias("score"), F.lit(True).alias("protected"))
    across = inside(scored).where(~F.col("local") & (F.col("score") >= threshold)).select(*EDGE, "score", F.lit(False).alias("protected"))
    return covers.path_cover(kept.unionByName(across)).where("status = 'selected'").select(*EDGE, "protected")


def caption_edges(captions: DataFrame, targets: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """One-to-one pairs of captions (page, idx, kind, first, last, box) and figures or tables (page, idx, kind, box), as edges.

    A pair is of one kind, within 0.12 page heights and 0.35 page widths. A figure leads to the first line of its caption, the last line of a caption to its table.
    """
    c, t = Box.of("c_"), Box.of("t_")
    joined = side(captions, "c_", "idx", "kind", "first", "last").join(side(targets, "t_", "idx", "kind"), "page").where("c_kind = t_kind")
    dy = F.greatest(F.lit(0.0), F.greatest(c.y0, t.y0) - F.least(c.y1, t.y1)) / page_height
    dx = F.abs(c.center_x - t.center_x) / page_width
    near = joined.where((dy <= 0.12) & (dx <= 0.35)).select("page", F.col("c_idx").alias("left"), F.col("t_idx").alias("right"), F.round(1 - dy - dx, 8).alias("score"))
    pairs = covers.one_to_one(near).select("page", F.col("left").alias("idx"), F.col("right").alias("graphic"))
    known = pairs.join(captions.select("page", "idx", "kind", "first", "last"), ["page", "idx"])
    figure = F.col("kind") == "figure"
    return known.select("page", F.when(figure, F.col("graphic")).otherwise(F.col("last")).alias("source"), F.when(figure, F.col("first")).otherwise(F.col("graphic")).alias("target"), "kind")


def text_parents(elements: DataFrame, regions: DataFrame, page_height: float, least: float = 0.74, margin: float = 0.08) -> DataFrame:
    """Elements (with text) whose best region (page, region, text, box) by 0.7 text + 0.2 nearness + 0.1 coverage is good enough and clearly best.

    Pairs that can reach neither ``least`` nor a score within ``margin`` of it decide nothing, and are not compared by characters.
    """
    e, r = Box.of("e_"), Box.of("r_")
    has_text = F.lower(F.trim(F.coalesce("text", F.lit("")))) != ""
    plain = lambda df: df.withColumn("plain", plain_text(F.col("text"))).withColumn("meaningful", is_meaningful(F.col("plain")))
    gap = F.greatest(F.lit(0.0), F.greatest(e.y0, r.y0) - F.least(e.y1, r.y1)) / page_height
    joined = side(plain(elements.where(has_text)), "e_", "idx", "plain", "meaningful").join(side(plain(regions), "r_", "region", "plain", "meaningful"), "page").where(gap <= 0.1)
    x, y = F.col("e_plain"), F.col("r_plain")
    known = joined.select("page", "e_idx", "r_region", "e_plain", "r_plain", decided_similarity(x, y, F.col("e_meaningful") & F.col("r_meaningful")).alias("decided"), (0.2 * (1 - F.least(F.lit(1.0), 10 * gap))).alias("near"), (0.1 * coverage(e, r)).alias("held"))
    needed = (least - max(margin, 0.0) - 1e-6 - F.col("near") - F.col("held")) / 0.7
    able = known.where(F.coalesce("decided", similarity_bound(x, y)) >= needed)
    score = 0.7 * matched_similarity(F.col("decided"), x, y, needed) + F.col("near") + F.col("held")
    w = Window.partitionBy("page", "e_idx").orderBy(F.desc("score"), "r_region")
    top = able.withColumn("score", F.round(score, 8)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("n", F.row_number().over(w)).where("n = 1")
    return top.where((F.col("score") >= least) & (F.col("score") - F.col("second") >= margin)).select("page", F.col("e_idx").alias("idx"), F.col("r_region").alias("region"), "score")
