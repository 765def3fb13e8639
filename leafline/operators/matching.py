"""Joins of elements with regions, copies and references, within a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.geometry import Box, center_inside, coverage, intersection_area, iou
from leafline.operators.evidence import decided_similarity, is_meaningful, matched_similarity, plain_text, similarity_bound

BOX = ["x0", "y0", "x1", "y1"]


def side(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select("page", *[F.col(c).alias(f"{prefix}{c}") for c in [*BOX, *more]])


def best_regions(elements: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """Each element with the region that covers most of it; smaller regions win ties, then earlier ones."""
    e, r = Box.of("e_"), Box.of("r_")
    joined = side(elements, "e_", "idx").join(side(regions, "r_", "region"), "page").withColumn("coverage", coverage(e, r))
    w = Window.partitionBy("page", "e_idx").orderBy(F.desc("coverage"), r.area, "r_region")
    best = joined.where(F.col("coverage") >= least).withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select("page", F.col("e_idx").alias("idx"), F.col("r_region").alias("region"), F.round("coverage", 8).alias("coverage"))


def best_regions_by_text(elements: DataFrame, regions: DataFrame, least_coverage: float = 0.5, least_similarity: float = 0.45) -> DataFrame:
    """Each element (with text) with its best region (page, region, text, fine, box) by 0.75 coverage + 0.25 similarity of texts, if one of both is enough.

    Ties go to the more similar, then to regions of fine granularity, then to the smaller, then to the earlier. Regions that share
    neither area nor text with an element are not compared.
    """
    e, low = Box.of("e_"), lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    texts = lambda df: df.select("*", low("text").alias("low"), plain_text(F.col("text")).alias("plain")).withColumn("meaningful", is_meaningful(F.col("plain")))
    own = side(texts(elements), "e_", "idx", "low", "plain", "meaningful")
    named = texts(regions).groupBy("page").agg(F.collect_list(F.struct("region", "fine", "low", "plain", "meaningful", *BOX)).alias("regions"))

    def candidate(x: Column) -> Column:
        r = Box(*[x[c] for c in BOX])
        shared, held = coverage(e, r), (F.col("e_low") != "") & F.contains(x["low"], F.col("e_low"))
        decided = decided_similarity(F.col("e_plain"), x["plain"], F.col("e_meaningful") & x["meaningful"])
        bound = F.coalesce(decided, similarity_bound(F.col("e_plain"), x["plain"]))
        return F.when((shared > 0) | held, F.struct(x["region"].alias("region"), x["fine"].alias("fine"), F.when(decided.isNull(), x["plain"]).alias("plain"), r.area.alias("area"), shared.alias("coverage"), decided.alias("decided"), bound.alias("bound")))

    # of the regions of an element those go on that may be the best: none can be that is below the least score of another
    score = lambda coverage, similarity: 0.75 * coverage + 0.25 * similarity
    some = own.join(named, "page").withColumn("some", F.filter(F.transform("regions", candidate), lambda c: c.isNotNull())).drop("regions")
    sure = some.withColumn("sure", F.array_max(F.transform("some", lambda c: score(c["coverage"], F.coalesce(c["decided"], F.lit(0.0))))))
    able = sure.withColumn("c", F.explode(F.filter("some", lambda c: score(c["coverage"], c["bound"]) >= F.col("sure") - 1e-9))).select("page", "e_idx", F.when(F.col("c.decided").isNull(), F.col("e_plain")).alias("e_plain"), "c.*")
    scored = able.withColumn("similarity", matched_similarity(F.col("decided"), F.col("e_plain"), F.col("plain"))).withColumn("score", score(F.col("coverage"), F.col("similarity")))
    w = Window.partitionBy("page", "e_idx").orderBy(F.desc("score"), F.desc("similarity"), F.desc("fine"), F.greatest(F.col("area"), F.lit(1.0)), "region")
    best = scored.withColumn("n", F.row_number().over(w)).where("n = 1")
    kept = best.where((F.col("coverage") >= least_coverage) | (F.col("similarity") >= least_similarity))
    return kept.select("page", F.col("e_idx").alias("idx"), "region", F.round("coverage", 8).alias("coverage"), F.round("similarity", 8).alias("similarity"))


def memberships(elements: DataFrame, regions: DataFrame, least: float = 0.5, margin: float = 0.1) -> DataFrame:
    """Best and second best region of each element; a member only with coverage and margin, else the reason."""
    e, r = Box.of("e_"), Box.of("r_")
    joined = side(elements, "e_", "idx").join(side(regions, "r_", "region"), "page").withColumn("c", F.round(coverage(e, r, 1e-9), 8))
    w = Window.partitionBy("page", "e_idx").orderBy(F.desc("c"), r.area, "r_region")
    top = joined.withColumn("second", F.coalesce(F.lead("c").over(w), F.lit(0.0))).withColumn("n", F.row_number().over(w)).where("n = 1")
    reason = F.when(F.col("c") < least, "low coverage").when(F.col("c") - F.col("second") < margin, "ambiguous").otherwise("member")
    return top.select("page", F.col("e_idx").alias("idx"), F.when(reason == "member", F.col("r_region")).alias("region"), "c", "second", reason.alias("reason"))


def near_duplicate_pairs(elements: DataFrame, least: float = 0.9, area_ratio: float = 0.25) -> DataFrame:
    """Elements of a page with equal text of which the smaller lies in the larger."""
    a, b = Box.of("a_"), Box.of("b_")
    joined = side(elements, "a_", "idx", "text").join(side(elements, "b_", "idx", "text"), "page").where("a_idx < b_idx AND a_text = b_text AND a_text <> ''")
    small = F.least(a.area, b.area)
    share = F.when(small > 0, intersection_area(a, b) / small).otherwise(0.0)
    ratio = F.when(small > 0, small / F.greatest(a.area, b.area)).otherwise(0.0)
    return joined.where((share >= least) & (ratio >= area_ratio)).select("page", F.col("a_idx").alias("kept"), F.col("b_idx").alias("duplicate"))


def without_duplicates(elements: DataFrame, duplicates: DataFrame) -> DataFrame:
    gone = duplicates.select("page", F.col("duplicate").alias("idx")).distinct()
    return elements.join(gone, ["page", "idx"], "left_anti")


def completed(main: DataFrame, extra: DataFrame, least: float = 0.6) -> DataFrame:
    """``main``, and those of ``extra`` that no element of ``main`` covers, or is covered by, to ``least``."""
    a, b = Box.of("a_"), Box.of("b_")
    peers = side(extra, "a_", "idx").join(side(main, "b_"), "page").where(F.greatest(coverage(a, b), coverage(b, a)) >= least)
    lone = extra.join(peers.select("page", F.col("a_idx").alias("idx")).distinct(), ["page", "idx"], "left_anti")
    cols = ["page", "idx", *BOX]
    return main.select(*cols, F.lit("main").alias("origin")).unionByName(lone.select(*cols, F.lit("extra").alias("origin")))


def outside_regions(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """Elements whose centre lies in no region."""
    inside = side(elements, "e_", "idx").join(side(regions, "r_"), "page").where(center_inside(Box.of("e_"), Box.of("r_")))
    return elements.join(inside.select("page", F.col("e_idx").alias("idx")).distinct(), ["page", "idx"], "left_anti")


def anchor_matches(oracle: DataFrame, anchors: DataFrame, least: float = 0.45) -> DataFrame:
    """Many to one: 0.65 coverage + 0.2 min(1, 4 x the anchor's own coverage) + 0.15 if the centre is inside."""
    o, p = Box.of("o_"), Box.of("p_")
    score = 0.65 * coverage(o, p) + 0.2 * F.least(F.lit(1.0), 4 * coverage(p, o)) + 0.15 * center_inside(o, p).cast("double")
    joined = side(oracle, "o_", "idx").join(side(anchors, "p_", "idx"), "page").withColumn("score", F.round(score, 8)).where(F.col("score") >= least)
    w = Window.partitionBy("page", "o_idx").orderBy(F.desc("score"), "p_idx")
    return joined.withColumn("n", F.row_number().over(w)).where("n = 1").select("page", F.col("o_idx").alias("idx"), F.col("p_idx").alias("anchor"), "score")


def mutual_correspondence(a: DataFrame, b: DataFrame, least: float = 0.45) -> DataFrame:
    """Pairs that are best for each other by intersection over union."""
    x, y = Box.of("a_"), Box.of("b_")
    joined = side(a, "a_", "idx").join(side(b, "b_", "idx"), "page").withColumn("iou", F.round(iou(x, y), 8)).where(F.col("iou") >= least)
    forth = Window.partitionBy("page", "a_idx").orderBy(F.desc("iou"), "b_idx")
    back = Window.partitionBy("page", "b_idx").orderBy(F.desc("iou"), "a_idx")
    return joined.withColumn("f", F.row_number().over(forth)).withColumn("g", F.row_number().over(back)).where("f = 1 AND g = 1").select(
        "page", F.col("a_idx").alias("left"), F.col("b_idx").alias("right"), "iou"
    )


def caption_targets(captions: DataFrame, targets: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Each caption with its nearest target within 0.12 page heights and 0.35 page widths."""
    c, t = Box.of("c_"), Box.of("t_")
    dy = F.greatest(F.lit(0.0), F.greatest(c.y0, t.y0) - F.least(c.y1, t.y1))
    dx = F.abs(c.center_x - t.center_x)
    joined = side(captions, "c_", "idx").join(side(targets, "t_", "idx"), "page").where("c_idx <> t_idx")
    near = joined.withColumn("dy", dy).withColumn("dx", dx).where((F.col("dy") <= 0.12 * page_height) & (F.col("dx") <= 0.35 * page_width))
    w = Window.partitionBy("page", "c_idx").orderBy(F.col("dy") / page_height + F.col("dx") / page_width, "t_idx")
    return near.withColumn("n", F.row_number().over(w)).where("n = 1").select("page", F.col("c_idx").alias("caption"), F.col("t_idx").alias("target"))


def resolved_endpoints(references: DataFrame, keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """References (page, ref) with the element their key names; else the one its alias text names; else why not.

    A key or an alias that names several elements names none.
    """
    one = lambda df, col: df.groupBy("page", col).agg(F.count("*").alias("n"), F.min("idx").alias("i"))
    by_key = one(keys, "ref").select("page", "ref", F.col("n").alias("kn"), F.col("i").alias("ki"))
    by_alias = one(aliases, "ref").select("page", "ref", F.col("n").alias("an"), F.col("i").alias("ai"))
    joined = references.join(by_key, ["page", "ref"], "left").join(by_alias, ["page", "ref"], "left")
    method = (
        F.when(F.col("kn") == 1, "key").when(F.col("kn") > 1, "ambiguous key").when(F.col("an") == 1, "alias")
        .when(F.col("an") > 1, "ambiguous alias").otherwise("unresolved")
    )
    return joined.select("page", "ref", F.when(method == "key", F.col("ki")).when(method == "alias", F.col("ai")).alias("idx"), method.alias("method"))


def provider_consensus(edges: DataFrame, least: int = 2) -> DataFrame:
    """Edges (page, source, target, provider, confidence) of at least ``least`` providers, with the least confidence."""
    return (
        edges.groupBy("page", "source", "target")
        .agg(F.count_distinct("provider").alias("providers"), F.min("confidence").alias("confidence"))
        .where(F.col("providers") >= least)
    )


def suppressed_by_area(elements: DataFrame, least: float = 0.82) -> DataFrame:
    """Elements of which a larger one, or an equal earlier one, covers ``least``."""
    a, b = Box.of("a_"), Box.of("b_")
    joined = side(elements, "a_", "idx").join(side(elements, "b_", "idx"), "page").where("a_idx <> b_idx")
    larger: Column = (b.area > a.area) | ((b.area == a.area) & (F.col("b_idx") < F.col("a_idx")))
    return joined.where(larger & (coverage(a, b) >= least)).select("page", F.col("a_idx").alias("idx")).distinct()
