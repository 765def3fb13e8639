"""Queries of decisions over evidence, over layout views of the plain tables, with DuckDB SQL; every one reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import covers, decode, matching, order
from leafline.plans.layout_sql import ANCHOR, ED, EL, VO, area, cover, edges, flow, provider, q, regions
from leafline.plans.source_queries import relation_candidates, relation_graph_edges, relation_scores
from leafline.plans.source_sql import SCORES
from leafline.sources import layout
from leafline.sources.layout import PAGE_HEIGHT, PAGE_WIDTH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _el(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_lines(spark, d)


def _visual(spark: SparkSession, d: str) -> DataFrame:
    return order.visual_order(_el(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return order.successor_edges(_visual(spark, d))


@query
def adjacency_scores(spark, d):
    return decode.adjacency_scores(_edges(spark, d), _el(spark, d), PAGE_WIDTH)


@query
def promoted_edges(spark, d):
    e = _el(spark, d)
    orders = [order.successor_edges(order.box_flow_order(e, f), "flow_rank") for f in (-1.0, -0.95)]
    return decode.promoted_edges(orders, decode.adjacency_scores(orders[0], e, PAGE_WIDTH), relation_scores(spark, d))


@query
def stream_partition(spark, d):
    e = _el(spark, d).select(
        "page", "idx", F.when(F.col("idx") % 7 == 3, F.floor(F.col("idx") / 7)).alias("block"), F.when(F.col("idx") % 5 != 4, F.col("idx") % 2).alias("col"),
        (F.col("x1") - F.col("x0") > 500).alias("wide"), F.floor(F.col("y0") / 100).alias("segment"),
    )
    return decode.stream_partition(e)


@query
def refined_memberships(spark, d):
    e = _el(spark, d)
    r = layout.regions(e, 6)
    members = matching.memberships(e, r).join(_visual(spark, d).select("page", "idx", F.col("visual_rank").alias("rank")), ["page", "idx"])
    candidates = matching.side(e, "e_", "idx").join(matching.side(r, "r_", "region"), "page").where("least(e_x1, r_x1) > greatest(e_x0, r_x0) AND least(e_y1, r_y1) > greatest(e_y0, r_y0)")
    return decode.refined_memberships(members, candidates.select("page", F.col("e_idx").alias("idx"), F.col("r_region").alias("region")))


@query
def provider_transitions(spark, d):
    e = _el(spark, d)
    p = layout.provider(e, 2)
    return decode.provider_transitions(matching.anchor_matches(e, p).select("page", "idx", "anchor"), p.select("page", F.col("idx").alias("anchor"), F.col("idx").alias("ord")))


@query
def chain_streams(spark, d):
    e = _el(spark, d)
    chains = e.select("page", F.floor(F.col("idx") / 4).alias("chain"), (F.col("idx") % 4).alias("pos"), "idx")
    return decode.chain_streams(chains, e.where("idx % 11 = 5"))


@query
def branch_features(spark, d):
    return decode.branch_features(relation_candidates(spark, d), _el(spark, d))


@query
def rescued_edges(spark, d):
    selected = relation_graph_edges(spark, d).where("score >= 0.85")
    return decode.rescued_edges(selected, _edges(spark, d), relation_scores(spark, d), 0.6)


@query
def transition_decode(spark, d):
    e = _el(spark, d)
    local = e.select("page", "idx", (F.col("x0") > 300).alias("col"), F.floor(F.col("y0") / 100).alias("segment"))
    return decode.transition_decode(_edges(spark, d), relation_candidates(spark, d), local, 0.5)


@query
def caption_edges(spark, d):
    """Lines that begin a caption and what goes on with it, against every ninth line as a figure or table."""
    e = _el(spark, d).withColumn("text", F.when(F.col("idx") % 13 == 2, F.concat(F.when(F.col("idx") % 2 == 0, "Figure ").otherwise("Table "), "idx", F.lit(" "), "text")).otherwise(F.col("text")))
    lines = covers.caption_lines(e).join(e, ["page", "idx"])
    captions = lines.groupBy("page", F.col("anchor").alias("idx")).agg(
        F.first("kind").alias("kind"), F.min("idx").alias("first"), F.max("idx").alias("last"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")]
    )
    graphics = e.where("idx % 9 = 0").withColumn("kind", F.when(F.col("idx") % 2 == 0, "figure").otherwise("table"))
    return decode.caption_edges(captions, graphics, PAGE_WIDTH, PAGE_HEIGHT)


@query
def text_parents(spark, d):
    e = _el(spark, d)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    named = e.groupBy("page", F.floor(F.col("idx") / 4).alias("region")).agg(text.alias("text"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
    return decode.text_parents(e, named, PAGE_HEIGHT)


ADJACENT = """
li AS (SELECT page, median(y1 - y0) AS line FROM el GROUP BY page),
aj AS (SELECT e.page, e.source, e.target, b.y0 - a.y1 AS gap, line, greatest(12, 6 * line) AS far, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(least(greatest(0, a.x1 - a.x0), greatest(0, b.x1 - b.x0)), 1) AS shared,
    abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) AS apart FROM ed e JOIN el a ON a.page = e.page AND a.idx = e.source JOIN el b ON b.page = e.page AND b.idx = e.target JOIN li ON li.page = e.page),
ad AS (SELECT page, source, target, CASE WHEN gap BETWEEN -0.5 * line AND far THEN round(0.45::DOUBLE * (1 - greatest(0, gap) / far) + 0.35::DOUBLE * least(1, shared) + 0.2::DOUBLE * (1 - least(1, apart / (0.25::DOUBLE * 612))), 8) END AS geometry FROM aj)"""
BRANCH = {
    "score": "score", "dx": "(b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2", "dy": "(b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2", "gap": "b.y0 - a.y1",
    "shared": "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(least(greatest(0, a.x1 - a.x0), greatest(0, b.x1 - b.x0)), 1)",
}

ORACLES: dict[str, str] = {
    "adjacency_scores": q(EL, VO, ED, ADJACENT, "SELECT * FROM ad"),
    "promoted_edges": q(EL, VO, flow(-1.0, name="fa"), edges("fa", "flow_rank", "ed"), flow(-0.95, name="fb"), edges("fb", "flow_rank", "fe"), ADJACENT, SCORES, """SELECT ad.page, ad.source, ad.target, geometry, rc0.score AS graph FROM ad JOIN fe USING (page, source, target) JOIN rc0 USING (page, source, target)
        WHERE geometry >= 0.82 AND rc0.score >= 0.86 AND (SELECT count(*) FROM rc0 o WHERE o.page = ad.page AND o.source = ad.source AND o.score = rc0.score) = 1"""),
    "stream_partition": q(EL, "s AS (SELECT *, max(floor(y0 / 100)) OVER (PARTITION BY page) > min(floor(y0 / 100)) OVER (PARTITION BY page) AS many FROM el)",
        """SELECT page, idx, CASE WHEN idx % 7 = 3 THEN 'block-' || (idx // 7) WHEN x1 - x0 > 500 THEN 'full-width' WHEN idx % 5 <> 4 THEN 'column-' || (idx % 2) WHEN many THEN 'segment-' || floor(y0 / 100)::BIGINT ELSE 'body' END AS stream FROM s"""),
    "refined_memberships": q(EL, VO, regions(6), f"j AS (SELECT e.page, e.idx, r.region, round({cover('e', 'r', '1e-9')}, 8) AS c, {area('r')} AS a, least(e.x1, r.x1) > greatest(e.x0, r.x0) AND least(e.y1, r.y1) > greatest(e.y0, r.y0) AS meets FROM el e JOIN rg r ON e.page = r.page)",
        "t AS (SELECT *, coalesce(lead(c) OVER w, 0) AS second, row_number() OVER w AS n FROM j WINDOW w AS (PARTITION BY page, idx ORDER BY c DESC, a, region))",
        "m AS (SELECT page, idx, CASE WHEN c >= 0.5 AND c - second >= 0.1 THEN region END AS region, CASE WHEN c < 0.5 THEN 'low coverage' WHEN c - second < 0.1 THEN 'ambiguous' ELSE 'member' END AS reason FROM t WHERE n = 1)",
        "o AS (SELECT m.*, lag(region) OVER w AS b, lead(region) OVER w AS f FROM m JOIN vo USING (page, idx) WINDOW w AS (PARTITION BY m.page ORDER BY visual_rank))",
        "x AS (SELECT o.*, reason = 'ambiguous' AND b = f AND EXISTS (FROM j WHERE j.page = o.page AND j.idx = o.idx AND j.region = o.b AND meets) AS fixed FROM o)",
        "SELECT page, idx, CASE WHEN fixed THEN b ELSE region END AS region, CASE WHEN fixed THEN 'continuity' ELSE reason END AS reason FROM x"),
    "provider_transitions": q(EL, provider(2), f"am AS (SELECT e.page, e.idx, p.idx AS anchor FROM el e JOIN pv p ON e.page = p.page WHERE {ANCHOR('e', 'p')} >= 0.45 QUALIFY row_number() OVER (PARTITION BY e.page, e.idx ORDER BY {ANCHOR('e', 'p')} DESC, p.idx) = 1)",
        "en AS (SELECT page, anchor, min(idx) AS f, max(idx) AS l FROM am GROUP BY ALL)", "pl AS (SELECT p.page, l, lead(f) OVER (PARTITION BY p.page ORDER BY p.idx) AS t FROM pv p LEFT JOIN en ON en.page = p.page AND en.anchor = p.idx)",
        "SELECT page, l AS source, t AS target FROM pl WHERE l IS NOT NULL AND t IS NOT NULL AND l <> t"),
    "chain_streams": q(EL, "c AS (SELECT page, idx // 4 AS chain FROM el GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (idx % 11 = 5) = 0)",
        "SELECT el.page, 'chain-' || lpad(chain::VARCHAR, 3, '0') AS stream, idx, idx % 4 AS pos FROM el JOIN c ON c.page = el.page AND c.chain = idx // 4"),
    "branch_features": q(EL, VO, SCORES, "br AS (SELECT r.page, r.source, count(*) AS targets, " + ", ".join(f"round(max({c}) FILTER (rank = {r}), 8) AS {n}_{r}" for n, c in BRANCH.items() for r in (1, 2))
        + " FROM rc r JOIN el a ON a.page = r.page AND a.idx = r.source JOIN el b ON b.page = r.page AND b.idx = r.target WHERE rank <= 2 GROUP BY r.page, r.source)", "SELECT *, round(score_1 - coalesce(score_2, 0), 8) AS margin FROM br"),
}
