"""DuckDB SQL with the results of the review queries."""

from __future__ import annotations

from leafline.plans.layout_sql import BF, BOTH, CO, EL, VO, area, cover, flow, lo, provider, q, sha_bucket

VOTES = (EL, VO, BF, flow(-0.5, name="bc"), CO, "e AS (SELECT page, c, idx AS source, lead(idx) OVER (PARTITION BY page, c ORDER BY p) AS target FROM co)", "v AS (SELECT page, source, target, count(*) AS votes FROM e WHERE target IS NOT NULL GROUP BY ALL)")
MUTUAL = """mp AS (SELECT a.page, a.idx AS s, b.idx AS t, b.y0 - a.y1 AS gap, a.x0 AS ax, b.x0 AS bx FROM el a JOIN el b ON a.page = b.page AND a.idx <> b.idx WHERE b.y0 >= a.y1 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0),
mr AS (SELECT *, row_number() OVER (PARTITION BY page, s ORDER BY gap, bx, t) AS d, row_number() OVER (PARTITION BY page, t ORDER BY gap, ax, s) AS u FROM mp),
mt AS (SELECT page, s AS source, t AS target FROM mr WHERE d = 1 AND u = 1)"""
WILSON = "round(greatest(0, (hits / predicted + 3.841458820694124::DOUBLE / (2 * predicted) - 1.959963984540054::DOUBLE * sqrt((hits / predicted) * (1 - hits / predicted) / predicted + 3.841458820694124::DOUBLE / (4 * predicted * predicted))) / (1 + 3.841458820694124::DOUBLE / predicted)), 8)"


def profile(name: str, drop: float, jitter: float, mask: float) -> str:
    part = lambda tag: f"({sha_bucket(f"concat_ws(':', 'p', '{tag}', page, idx)", 10_000)} / 10000)"
    dx = f"round({jitter}::DOUBLE * (2 * {part('x')} - 1), 6)"
    return f"SELECT '{name}' AS profile, count(*) AS kept, count(*) FILTER (m < {mask} AND text <> '') AS masked, round(avg(abs(x0 + dx - x0)), 6) AS shift FROM (SELECT *, {part('mask')} AS m, {part('drop')} AS dr, {dx} AS dx FROM el) WHERE dr >= {drop}"


ORACLES: dict[str, str] = {
    "page_range_scan": q(EL, "SELECT page, idx FROM el WHERE page BETWEEN 0 AND 2 OR page = 6 OR page BETWEEN 19 AND 39"),
    "css_colours": q(EL, "h AS (SELECT page, idx, (page * 97 + idx * 131) % 16777216 AS c FROM el)",
        "SELECT page, idx, CASE idx % 3 WHEN 0 THEN round((0.2126::DOUBLE * (c // 65536) + 0.7152::DOUBLE * ((c // 256) % 256) + 0.0722::DOUBLE * (c % 256)) / 255, 8) WHEN 1 THEN round((0.2126::DOUBLE * (page % 256) + 0.7152::DOUBLE * (idx % 256) + 0.0722::DOUBLE * 7) / 255, 8) ELSE -1.0 END::DOUBLE AS luminance FROM h"),
    "complexity_buckets": q(EL, "n AS (SELECT page, count(*) AS n FROM el GROUP BY page)", "SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS pages, sum(n)::BIGINT AS elements FROM n GROUP BY 1"),
    "transition_bands": q(EL, VO, "n AS (SELECT visual_rank - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM vo)", "SELECT CASE WHEN n <= 1 THEN 'single' WHEN i / greatest(n - 1, 1) < 1 / 3 THEN 'start' WHEN i / greatest(n - 1, 1) > 2 / 3 THEN 'end' ELSE 'middle' END AS band, count(*) AS transitions FROM n GROUP BY 1"),
    "consensus_levels": q(*VOTES, "r AS (SELECT page, source, count(*) AS targets, max(votes) AS best FROM v GROUP BY ALL)", "a AS (SELECT page, count(*) AS sources, count(*) FILTER (best = 3) AS unanimous, count(*) FILTER (2 * best > 3) AS majority, count(*) FILTER (targets > 1) AS contested FROM r GROUP BY page)",
        "b AS (SELECT *, round(majority / sources, 8) AS support, round(contested / sources, 8) AS conflict FROM a)", "SELECT *, CASE WHEN support >= 0.9 AND conflict <= 0.25 THEN 'high' WHEN support >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM b"),
    "support_curve": q(*VOTES, MUTUAL, "k AS (SELECT votes, mt.page AS t, unnest(range(1, votes + 1)) AS k FROM v LEFT JOIN mt ON mt.page = v.page AND mt.source = v.source AND mt.target = v.target)",
        "SELECT k, count(*) AS found, count(t) AS hits, (SELECT count(*) FROM mt) AS truth, round(count(t) / count(*), 8) AS precision, round(count(t) / (SELECT count(*) FROM mt), 8) AS recall FROM k GROUP BY k"),
    "stratified_rule_fit": f"""WITH r AS (SELECT lang AS stratum, doc_id % 4 AS s, round({sha_bucket("doc_id::VARCHAR", 100)} / 100, 2) AS c, quality AS y FROM labels JOIN documents USING (doc_id)),
        g AS (SELECT * FROM (VALUES (0), (1), (2)) a(support), (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) b(confidence)),
        k AS (SELECT stratum, support::BIGINT AS support, confidence, count(*) AS predicted, sum(y)::BIGINT AS hits FROM r JOIN g ON s >= support AND c >= confidence GROUP BY ALL),
        w AS (SELECT *, round(hits / predicted, 8) AS precision, {WILSON} AS lower FROM k)
        SELECT * FROM w WHERE precision >= 0.5 AND lower >= 0.4 AND predicted >= 5 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY predicted DESC, lower DESC, precision DESC, support DESC, confidence DESC) = 1""",
    "overlap_diagnostics": q(EL, provider(1), BOTH, f"""p AS (SELECT a.page, round({lo('a', 'b')} / greatest({area('a')} + {area('b')} - {lo('a', 'b')}, 1e-9), 8) AS iou,
        greatest({cover('a', 'b')}, {cover('b', 'a')}) >= 0.9 AND least({area('a')}, {area('b')}) <= 0.25 * greatest({area('a')}, {area('b')}) AS inside FROM bo a JOIN bo b ON a.page = b.page AND a.idx < b.idx)""",
        "SELECT page, count(*) FILTER (iou >= 0.1) AS overlapping, count(*) FILTER (iou >= 0.9) AS copies, count(*) FILTER (inside) AS nested FROM p GROUP BY page"),
    "hierarchy_edges": q(EL, VO, "m AS (SELECT page, idx, idx // 4 AS region, visual_rank AS r, max(visual_rank) OVER (PARTITION BY page, idx // 4) AS l FROM vo)", "n AS (SELECT page, idx AS source, lead(idx) OVER w AS target, region, lead(region) OVER w AS t FROM m WINDOW w AS (PARTITION BY page ORDER BY l, region, r))",
        "SELECT page, source, target, CASE WHEN t = region THEN 'within' ELSE 'across' END AS kind FROM n WHERE target IS NOT NULL"),
    "array_differences": "SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i] - b.embedding[i])::DOUBLE)) / len(a.embedding), 6) AS difference FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "provenance_status": "SELECT doc_id AS key, CASE doc_id % 10 WHEN 1 THEN 'schema' WHEN 2 THEN 'digest format' WHEN 3 THEN CASE WHEN coalesce(text, '') = 'x' THEN 'valid' ELSE 'digest' END WHEN 5 THEN 'missing' WHEN 4 THEN 'reorder' ELSE 'valid' END AS status FROM documents",
    "edit_revisions": q(EL, "s AS (SELECT page, CASE WHEN idx % 10 = 0 OR (idx % 5 = 0 AND text = 'old') THEN 'applied' WHEN idx % 5 = 0 THEN 'stale' ELSE 'unchanged' END AS s FROM el)", "SELECT page, count(*) FILTER (s = 'applied') AS applied, count(*) FILTER (s = 'stale') AS stale, count(*) AS elements FROM s GROUP BY page HAVING count(*) FILTER (s = 'applied') > 0"),
    "text_modes": q(EL, "m AS (SELECT page, idx, text AS s, CASE WHEN idx % 3 = 0 THEN reverse(text) ELSE '' END AS e, CASE WHEN idx % 4 = 0 THEN 't:' || text END AS t FROM el)",
        "SELECT page, idx, s AS source, CASE WHEN e <> '' THEN e ELSE s END AS edited, CASE WHEN coalesce(t, '') <> '' THEN t WHEN e <> '' THEN e ELSE s END AS translated, CASE WHEN e <> '' THEN e ELSE s END || CASE WHEN coalesce(t, '') <> '' THEN chr(10) || t ELSE '' END AS bilingual FROM m"),
    "stale_or_missing_outputs": q(EL, "SELECT page, count(*) AS n FROM el WHERE page % 6 <> 0 GROUP BY page"),
    "degradation_profiles": q(EL, " UNION ALL ".join(profile(*p) for p in (("clean", 0.0, 0.0, 0.0), ("mild", 0.05, 1.0, 0.05), ("stress", 0.2, 4.0, 0.15)))),
}
