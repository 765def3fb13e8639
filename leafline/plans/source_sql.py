"""DuckDB SQL with the results of the source queries, from the plain tables without the payloads that the queries go through."""

from __future__ import annotations

from leafline.plans.layout_sql import ED, EL, VO, q

SPANS = """
w0 AS (SELECT page, idx, string_split(text, ' ') AS ws, x0, y0, x1, y1 FROM el),
ln AS (SELECT page, idx, text, CASE WHEN idx % 9 = 0 THEN 'title' ELSE 'text' END AS type, x0, y0, x1, y1 FROM el WHERE trim(text) <> '')"""
BLOCKS = """
bl AS (SELECT page, CASE page % 3 WHEN 1 THEN 4 ELSE 0 END AS sub, idx AS slot, CASE page % 3 WHEN 1 THEN 'title' ELSE 'text' END AS label, text, CASE WHEN idx % 2 = 0 THEN idx END AS ord,
    CASE WHEN idx % 2 = 0 THEN 'explicit' ELSE 'position' END AS order_source, CASE page % 3 WHEN 1 THEN NULL ELSE 0.5 END::DOUBLE AS confidence, x0 / 2 AS x0, y0 / 2 AS y0, x1 / 2 AS x1, y1 / 2 AS y1
    FROM el WHERE idx % 8 <> 5 AND x1 > x0 AND y1 > y0)"""
SHOWN = """
sh AS (SELECT page, idx AS pos, CASE WHEN idx % 3 = 0 THEN 'title' ELSE 'text' END AS label, x0, y0, x1, y1 FROM el WHERE idx % 10 <> 9)"""
SCORES = """
cc AS (SELECT vo.*, CASE WHEN idx % 9 <> 0 THEN idx % 2 END AS col, median(y1 - y0) OVER (PARTITION BY page) AS line FROM vo),
bd AS (SELECT page, col, min(y0) AS top, max(y1) AS bottom FROM cc WHERE col IS NOT NULL GROUP BY ALL),
pr AS (SELECT a.page, a.idx AS source, b.idx AS target, b.y0 - a.y1 AS gap, greatest(0.08 * 792, 7 * a.line) AS far, a.line, coalesce(a.col = b.col, false) AS same,
    greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(least(greatest(0, a.x1 - a.x0), greatest(0, b.x1 - b.x0)), 1) AS shared, abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) AS apart,
    greatest(24, least(0.42 * greatest(a.x1 - a.x0, b.x1 - b.x0, 0), 0.12 * 612)) AS reach, a.col AS ac, b.col AS bc, b.y0 < a.y0 AS up,
    (a.y1 - p.top) / greatest(1, p.bottom - p.top) AS foot, (b.y0 - r.top) / greatest(1, r.bottom - r.top) AS head, ((b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2) / 612 AS step, b.visual_rank = a.visual_rank + 1 AS next
    FROM cc a JOIN cc b ON a.page = b.page AND a.idx <> b.idx LEFT JOIN bd p ON p.page = a.page AND p.col = a.col LEFT JOIN bd r ON r.page = b.page AND r.col = b.col),
rs AS (SELECT page, source, target, round(CASE WHEN (same OR apart <= reach OR (shared >= 0.65 AND apart <= 0.16 * 612)) AND gap BETWEEN -0.35 * line AND far
        THEN least(1, 0.42::DOUBLE + 0.24::DOUBLE * (1 - least(1, greatest(0, gap) / far)) + 0.18::DOUBLE * least(1, shared) + 0.1::DOUBLE * (1 - least(1, apart / (0.28::DOUBLE * 612))) + CASE WHEN same THEN 0.08::DOUBLE ELSE 0 END)
    WHEN bc > ac AND up AND foot >= 0.55 AND head <= 0.45 AND step > 0.08 THEN least(1, 0.38::DOUBLE + 0.16::DOUBLE * least(1, (foot - 0.5) / 0.5) + 0.16::DOUBLE * least(1, (0.5 - head) / 0.5) + 0.12::DOUBLE * least(1, step / 0.35))
    WHEN next THEN 0.28 END::DOUBLE, 8) AS score FROM pr),
rc0 AS (SELECT * FROM rs WHERE score > 0),
rc AS (SELECT *, row_number() OVER (PARTITION BY page, source ORDER BY score DESC, target) AS rank FROM rc0 QUALIFY row_number() OVER (PARTITION BY page, source ORDER BY score DESC, target) <= 6)"""
COORDS = lambda f: ", ".join(f"{f.format(c=c)} AS {c}" for c in ("x0", "y0", "x1", "y1"))

ORACLES: dict[str, str] = {
    "source_kinds": """SELECT path, CASE WHEN path LIKE '%.pdf' THEN 'pdf' WHEN path LIKE '%.PNG' OR path LIKE '%.jpeg' THEN 'image' END AS kind
        FROM (SELECT 'in/' || source || '/d' || doc_id || ['.pdf', '.PNG', '.tar.gz', '.jpeg', ''][doc_id % 5 + 1] AS path FROM documents)""",
    "lines_of_spans": q(EL, SPANS, "SELECT * FROM ln"),
    "pages_for_ocr": q(EL, "pg AS (SELECT page, count(*) FILTER (page % 3 = 0 AND trim(text) <> '') AS n, round((page / 1000000) % 7 / 7, 6) AS coverage FROM el GROUP BY page)", "SELECT page, coverage, 0.72::DOUBLE AS confidence FROM pg WHERE n = 0 AND coverage >= 0.6"),
    "evidence_rows": q(EL, BLOCKS, "SELECT * FROM bl"),
    "reference_tree": q(EL, """SELECT page, '#/body' AS ref, NULL AS parent, NULL AS pos, NULL AS label FROM el GROUP BY page
        UNION ALL SELECT page, '#/groups/' || (idx // 4), '#/body', idx // 4, 'group' FROM el GROUP BY page, idx // 4
        UNION ALL SELECT page, '#/texts/' || idx, '#/groups/' || (idx // 4), idx % 4, 'text' FROM el WHERE idx % 9 <> 8"""),
    "table_cells": q(EL, "c AS (SELECT page, idx // 12 AS tab, idx % 12 // 3 AS row, idx % 3 AS col, text FROM el WHERE page % 2 = 0 OR idx % 3 < 2)",
        "SELECT page, tab, row, col, row * (max(col) OVER (PARTITION BY page, tab) + 1) + col + 1 AS sub, text FROM c"),
    "display_blocks": q(EL, SHOWN, "SELECT * FROM sh"),
    "display_companions": q(EL, SHOWN, "bx AS (SELECT page, CASE WHEN idx % 6 = 0 THEN 'title' ELSE 'text' END AS label, idx AS ord, " + COORDS("{c} + (idx % 4) * 0.5") + " FROM el)",
        "SELECT s.page, s.pos, s.label, min(b.ord) AS ord, CASE WHEN min(b.ord) IS NOT NULL THEN 0.75 END::DOUBLE AS score FROM sh s LEFT JOIN bx b ON b.page = s.page AND b.label = s.label AND " + " AND ".join(f"abs(s.{c} - b.{c}) <= 1" for c in ("x0", "y0", "x1", "y1")) + " GROUP BY ALL"),
    "stamped_payloads": "SELECT doc_id, 'layout' AS provider, '1.0' AS version, true AS review_only, sha256(coalesce(text, '')) AS digest FROM documents",
    "annotated_images": q(EL, "SELECT page // 1000000 AS doc, page % 1000000 AS image, page % 1000000 * 1000 + idx AS annotation, CASE idx % 3 WHEN 0 THEN 'title' ELSE 'text' END AS category, x0, y0, x1, y1 FROM el WHERE idx % 3 < 2 AND idx % 10 <> 7 AND x1 > x0"),
    "answer_free_inputs": q(EL, "SELECT page, idx, sha256(page || ':' || idx) AS shuffled, idx AS place, idx % 2 AS label FROM el"),
    "pixel_boxes": q(EL, "p AS (SELECT page, idx, " + COORDS("{c} - CASE WHEN idx % 9 = 4 THEN 50 ELSE 0 END") + " FROM el WHERE page % 5 <> 4)",
        "SELECT page, idx, least(greatest(0, x0), 612) AS x0, least(greatest(0, y0), 400) AS y0, least(greatest(0, x1), 612) AS x1, least(greatest(0, y1), 400) AS y1 FROM p"),
    "fixture_order": """SELECT id // 40 AS page, (id % 40 * 7 + id // 40) % 40 AS idx, id % 40 AS place, 'page ' || (id // 40) || ' line ' || (id % 40) AS text, (36 + 280 * (id % 40 // 20))::DOUBLE AS x0, (60 + 30 * (id % 20))::DOUBLE AS y0 FROM (SELECT unnest(range(2000)) AS id)""",
    "document_round_trip": q(EL, "SELECT * FROM el"),
    "svg_shapes": q(EL, """s AS (SELECT page, idx, CASE WHEN greatest(x1 - x0, y1 - y0, 0) / greatest(0.1, least(greatest(0, x1 - x0), y1 - y0)) < 12 THEN printf('<rect x="%.1f" y="%.1f" width="%.1f" height="%.1f"/>', x0, y0, x1 - x0, y1 - y0)
        ELSE printf('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f"/>', x0, y0, x1, y1) END AS t FROM el WHERE idx % 2 = 0)""", "SELECT page, '<g>' || string_agg(t, '' ORDER BY idx) || '</g>' AS svg FROM s GROUP BY page"),
    "svg_paths": q(EL, "SELECT page, idx, printf('M %.2f %.2f L %.2f %.2f C %.2f %.2f %.2f %.2f %.2f %.2f Z', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0) AS path FROM el"),
    "page_xml": q(EL, """t AS (SELECT page, idx, concat_ws(chr(10), text, CASE WHEN idx % 2 = 0 THEN '<' || text || '>' END) AS t FROM el)""",
        """n AS (SELECT page, idx, '<element idx="' || idx || '" role="' || CASE WHEN idx % 9 = 0 THEN 'title' ELSE 'text' END || '">' || replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</element>' AS x FROM t)""",
        """SELECT page, '<page id="' || page || '">' || string_agg(x, '' ORDER BY idx) || '</page>' AS xml FROM n GROUP BY page"""),
    "relation_scores": q(EL, VO, SCORES, "SELECT * FROM rc0"),
    "relation_candidates": q(EL, VO, SCORES, "SELECT * FROM rc"),
    "full_width_elements": q(EL, "sp AS (SELECT page, idx % 2 AS col, min(x0) AS l, max(x1) AS r FROM el WHERE idx % 9 <> 0 AND x1 - x0 < 0.6 * 612 GROUP BY ALL)",
        "SELECT el.page, idx, any_value(x1 - x0 >= 0.6 * 612) AS wide, count(*) FILTER (least(x1, r) - greatest(x0, l) > 0.2 * (r - l)) >= 2 AS crosses FROM el LEFT JOIN sp USING (page) GROUP BY el.page, idx"),
    "review_records": q(EL, VO, ED, SCORES, "mg AS (SELECT *, round(score - lead(score) OVER (PARTITION BY page, source ORDER BY rank), 8) AS margin FROM rc)",
        "SELECT m.page, m.source, m.target, rank, score, margin, ed.page IS NOT NULL AS selected FROM mg m LEFT JOIN ed ON ed.page = m.page AND ed.source = m.source AND ed.target = m.target WHERE rank <= 3 OR ed.page IS NOT NULL"),
    "proposal_digests": q(EL, VO, ED, """SELECT page, count(*) AS edges, sha256('[' || string_agg('{"source":' || source || ',"target":' || target || '}', ',' ORDER BY source, target) || ']') AS digest FROM ed GROUP BY page"""),
    "graphical_gate": q(EL, VO, SCORES, "nx AS (SELECT * FROM (SELECT page, idx AS source, lead(idx) OVER (PARTITION BY page ORDER BY idx) AS target FROM el) WHERE target IS NOT NULL)",
        "nd AS (SELECT page, source AS i FROM nx UNION SELECT page, target FROM nx)",
        "f AS (SELECT floor(score * 5)::BIGINT AS band, page, source, target FROM rc r WHERE rank = 1 AND EXISTS (FROM nd WHERE nd.page = r.page AND i = source) AND EXISTS (FROM nd WHERE nd.page = r.page AND i = target))",
        "SELECT b AS band, (SELECT count(*) FROM f JOIN nx USING (page, source, target) WHERE band = b) AS correct, (SELECT count(*) FROM f WHERE band = b) AS predicted, (SELECT count(*) FROM nx) AS labels FROM (SELECT unnest(range(6)) AS b)"),
}
