"""DuckDB SQL with the results of the structure queries, from the plain tables without the JSON that the queries go through."""

from __future__ import annotations

from leafline.plans.layout_sql import ANCHOR, BF, ED, EL, VO, area, cover, edges, provider, q, regions, visual

FOLD = "fo AS (SELECT page, idx, x0, y0 % 400 AS y0, x1, y0 % 400 + y1 - y0 AS y1 FROM el)"
FE = edges("bf", "flow_rank", "fe")
TRUTH = "tr AS (SELECT * FROM (SELECT page, idx AS source, lead(idx) OVER (PARTITION BY page ORDER BY idx) AS target FROM el) WHERE target IS NOT NULL AND source % 5 <> 2)"


def clusters(size: str) -> str:
    """Envelope and counts of clusters; positions are over 2 apart, taken from the least."""
    return f"""
ge AS (SELECT page, {size} AS cluster, x0, y0, x1, y1, CASE WHEN greatest(x1 - x0, y1 - y0, 0) / greatest(0.1, least(greatest(0, x1 - x0), greatest(0, y1 - y0))) < 12 THEN 'b' WHEN greatest(0, x1 - x0) >= greatest(0, y1 - y0) THEN 'h' ELSE 'v' END AS g FROM fo),
g1 AS (SELECT page, cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS members, count(*) FILTER (g = 'h') AS h, count(*) FILTER (g = 'v') AS v, count(*) FILTER (g = 'b') AS b,
    min(x0) FILTER (g = 'b') AS fx, max(x0) FILTER (g = 'b') AS lx, min(y0) FILTER (g = 'b') AS fy, max(y0) FILTER (g = 'b') AS ly FROM ge GROUP BY ALL),
g2 AS (SELECT page, cluster, min(ge.x0) FILTER (ge.x0 > fx + 2) AS sx, min(ge.y0) FILTER (ge.y0 > fy + 2) AS sy FROM ge JOIN g1 USING (page, cluster) WHERE g = 'b' GROUP BY ALL),
cl AS (SELECT g1.*, CASE WHEN lx - fx <= 2 THEN 1 WHEN lx - sx <= 2 THEN 2 ELSE 3 END AS cols, CASE WHEN ly - fy <= 2 THEN 1 WHEN ly - sy <= 2 THEN 2 ELSE 3 END AS rows,
    greatest(0, x1 - x0) AS w, greatest(0, y1 - y0) AS ht FROM g1 LEFT JOIN g2 USING (page, cluster))"""


def padded(p: float) -> str:
    return f"greatest(0, least(612, x0 - {p}))::DOUBLE AS x0, greatest(0, least(792, y0 - {p}))::DOUBLE AS y0, greatest(0, least(612, x1 + {p}))::DOUBLE AS x1, greatest(0, least(792, y1 + {p}))::DOUBLE AS y1"


RELATIONS = """
re0 AS (SELECT page, 'successor' AS kind, idx AS s, idx + 1 AS t FROM el WHERE idx % 3 = 0 AND idx < (SELECT max(idx) FROM el z WHERE z.page = el.page)
    UNION SELECT page, CASE WHEN idx % 10 = 0 THEN 'precedence' ELSE 'successor' END, idx, idx + 1 FROM el WHERE idx % 5 = 0 AND idx < (SELECT max(idx) FROM el z WHERE z.page = el.page)
    UNION SELECT page, 'successor', idx, idx + 2 FROM el WHERE idx % 2 = 0 AND idx + 2 <= (SELECT max(idx) FROM el z WHERE z.page = el.page)),
re AS (SELECT r.page, kind, 'e' || s AS source, 'e' || t AS target, CASE WHEN trim(a.text) <> '' THEN a.text END AS source_alias, CASE WHEN trim(b.text) <> '' THEN b.text END AS target_alias
    FROM re0 r JOIN el a ON a.page = r.page AND a.idx = s JOIN el b ON b.page = r.page AND b.idx = t)"""
STREAMS = "ss AS (SELECT page, 'stream-001' AS stream, 'body' AS type, idx // 2 AS pos, 'e' || idx AS ref FROM el WHERE idx % 2 = 0)"
KEYS = """
ke AS (SELECT page, 'e' || idx AS ref, idx FROM el WHERE idx % 7 <> 0 UNION SELECT page, 'e' || idx, idx + 1 FROM el WHERE idx % 11 = 0 UNION SELECT page, lower(trim(text)), idx FROM el WHERE trim(text) <> ''),
ks AS (SELECT page, ref, min(idx) AS f, max(idx) AS l, list(idx) AS ids FROM ke GROUP BY ALL)"""
RESOLVED = """
rr AS (SELECT re.page, kind, re.source AS source_ref, re.target AS target_ref, coalesce(sk.l, sa.l) AS sl, coalesce(sk.ids, sa.ids) AS si, coalesce(tk.f, ta.f) AS tf, coalesce(tk.ids, ta.ids) AS ti,
        (sk.f IS NULL AND sa.f IS NOT NULL) OR (tk.f IS NULL AND ta.f IS NOT NULL) AS by_alias
    FROM re LEFT JOIN ks sk ON sk.page = re.page AND sk.ref = re.source LEFT JOIN ks sa ON sa.page = re.page AND sa.ref = lower(trim(source_alias))
    LEFT JOIN ks tk ON tk.page = re.page AND tk.ref = re.target LEFT JOIN ks ta ON ta.page = re.page AND ta.ref = lower(trim(target_alias))),
rs AS (SELECT *, CASE WHEN sl IS NULL OR tf IS NULL THEN 'unresolved' WHEN list_has_any(si, ti) THEN 'overlap' ELSE 'resolved' END AS status FROM rr),
ro AS (SELECT page, kind, source_ref, target_ref, status, CASE WHEN status = 'resolved' THEN sl END AS source, CASE WHEN status = 'resolved' THEN tf END AS target, by_alias FROM rs)"""


def prf(c: str = "correct", p: str = "predicted", t: str = "labels") -> str:
    return f"round(CASE WHEN {p} > 0 THEN {c} / {p} ELSE 0 END, 8) AS precision, round(CASE WHEN {t} > 0 THEN {c} / {t} ELSE 0 END, 8) AS recall, round(CASE WHEN {p} + {t} > 0 THEN 2 * {c} / ({p} + {t}) ELSE 0 END, 8) AS f1"


def known(edge: str, by: str = "") -> str:
    """Edges whose ends are both ends of labelled edges, set against the labels."""
    return f"""lb AS (SELECT page, source AS i FROM tr UNION SELECT page, target FROM tr),
kn AS (SELECT DISTINCT {by}page, source, target FROM {edge} e WHERE EXISTS (FROM lb WHERE lb.page = e.page AND lb.i = e.source) AND EXISTS (FROM lb WHERE lb.page = e.page AND lb.i = e.target))"""


SCORED = """
sc AS (SELECT ed.*, ((page * 131 + source * 31 + target * 17) % 997) / 997 AS score, source % 6 <> 5 AS scorable, EXISTS (FROM tr WHERE tr.page = ed.page AND tr.source = ed.source AND tr.target = ed.target) AS correct FROM ed)"""
CURVE = f"""
hc AS (SELECT least(floor(score * 500)::INT, 499) AS cell, count(*) AS s, count(*) FILTER (scorable) AS p, count(*) FILTER (scorable AND correct) AS c FROM sc GROUP BY 1),
cu0 AS (SELECT cell / 500 AS threshold, (sum(s) OVER w)::BIGINT AS selected, (sum(p) OVER w)::BIGINT AS predicted, (sum(c) OVER w)::BIGINT AS correct, (SELECT count(*) FROM tr) AS labels FROM hc WINDOW w AS (ORDER BY cell DESC)),
cu AS (SELECT *, {prf()} FROM cu0)"""
SUPPORT = """
ch AS (SELECT page, source, target, count(*) AS support FROM (SELECT *, 1 AS k FROM ed UNION ALL SELECT *, 2 FROM fe) GROUP BY ALL),
ns AS (SELECT p.page, p.source, p.target, coalesce(support, 0) AS support, p.source % 8 <> 7 AND p.target % 8 <> 7 AS scorable,
    CASE WHEN p.source % 8 <> 7 AND p.target % 8 <> 7 THEN EXISTS (FROM tr WHERE tr.page = p.page AND tr.source = p.source AND tr.target = p.target) END AS correct FROM pe p LEFT JOIN ch USING (page, source, target))"""
PE = f"{visual('pv', 'vp')},\n{edges('vp', 'visual_rank', 'pe')}"
WILSON = "greatest(0, (c / p + 3.841458820694124 / (2 * p) - 1.959963984540054 * sqrt(c / p * (1 - c / p) / p + 3.841458820694124 / (4 * p * p))) / (1 + 3.841458820694124 / p))"
RANKS = "nr AS (SELECT page, idx, round((visual_rank - 1) / greatest(count(*) OVER (PARTITION BY page) - 1, 1), 8) AS visual_rank, round((flow_rank - 1) / greatest(count(*) OVER (PARTITION BY page) - 1, 1), 8) AS flow_rank FROM vo JOIN bf USING (page, idx))"


def both(source: str, extra: str = "") -> str:
    return f"{source} e JOIN el a ON a.page = e.page AND a.idx = e.source JOIN el b ON b.page = e.page AND b.idx = e.target{extra}"


def w1(a: str, s: str = "x") -> str:
    return f"greatest({a}.{s}1 - {a}.{s}0, 1.0)"


RELATIVE = {
    **{f"{end}_{c}": f"{a}.{c} / {612 if c[0] == 'x' else 792}" for end, a in (("source", "a"), ("target", "b")) for c in ("x0", "y0", "x1", "y1")},
    "source_width": f"{w1('a')} / 612", "source_height": f"{w1('a', 'y')} / 792", "target_width": f"{w1('b')} / 612", "target_height": f"{w1('b', 'y')} / 792",
    "dx": "((b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2) / 612", "dy": "((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) / 792",
    "abs_dx": "abs((b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2) / 612", "abs_dy": "abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) / 792",
}
SHARE = {s: f"greatest(0, least(a.{s}1, b.{s}1) - greatest(a.{s}0, b.{s}0)) / least({w1('a', s)}, {w1('b', s)})" for s in "xy"}


def rounded(features: dict[str, str]) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 8) AS {k}" for k, v in features.items())


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


ROLE = "CASE WHEN {0}.idx % 9 = 0 THEN 'title' WHEN {0}.idx % 9 = 8 THEN 'note' WHEN {0}.idx % 2 = 0 THEN 'text' ELSE 'aside' END"
ORDER_FEATURES = {
    **RELATIVE, "x_shared": SHARE["x"], "y_shared": SHARE["y"], "below": flag("b.y0 >= a.y0"), "right": flag("b.x0 >= a.x0"), "log_size": "ln(1 + n) / 5",
    **{k: v for r in ("visual_rank", "flow_rank") for k, v in {
        f"{r}_step": f"bn.{r} - an.{r}", f"{r}_forward": flag(f"bn.{r} - an.{r} > 0"), f"{r}_adjacent": flag(f"abs(bn.{r} - an.{r}) <= 1 / greatest(n - 1, 1) + 1e-9")}.items()},
    **{f"{end}_is_{r}": flag(f"{ROLE.format(a)} = '{r}'" if r != "other" else f"{ROLE.format(a)} NOT IN ('title', 'text')") for end, a in (("source", "a"), ("target", "b")) for r in ("title", "text", "other")},
}
END, BEGIN = "right(trim(a.text), 1)", "left(trim(b.text), 1)"
PARAGRAPH = {
    "left_step": "(b.x0 - a.x0) / l", "right_step": "(b.x1 - a.x1) / l", "gap": "(b.y0 - a.y1) / l", "top_step": "(b.y0 - a.y0) / l", "x_shared": SHARE["x"],
    "width_ratio": "least(a.x1 - a.x0, b.x1 - b.x0) / greatest(a.x1 - a.x0, b.x1 - b.x0, 1e-9)", "height_ratio": "least(a.y1 - a.y0, b.y1 - b.y0) / greatest(a.y1 - a.y0, b.y1 - b.y0, 1e-9)",
    "source_left": "a.x0 / 612", "target_left": "b.x0 / 612", "source_width": "(a.x1 - a.x0) / 612", "target_width": "(b.x1 - b.x0) / 612",
    "source_length": "ln(1 + length(trim(a.text)))", "target_length": "ln(1 + length(trim(b.text)))",
    "ends_sentence": flag(f"{END} IN ('.', '!', '?')"), "ends_clause": flag(f"{END} IN (';', ':')"), "ends_open": flag(f"{END} IN (',', '-', chr(173))"),
    "starts_lower": flag(f"regexp_matches({BEGIN}, '[a-zà-öø-ÿ]')"), "starts_upper": flag(f"regexp_matches({BEGIN}, '[A-ZÀ-ÖØ-Þ]')"), "starts_digit": flag(f"regexp_matches({BEGIN}, '[0-9]')"),
    "adjacent": "1.0", "selected": flag("e.target = e.source + 1"), "forward": "e.source % 4 / 4", "reverse": "0.0",
}
LOW = "lower(trim(b.text))"
FLOATING = {
    "is_figure": flag("a.idx % 9 = 3"), "is_table": flag("a.idx % 9 = 5"), **RELATIVE, "x_shared": SHARE["x"], "below": flag("b.y0 >= a.y1"), "above": flag("a.y0 >= b.y1"), "lines": "least(b.idx % 20, 16) / 16",
    "length": f"ln(1 + length({LOW})) / 8", "figure_word": flag(f"starts_with({LOW}, 'figure ') OR starts_with({LOW}, 'fig. ') OR starts_with({LOW}, 'fig ')"), "table_word": flag(f"starts_with({LOW}, 'table ')"),
    "figure_sign": flag(f"starts_with({LOW}, '图 ') OR starts_with({LOW}, '图表 ')"), "table_sign": flag(f"starts_with({LOW}, '表 ')"),
}

ORACLES: dict[str, str] = {
    "shape_classes": q(EL, FOLD, clusters("idx // 4"), """k AS (SELECT *, CASE WHEN members = 1 AND h + v = 1 AND greatest(w, ht) >= 24 AND greatest(w, ht) / greatest(0.1, least(w, ht)) >= 8 THEN 'separator'
        WHEN members >= 4 AND ((h >= 2 AND v >= 2) OR (b >= 4 AND cols >= 2 AND rows >= 2)) THEN 'table' WHEN w >= 24 AND ht >= 24 AND NOT (members = 1 AND h + v = 1) THEN 'figure' END AS kind FROM cl)""",
        "SELECT page, cluster, members, kind, CASE kind WHEN 'separator' THEN 0.9 WHEN 'table' THEN 0.86 WHEN 'figure' THEN CASE WHEN members = 1 THEN 0.76 ELSE 0.82 END END::DOUBLE AS confidence FROM k"),
    "raster_pages": q(EL, FOLD, clusters("0"), f"SELECT page, members, {padded(2.0)} FROM cl WHERE members >= 24 AND h + v >= 4 AND w >= 80 AND ht >= 80 AND w * ht <= 0.7 * 612 * 792"),
    "raster_tables": q(EL, FOLD, clusters("idx // 40"), f"SELECT page, cluster, members, {padded(1.5)} FROM cl WHERE members >= 12 AND ((h >= 4 AND v >= 4) OR (b >= 24 AND cols = 3 AND rows = 3)) AND w >= 80 AND ht >= 40 AND w * ht <= 0.65 * 612 * 792"),
    "image_coverage": q(EL, FOLD, "im AS (SELECT DISTINCT page, x0, y0, x1, y1 FROM fo WHERE idx % 3 = 0)",
        "SELECT page, round(least(1, sum((least(x1, 612) - least(x0, 612)) * (least(y1, 792) - least(y0, 792))) / (612 * 792)), 8) AS coverage FROM im GROUP BY page"),
    "shape_near_pairs": q(EL, """SELECT a.page, a.idx AS source, b.idx AS target FROM el a JOIN el b ON a.page = b.page AND a.idx < b.idx
        WHERE greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 3 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 3"""),
    "table_region_of": q(EL, regions(4), """SELECT e.page, e.idx, min(region) AS region FROM el e JOIN rg r ON e.page = r.page AND region % 2 = 0
        WHERE (e.x0 + e.x1) / 2 BETWEEN r.x0 - 2 AND r.x1 + 2 AND (e.y0 + e.y1) / 2 BETWEEN r.y0 - 2 AND r.y1 + 2 GROUP BY ALL"""),
    "structure_relations": q(EL, RELATIONS, "SELECT * FROM re"),
    "structure_streams": q(EL, STREAMS, "SELECT * FROM ss"),
    "resolved_relations": q(EL, RELATIONS, KEYS, RESOLVED, "SELECT * FROM ro"),
    "relation_statistics": q(EL, RELATIONS, KEYS, RESOLVED, "SELECT kind, status, count(*) AS edges, count(*) FILTER (by_alias) AS by_alias FROM ro GROUP BY ALL"),
    "resolved_streams": q(EL, STREAMS, KEYS, "mm AS (SELECT page, idx, min(pos) AS pos FROM ss JOIN ke USING (page, ref) GROUP BY ALL)",
        "SELECT page, 'stream-001' AS stream, idx, row_number() OVER (PARTITION BY page ORDER BY pos, idx) AS place, false AS conflict FROM mm"),
    "order_companions": q(EL, regions(5), f"""co AS (SELECT e.page, e.idx, region AS block, region // 2 AS ord, round({cover('e', 'r')}, 8) AS coverage, greatest({area('r')}, 1) AS a FROM el e JOIN rg r ON e.page = r.page
        WHERE region % 5 <> 0 AND e.idx % 2 = region % 2 AND CASE WHEN e.idx % 3 = 0 THEN region % 2 = 0 ELSE region % 2 = 1 END AND round({cover('e', 'r')}, 8) >= 0.5)""",
        "SELECT page, idx, arg_max(block, (coverage, -a, -block)) AS block, min(ord) AS ord, arg_max(coverage, (coverage, -a, -block)) AS coverage FROM co GROUP BY page, idx HAVING count(DISTINCT ord) = 1"),
    "tier_edges": q(EL, VO, "ti AS (SELECT page, idx, idx // 3 AS ord, visual_rank AS r FROM vo WHERE idx % 4 <> 1)",
        "en AS (SELECT page, ord, arg_min(idx, r) AS f, arg_max(idx, r) AS l FROM ti GROUP BY ALL)",
        """SELECT page, l AS source, t AS target, 'tier' AS kind FROM (SELECT *, lead(f) OVER (PARTITION BY page ORDER BY ord) AS t FROM en) WHERE t IS NOT NULL
        UNION ALL SELECT page, idx, t, 'inside' FROM (SELECT *, lead(idx) OVER (PARTITION BY page, ord ORDER BY r) AS t FROM ti) WHERE t IS NOT NULL"""),
    "block_streams": q(EL, "bk AS (SELECT page, idx // 4 AS block, count(*) AS members FROM el WHERE idx % 3 <> 1 GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT floor(y0 / 60)) = 1 AND count(DISTINCT x0 > 300) = 1)",
        "SELECT page, block, members, 'block-' || lpad((row_number() OVER (PARTITION BY page ORDER BY block))::VARCHAR, 3, '0') AS stream FROM bk"),
    "stream_parts": q(EL, "c AS (SELECT page, idx % 3 AS stream, idx, CASE WHEN x0 > 300 THEN 'right' WHEN x0 > 36 THEN 'left' END AS col FROM el)",
        "n AS (SELECT *, CASE WHEN lag(idx) OVER w IS NOT NULL AND lag(col) OVER w IS DISTINCT FROM col THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY page, stream ORDER BY idx))",
        "SELECT page, stream, idx, (sum(new) OVER (PARTITION BY page, stream ORDER BY idx))::BIGINT AS part FROM n"),
    "chain_parts": q(EL, """g AS (SELECT page, idx // 12 AS chain, idx, y0 - lag(y1) OVER w AS gap, (x0 + x1 - lag(x0) OVER w - lag(x1) OVER w) / 2 AS dx,
        greatest(0, least(x1, lag(x1) OVER w) - greatest(x0, lag(x0) OVER w)) / least(greatest(x1 - x0, 1), greatest(lag(x1) OVER w - lag(x0) OVER w, 1)) AS shared FROM el WINDOW w AS (PARTITION BY page, idx // 12 ORDER BY idx))""",
        "m AS (SELECT page, chain, list_sort(list(gap)) AS gs FROM g WHERE gap > 0 GROUP BY ALL)",
        """n AS (SELECT g.*, CASE WHEN (abs(dx) > 40 AND shared < 0.25) OR gap < -50 OR (gap > greatest(6, 2.5 * coalesce(gs[len(gs) // 2 + 1], 1)) AND shared >= 0.5) THEN 1 ELSE 0 END AS new FROM g LEFT JOIN m USING (page, chain))""",
        "SELECT page, chain, idx, (sum(new) OVER (PARTITION BY page, chain ORDER BY idx))::BIGINT AS part FROM n"),
    "unique_labels": q(EL, "k AS (SELECT page, lower(trim(text)) AS ref, count(DISTINCT idx) AS n, min(idx) AS i FROM el WHERE trim(text) <> '' GROUP BY ALL)",
        "SELECT DISTINCT e.page, k.ref, CASE WHEN n = 1 THEN i END AS idx FROM el e JOIN k ON k.page = e.page AND k.ref = lower(trim(e.text)) WHERE e.idx % 3 = 0 AND trim(e.text) <> ''"),
    "evidence_by_stem": """SELECT 'in/' || source || '/Doc-' || doc_id || '.pdf' AS path, CASE WHEN doc_id % 3 <> 0 THEN 'evidence/' || source || '/Doc-' || doc_id || '.structure.json'
        WHEN doc_id % 5 = 0 THEN 'other/' || source || '/Doc-' || doc_id || '.json' END AS evidence FROM documents""",
    "stream_types": q(EL, """k AS (SELECT page, idx, CASE WHEN idx % 17 = 3 THEN 'footnote' WHEN idx % 13 = 4 THEN 'page-artifact-running-head' WHEN idx % 13 = 5 THEN 'sidebar-note' WHEN idx % 7 = 2 THEN 'caption-figure'
        WHEN idx % 11 = 6 THEN 'table-island' WHEN idx % 11 = 7 THEN 'grid-island' WHEN idx % 9 = 8 THEN 'table-grid' ELSE 'body' END AS type,
        'segment-' || lpad((CASE WHEN idx % 2 = 0 THEN idx % 4 ELSE 0 END)::VARCHAR, 3, '0') AS seg FROM el)""",
        """SELECT page, idx, type, CASE WHEN type = 'body' THEN 'body-main' WHEN type IN ('table-island', 'grid-island') THEN type || '-' || seg WHEN starts_with(type, 'caption-') THEN type || CASE WHEN idx % 14 = 2 THEN '-target-fig-1' ELSE '-' || seg END ELSE type END AS stream FROM k"""),
    "point_lookup": q(EL, "SELECT * FROM el WHERE page = 1000000 AND idx = 0"),
    "normalized_ranks": q(EL, VO, BF, RANKS, "SELECT * FROM nr"),
    "pair_order_features": q(EL, VO, BF, FE, RANKS, "nn AS (SELECT page, count(*) AS n FROM el GROUP BY page)",
        f"SELECT e.page, e.source, e.target, {rounded(ORDER_FEATURES)} FROM {both('fe', ' JOIN nr an ON an.page = e.page AND an.idx = e.source JOIN nr bn ON bn.page = e.page AND bn.idx = e.target JOIN nn ON nn.page = e.page')}"),
    "paragraph_features": q(EL, VO, ED, f"SELECT e.page, e.source, e.target, {rounded(PARAGRAPH)} FROM (SELECT ed.*, greatest((p.y1 - p.y0 + r.y1 - r.y0) / 2, 1) AS l FROM ed JOIN el p ON p.page = ed.page AND p.idx = ed.source JOIN el r ON r.page = ed.page AND r.idx = ed.target) e JOIN el a ON a.page = e.page AND a.idx = e.source JOIN el b ON b.page = e.page AND b.idx = e.target"),
    "floating_features": q(EL, """nc AS (SELECT c.page, c.idx AS caption, t.idx AS fig, greatest(0, greatest(c.y0, t.y0) - least(c.y1, t.y1)) AS dy, abs((c.x0 + c.x1) / 2 - (t.x0 + t.x1) / 2) AS dx
        FROM el c JOIN el t ON c.page = t.page AND c.idx % 9 = 0 AND t.idx % 9 IN (3, 5))""",
        "e AS (SELECT page, fig AS source, caption AS target FROM nc WHERE dy <= 0.12 * 792 AND dx <= 0.35 * 612 QUALIFY row_number() OVER (PARTITION BY page, caption ORDER BY dy / 792 + dx / 612, fig) = 1)",
        f"SELECT e.page, e.source, e.target, {rounded(FLOATING)} FROM {both('e').replace('e e', 'e', 1)}"),
    "borda_order": q(EL, VO, "pw AS (SELECT a.page, a.idx AS source, b.idx AS target, round(0.5 + 0.1 * (b.visual_rank - a.visual_rank) + (a.idx * 7 + b.idx) % 5 / 50, 6) AS p FROM vo a JOIN vo b ON a.page = b.page AND b.visual_rank <> a.visual_rank AND b.visual_rank BETWEEN a.visual_rank - 3 AND a.visual_rank + 3)",
        "s AS (SELECT x.page, x.source AS idx, round(sum((x.p + 1 - y.p) / 2), 8) AS score FROM pw x JOIN pw y ON x.page = y.page AND x.source = y.target AND x.target = y.source GROUP BY ALL)",
        "SELECT vo.page, vo.idx, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY vo.page ORDER BY coalesce(score, 0) DESC, visual_rank) AS place FROM vo LEFT JOIN s USING (page, idx)"),
    "paragraph_candidates": q(EL, VO, ED, BF, FE, """nb AS (SELECT a.page, a.idx AS source, b.idx AS target FROM el a JOIN el b ON a.page = b.page AND a.idx <> b.idx AND b.y0 >= a.y1 AND floor(b.y0 / 120) - floor(a.y0 / 120) IN (0, 1)
        AND least(a.x1, b.x1) > greatest(a.x0, b.x0) QUALIFY row_number() OVER (PARTITION BY a.page, a.idx ORDER BY b.y0 - a.y1, b.x0, b.idx) <= 3)""", "SELECT * FROM nb UNION SELECT * FROM ed UNION SELECT * FROM fe"),
    "page_profiles": q(EL, VO, BF, "ro AS (SELECT page, CASE WHEN idx % 9 = 0 THEN 'title' WHEN idx % 9 = 8 THEN 'note' ELSE 'text' END AS role, count(*) AS n FROM el GROUP BY ALL)",
        "en AS (SELECT page, sum(-p * log2(p)) AS role_entropy, max(p) AS main_role_share FROM (SELECT page, n / sum(n) OVER (PARTITION BY page) AS p FROM ro) GROUP BY page)",
        "rk AS (SELECT page, visual_rank AS r, flow_rank AS s FROM vo JOIN bf USING (page, idx))",
        "di AS (SELECT page, round(count(*) FILTER (n <> s + 1) / count(*), 8) AS d FROM (SELECT page, s, lead(s) OVER (PARTITION BY page ORDER BY r) AS n FROM rk) WHERE n IS NOT NULL GROUP BY page)",
        "si AS (SELECT page, ln(1 + count(*)) AS log_count, " + ", ".join(f"quantile_cont({x}, {p}) AS {n}_q{int(100 * p)}" for n, x in (("width", "x1 - x0"), ("height", "y1 - y0"), ("area", "(x1 - x0) * (y1 - y0)")) for p in (0.1, 0.5, 0.9)) + ", avg((x1 - x0) / greatest(y1 - y0, 1)) AS aspect FROM el GROUP BY page)",
        "SELECT page, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["log_count", *[f"{n}_q{p}" for n in ("width", "height", "area") for p in (10, 50, 90)], "aspect", "role_entropy", "main_role_share"]) + ", round(coalesce(d, 0), 6) AS flow_disagreement FROM si JOIN en USING (page) LEFT JOIN di USING (page)"),
    "edge_report_by_provider": q(EL, TRUTH, *[x for k in (1, 2, 3) for x in (provider(k, f"p{k}"), visual(f"p{k}", f"v{k}"), edges(f"v{k}", "visual_rank", f"e{k}"))],
        "al AS (SELECT 1 AS provider, * FROM e1 UNION ALL SELECT 2, * FROM e2 UNION ALL SELECT 3, * FROM e3)", known("al", "provider, "),
        "c AS (SELECT provider, count(*) AS predicted, count(tr.page) AS correct, (SELECT count(*) FROM tr) AS labels FROM kn LEFT JOIN tr USING (page, source, target) GROUP BY provider)",
        f"SELECT *, {prf()} FROM c"),
    "corpus_report": q(EL, VO, ED, TRUTH, "pc AS (SELECT page, count(*) FILTER (p AND t) AS correct, count(p) AS predicted, count(t) AS labels FROM (SELECT *, true AS p FROM ed) FULL JOIN (SELECT *, true AS t FROM tr) USING (page, source, target) GROUP BY page)",
        f"pf AS (SELECT *, {prf()} FROM pc)", "su AS (SELECT count(*) AS pages, sum(correct)::BIGINT AS correct, sum(predicted)::BIGINT AS predicted, sum(labels)::BIGINT AS labels, round(avg(f1), 8) AS macro_f1, arg_min(page, (f1, page)) AS worst_page, count(*) FILTER (f1 = 1) AS exact_pages FROM pf)",
        f"SELECT *, {prf()} FROM su"),
    "membership_report": q(EL, regions(4), f"be AS (SELECT e.page, e.idx, r.region FROM el e JOIN rg r ON e.page = r.page WHERE {cover('e', 'r')} >= 0.5 QUALIFY row_number() OVER (PARTITION BY e.page, e.idx ORDER BY {cover('e', 'r')} DESC, {area('r')}, region) = 1)",
        "mb AS (SELECT page, idx, idx // 4 AS t, region AS p FROM el LEFT JOIN be USING (page, idx))",
        "SELECT a.page, count(*) AS labelled, count(a.p) AS assigned, count(*) FILTER (b.t = a.t) AS within, count(*) FILTER (b.t = a.t AND a.p = b.p) AS within_kept, count(*) FILTER (b.t <> a.t) AS across, count(*) FILTER (b.t <> a.t AND a.p IS DISTINCT FROM b.p OR b.t <> a.t AND a.p IS NULL) AS across_kept FROM mb a LEFT JOIN mb b ON a.page = b.page AND b.idx = a.idx + 1 GROUP BY a.page"),
    "pair_report": q(EL, "pp AS (SELECT a.page, a.idx AS i, b.idx AS j, a.idx // 4 = b.idx // 4 AS t, a.idx % 6 <> 5 AND b.idx % 6 <> 5 AND a.idx // 3 = b.idx // 3 AS p FROM el a JOIN el b ON a.page = b.page AND a.idx < b.idx AND b.idx < a.idx + 4)",
        "cn AS (SELECT page, count(*) FILTER (t AND p) AS correct, count(*) FILTER (p) AS predicted, count(*) FILTER (t) AS labels FROM pp GROUP BY page)",
        f"SELECT el.page, coalesce(any_value(correct), 0) AS correct, coalesce(any_value(predicted), 0) AS predicted, coalesce(any_value(labels), 0) AS labels, {prf('coalesce(any_value(correct), 0)', 'coalesce(any_value(predicted), 0)', 'coalesce(any_value(labels), 0)')} FROM el LEFT JOIN cn USING (page) GROUP BY el.page"),
    "native_support": q(EL, VO, ED, BF, FE, provider(2), PE, TRUTH, SUPPORT, "SELECT * FROM ns"),
    "support_gate": q(EL, VO, ED, BF, FE, provider(2), PE, TRUTH, SUPPORT, "lv AS (SELECT support, count(*) AS n, count(*) FILTER (correct) AS k FROM ns WHERE scorable GROUP BY support)",
        "cv AS (SELECT support, (sum(n) OVER (ORDER BY support DESC))::BIGINT AS p, (sum(k) OVER (ORDER BY support DESC))::BIGINT AS c FROM lv)",
        f"SELECT support, p AS predicted, c AS correct, round(c / p, 8) AS precision, round({WILSON}, 8) AS wilson, round(c / p, 8) >= 0.3 AND round({WILSON}, 8) >= 0.2 AND p >= 20 AS passes FROM cv"),
    "kind_report": q(EL, provider(2), f"hi AS (SELECT DISTINCT e.page, e.idx FROM el e JOIN pv p ON e.page = p.page WHERE {ANCHOR('e', 'p')} >= 0.45)",
        "kd AS (SELECT CASE WHEN idx % 9 = 3 THEN 'figure' WHEN idx % 9 = 5 THEN 'table' ELSE 'text' END AS kind, CASE WHEN page % 4 = 0 THEN 'test' ELSE 'fit' END AS partition, hi.page IS NOT NULL AS matched FROM el LEFT JOIN hi USING (page, idx))",
        "SELECT coalesce(kind, 'all') AS kind, coalesce(partition, 'all') AS partition, count(*) AS anchors, count(*) FILTER (matched) AS matched, round(count(*) FILTER (matched) / count(*), 8) AS rate FROM kd GROUP BY CUBE (kind, partition)"),
    "relation_audit": q(EL, BF, FE, TRUTH, """SELECT coalesce(a.page, b.page) AS page, coalesce(a.source, b.source) AS source, a.target AS label, b.target AS proposal,
        CASE WHEN a.target IS NULL THEN 'extra' WHEN b.target IS NULL THEN 'missing' WHEN a.target = b.target THEN 'agrees' ELSE 'differs' END AS status
        FROM (FROM tr WHERE source % 3 = 0) a FULL JOIN (FROM fe WHERE source % 2 = 0) b ON a.page = b.page AND a.source = b.source"""),
    "difference_summary": """WITH d AS (SELECT doc_id AS page, CASE WHEN doc_id % 50 <> 7 THEN (doc_id * 37 % 1000) / 20000 END AS diff, coalesce(CASE WHEN doc_id % 50 <> 7 THEN (doc_id * 37 % 1000) / 20000 END, 1) AS x FROM documents)
        SELECT count(*) AS pages, max(x)::DOUBLE AS most, round(avg(x), 8) AS mean, arg_max(page, (x, -page)) AS worst_page, count(*) FILTER (x > 0.02) AS mismatched, count(*) FILTER (diff IS NULL) AS unmatched FROM d""",
    "totals_by_stream": q(EL, "s AS (SELECT *, greatest(0.62, round((x1 - x0) / greatest(1, 5.2 * length(text)), 6)) AS scale FROM el)",
        "SELECT idx % 3 AS stream, count(*) AS elements, count(*) FILTER (scale < 0.7) AS overflows, count(*) FILTER (idx % 5 = 0) AS conflicts, count(*) FILTER (length(text) > 40) AS masked, min(scale)::DOUBLE AS least_scale FROM s GROUP BY 1"),
    "threshold_curve": q(EL, VO, ED, TRUTH, SCORED, CURVE, "SELECT * FROM cu"),
    "best_threshold": q(EL, VO, ED, TRUTH, SCORED, CURVE, "SELECT * FROM cu WHERE precision >= 0.3 AND predicted >= 20 ORDER BY f1 DESC, precision DESC, threshold LIMIT 1"),
    "noise_gate": q(EL, VO, ED, TRUTH, SCORED, "th AS (SELECT CASE page % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'mild' ELSE 'stress' END AS profile, k / 10 AS threshold, count(*) FILTER (scorable AND score >= k / 10) AS p, count(*) FILTER (scorable AND correct AND score >= k / 10) AS c, count(*) AS labels FROM sc, (SELECT unnest(range(1, 10)) AS k) GROUP BY ALL)",
        "pr AS (SELECT *, round(CASE WHEN p > 0 THEN c / p ELSE 0 END, 8) AS precision FROM th)",
        "g AS (SELECT threshold, min(c) AS least_correct, sum(c)::BIGINT AS correct, min(precision) AS least_precision FROM pr GROUP BY threshold HAVING bool_and(precision >= 0.3 AND p >= greatest(25, ceil(0.01 * labels))))",
        "SELECT threshold::DOUBLE AS threshold, least_correct, correct, least_precision FROM g ORDER BY least_correct DESC, correct DESC, least_precision DESC, threshold LIMIT 1"),
    "best_candidate": """WITH t AS (SELECT doc_id, k AS setting, ((doc_id * 7 + k * 3) % 4) / 4 AS sim, k % 3 AS cost, (doc_id + k) % 5 AS sec FROM documents, (SELECT unnest(range(6)) AS k))
        SELECT doc_id, arg_max(setting, (sim, -cost, -sec, -setting)) AS setting, max(sim)::DOUBLE AS similarity FROM t GROUP BY doc_id""",
    "model_comparison": q(EL, VO, ED, BF, FE, TRUTH, provider(1), PE, "al AS (SELECT 'a visual' AS model, * FROM ed UNION ALL SELECT 'b flow', * FROM fe UNION ALL SELECT 'c provider', * FROM pe)", known("al", "model, "),
        "c AS (SELECT model, count(tr.page) AS correct, count(*) AS predicted, (SELECT count(*) FROM tr) AS labels FROM kn LEFT JOIN tr USING (page, source, target) GROUP BY model)",
        f"r AS (SELECT *, {prf()} FROM c)", "SELECT *, round(f1 - first(f1) OVER (ORDER BY model), 8) AS gain FROM r"),
    "page_alignment": q(EL, "wo AS (SELECT page AS doc, idx, unnest(string_split(lower(text), ' ')) AS token FROM el)",
        "a AS (SELECT doc, idx // 4 AS page, token, count(*) AS n FROM wo WHERE token <> '' GROUP BY ALL)", "b AS (SELECT doc, (idx - 2) // 4 AS page, token, count(*) AS n FROM wo WHERE token <> '' AND idx >= 2 GROUP BY ALL)",
        "cm AS (SELECT a.doc, a.page, b.page AS other, sum(least(a.n, b.n)) AS common FROM a JOIN b ON a.doc = b.doc AND a.token = b.token GROUP BY ALL)",
        "sa AS (SELECT doc, page, sum(n) AS na FROM a GROUP BY ALL)", "sb AS (SELECT doc, page AS other, sum(n) AS nb FROM b GROUP BY ALL)",
        "sf AS (SELECT *, round(2 * common / (na + nb), 8) AS f1 FROM cm JOIN sa USING (doc, page) JOIN sb USING (doc, other))",
        "tp AS (SELECT *, coalesce(lead(f1) OVER w, 0) AS second, row_number() OVER w AS r FROM sf WINDOW w AS (PARTITION BY doc, page ORDER BY f1 DESC, common DESC, other))",
        "rz AS (SELECT *, CASE WHEN common < 3 THEN 'few tokens' WHEN f1 < 0.5 THEN 'low f1' WHEN f1 - second < 0.05 THEN 'ambiguous' ELSE 'aligned' END AS reason FROM tp WHERE r = 1)",
        "SELECT doc, page, CASE WHEN reason = 'aligned' THEN other ELSE page END AS aligned, f1, second::DOUBLE AS second, reason FROM rz"),
}
