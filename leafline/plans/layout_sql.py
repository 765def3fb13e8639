"""DuckDB SQL with the results of the layout queries, written independently of the operators."""

from __future__ import annotations

EL = """
el1 AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
el0 AS (SELECT doc_id * 1000000 + pos // 104 AS page, pos % 104 AS idx, text FROM el1),
el AS (SELECT page, idx::BIGINT AS idx, text, x::DOUBLE AS x0, y::DOUBLE AS y0, (x + w)::DOUBLE AS x1, (y + h)::DOUBLE AS y1 FROM (
    SELECT *, CASE WHEN idx % 9 = 0 THEN 36 ELSE 36 + (idx % 2) * 280 END AS x, 40 + 14 * (idx // 2) + idx % 3 AS y,
           CASE WHEN idx % 9 = 0 THEN 540 ELSE least(260, 6 * length(text)) END AS w, CASE WHEN idx % 9 = 0 THEN 24 WHEN idx % 9 = 8 THEN 8 ELSE 10 END AS h FROM el0))"""


def regions(size: int) -> str:
    return f"rg AS (SELECT page, idx // {size} AS region, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM el GROUP BY ALL)"


def provider(k: int, name: str = "pv") -> str:
    s = f"(((page + idx * 3 + {k}) % 5) - 2)::DOUBLE"
    return f"""{name} AS (SELECT page, idx, text, x0 + {s} AS x0, y0 + {s} AS y0, x1 + {s} AS x1, y1 + {s} AS y1, {k} AS provider,
        1 - ((page * 31 + idx * 17 + {k * 7}) % 10) / 20 AS confidence FROM el WHERE (page * 31 + idx * 17 + {k * 7}) % 10 <> 0)"""


def visual(source: str = "el", name: str = "vo") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / 6, 0) * 6, x0, idx) AS visual_rank FROM {source})"


def edges(source: str = "vo", rank: str = "visual_rank", name: str = "ed") -> str:
    return f"{name} AS (SELECT page, source, target FROM (SELECT page, idx AS source, lead(idx) OVER (PARTITION BY page ORDER BY {rank}) AS target FROM {source}) WHERE target IS NOT NULL)"


def flow(f: float = 0.5, source: str = "el", name: str = "bf") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {1 - f} * x0 + {1 + f} * (y0 + y1), y0, x0, idx) AS flow_rank FROM {source})"


def sha_bucket(expr: str, n: int) -> str:
    return f"(('0x' || substring(sha256({expr}), 1, 8))::BIGINT % {n})"


def degraded(seed: str, name: str = "nz") -> str:
    part = lambda tag: f"({sha_bucket(f"concat_ws(':', '{seed}', '{tag}', page, idx)", 10_000)} / 10000)"
    move = lambda tag: f"round(2.0 * (2 * {part(tag)} - 1), 6)"
    return f"""{name} AS (SELECT page, idx, CASE WHEN mk < 0.05 THEN '' ELSE text END AS text, x0 + dx AS x0, y0 + dy AS y0, x1 + dx AS x1, y1 + dy AS y1 FROM (
        SELECT *, {move("x")} AS dx, {move("y")} AS dy, {part("mask")} AS mk, {part("drop")} AS dr FROM el) WHERE dr >= 0.1)"""


def lo(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def area(a: str) -> str:
    return f"(greatest(0, {a}.x1 - {a}.x0) * greatest(0, {a}.y1 - {a}.y0))"


def cover(a: str, b: str, floor: str = "1") -> str:
    return f"least(1.0, {lo(a, b)} / greatest({area(a)}, {floor}))"


def roles(source: str, name: str) -> str:
    return f"""{name} AS (SELECT page, idx, CASE WHEN y1 <= 0.08 * 792 AND length(text) <= 40 THEN 'artifact'
        WHEN regexp_matches(text, '^\\s*(?:figure|fig\\.?|table|tab\\.?|algorithm)\\s*[0-9]+', 'i') THEN 'caption'
        WHEN y1 - y0 >= 1.4 * m THEN 'heading' WHEN y1 - y0 <= 0.85 * m THEN 'footnote' WHEN length(trim(text)) = 0 THEN 'empty' WHEN text = upper(text) THEN 'emphasis' ELSE 'paragraph' END AS role
        FROM (SELECT *, median(y1 - y0) OVER (PARTITION BY page) AS m FROM {source}))"""


def translated(name: str = "tr") -> str:
    return f"""{name} AS (SELECT page, idx, t AS text, length(t) - length(text) AS added FROM (
        SELECT *, CASE WHEN length(text) >= 2 AND regexp_matches(text, '[A-Za-z]') THEN substring(repeat(text || ' ', 2), 1, ceil(length(text) * 1.3::DOUBLE)::INT) ELSE text END AS t FROM el))"""


SCORED = """
sc AS (SELECT page, source, target, score, row_number() OVER (PARTITION BY page, source ORDER BY score DESC, target) AS rank FROM (
    SELECT a.page, a.idx AS source, b.idx AS target, round(0.45::DOUBLE * (1 - greatest(0, b.y0 - a.y1) / 198.0::DOUBLE)
        + 0.35::DOUBLE * least(1.0, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(least(greatest(0, a.x1 - a.x0), greatest(0, b.x1 - b.x0)), 1.0))
        + 0.2::DOUBLE * (1 / (1 + abs(a.x0 - b.x0) / 36)), 8) AS score
    FROM el a JOIN el b ON a.page = b.page AND a.idx <> b.idx WHERE b.y0 >= a.y0 AND b.y0 - a.y1 <= 198 AND (b.y0 > a.y0 OR b.x0 > a.x0)))"""

NORMAL = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def q(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]


VO = visual()
ED = edges()
BF = flow()
DISAGREE = """
rk AS (SELECT page, idx, visual_rank AS r, flow_rank AS s FROM vo JOIN bf USING (page, idx)),
dp AS (SELECT a.page, count(*) AS pairs, count(*) FILTER (a.s > b.s) AS discordant FROM rk a JOIN rk b ON a.page = b.page AND a.r < b.r GROUP BY a.page),
bk AS (SELECT page, count(*) FILTER (n <> s + 1) AS broken, count(*) AS links FROM (SELECT page, s, lead(s) OVER (PARTITION BY page ORDER BY r) AS n FROM rk) WHERE n IS NOT NULL GROUP BY page)"""
BOTH = "bo AS (SELECT page, idx, text, x0, y0, x1, y1 FROM el UNION ALL SELECT page, idx + 100000, text, x0, y0, x1, y1 FROM pv)"
CO = "co AS (SELECT page, 'visual' AS c, idx, visual_rank AS p FROM vo UNION ALL SELECT page, 'flow', idx, flow_rank FROM bf UNION ALL SELECT page, 'columns', idx, flow_rank FROM bc)"


def prf(found: str, truth: str) -> str:
    return f"""SELECT coalesce(f.page, t.page) AS page, count(*) FILTER (f.page IS NOT NULL AND t.page IS NOT NULL) AS hits, count(f.page) AS found, count(t.page) AS truth,
        round(CASE WHEN count(f.page) > 0 THEN count(*) FILTER (f.page IS NOT NULL AND t.page IS NOT NULL) / count(f.page) ELSE 0 END, 8) AS precision,
        round(CASE WHEN count(t.page) > 0 THEN count(*) FILTER (f.page IS NOT NULL AND t.page IS NOT NULL) / count(t.page) ELSE 0 END, 8) AS recall,
        round(2 * count(*) FILTER (f.page IS NOT NULL AND t.page IS NOT NULL) / (count(f.page) + count(t.page)), 8) AS f1
        FROM {found} f FULL JOIN {truth} t ON f.page = t.page AND f.source = t.source AND f.target = t.target GROUP BY 1"""


ANCHOR = lambda o, p: f"round(0.65::DOUBLE * {cover(o, p)} + 0.2::DOUBLE * least(1.0, 4 * {cover(p, o)}) + 0.15::DOUBLE * (CASE WHEN ({o}.x0 + {o}.x1) / 2 BETWEEN {p}.x0 AND {p}.x1 AND ({o}.y0 + {o}.y1) / 2 BETWEEN {p}.y0 AND {p}.y1 THEN 1 ELSE 0 END), 8)"
STRATA = """
ps0 AS (SELECT page, count(*) FILTER (x1 - x0 < 0.55 * 612 AND x1 <= 306) AS left_lines, count(*) FILTER (x1 - x0 < 0.55 * 612 AND x0 >= 306) AS right_lines, count(*) FILTER (x1 - x0 >= 0.55 * 612) AS wide_lines FROM el GROUP BY page)"""

ORACLES: dict[str, str] = {
    "visual_order": q(EL, VO, "SELECT page, idx, visual_rank FROM vo"),
    "successor_edges": q(EL, VO, ED, "SELECT * FROM ed"),
    "box_flow_order": q(EL, BF, "SELECT page, idx, flow_rank FROM bf"),
    "order_disagreement": q(EL, VO, BF, DISAGREE, "SELECT page, pairs, discordant, broken, round(discordant / pairs, 8) AS pair_disagreement, round(broken / links, 8) AS successor_disagreement FROM dp JOIN bk USING (page)"),
    "flow_segments": q(EL, VO, """SELECT page, idx, sum(n) OVER (PARTITION BY page ORDER BY visual_rank)::BIGINT AS segment FROM (
        SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY page ORDER BY visual_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > greatest(12, 1.4 * median(y1 - y0) OVER (PARTITION BY page)) THEN 1 ELSE 0 END AS n FROM vo)"""),
    "xy_cut_level1": q(EL, """g AS (SELECT page, max(y1) OVER w AS above, lead(y0) OVER (PARTITION BY page ORDER BY y0, y1, idx) AS below, row_number() OVER (PARTITION BY page ORDER BY y0, y1, idx) AS before
        FROM el WINDOW w AS (PARTITION BY page ORDER BY y0, y1, idx ROWS UNBOUNDED PRECEDING))""",
        "SELECT page, before, below - above AS gap, (above + below) / 2 AS cut FROM g WHERE below - above >= 2 QUALIFY row_number() OVER (PARTITION BY page ORDER BY below - above DESC, before) = 1"),
    "column_gap_split": q(EL, "ce AS (SELECT *, (x0 + x1) / 2 AS c FROM el)", "ex AS (SELECT page, max(x1) - min(x0) AS e FROM ce GROUP BY page)",
        "gp AS (SELECT page, c, lead(c) OVER (PARTITION BY page ORDER BY c, idx) AS a FROM ce)",
        "bs AS (SELECT page, a - c AS g, (c + a) / 2 AS s FROM gp WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY a - c DESC, c) = 1)",
        "SELECT ce.page, idx, CASE WHEN c > s THEN 1 ELSE 0 END::BIGINT AS col FROM ce LEFT JOIN (SELECT page, s FROM bs JOIN ex USING (page) WHERE g > 0.1 * e) k ON k.page = ce.page"),
    "x_gap_clusters": q(EL, "SELECT page, idx, sum(n) OVER (PARTITION BY page ORDER BY x0, idx)::BIGINT AS cluster FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, idx) > 12 THEN 1 ELSE 0 END AS n FROM el)"),
    "margin_artifacts": q(EL, "SELECT page, idx, CASE WHEN count(*) OVER (PARTITION BY page) < 6 THEN NULL WHEN y1 <= 0.08 * 792 THEN 'header' WHEN y0 >= 0.92 * 792 THEN 'footer' END AS artifact FROM el"),
    "caption_kinds": q(EL, r"SELECT page, idx, CASE WHEN regexp_matches(text, '^\s*(?:figure|fig\.?)\s*[0-9]+', 'i') THEN 'figure' WHEN regexp_matches(text, '^\s*(?:table|tab\.?)\s*[0-9]+', 'i') THEN 'table' WHEN regexp_matches(text, '^\s*algorithm\s*[0-9]+', 'i') THEN 'algorithm' END AS kind FROM el"),
    "element_roles": q(EL, roles("el", "r"), "SELECT * FROM r"),
    "page_strata": q(EL, STRATA, "SELECT *, CASE WHEN left_lines >= 3 AND right_lines >= 3 AND wide_lines > 0 THEN 'mixed' WHEN left_lines >= 3 AND right_lines >= 3 THEN 'columns' WHEN wide_lines > 0 THEN 'single' ELSE 'sparse' END AS stratum FROM ps0"),
    "region_match": q(EL, regions(4), f"SELECT e.page, e.idx, r.region, round({cover('e', 'r')}, 8) AS coverage FROM el e JOIN rg r ON e.page = r.page WHERE {cover('e', 'r')} >= 0.5 QUALIFY row_number() OVER (PARTITION BY e.page, e.idx ORDER BY {cover('e', 'r')} DESC, {area('r')}, region) = 1"),
    "membership_parent": q(EL, regions(4), f"j AS (SELECT e.page, e.idx, r.region, round({cover('e', 'r', '1e-9')}, 8) AS c, {area('r')} AS a FROM el e JOIN rg r ON e.page = r.page)",
        "t AS (SELECT *, coalesce(lead(c) OVER w, 0) AS second, row_number() OVER w AS n FROM j WINDOW w AS (PARTITION BY page, idx ORDER BY c DESC, a, region))",
        "SELECT page, idx, CASE WHEN c >= 0.5 AND c - second >= 0.1 THEN region ELSE -1 END AS region, c, second, CASE WHEN c < 0.5 THEN 'low coverage' WHEN c - second < 0.1 THEN 'ambiguous' ELSE 'member' END AS reason FROM t WHERE n = 1"),
    "outside_regions": q(EL, regions(4), "SELECT page, idx FROM el e WHERE NOT EXISTS (SELECT 1 FROM rg r WHERE r.page = e.page AND r.region % 2 = 0 AND (e.x0 + e.x1) / 2 BETWEEN r.x0 AND r.x1 AND (e.y0 + e.y1) / 2 BETWEEN r.y0 AND r.y1)"),
    "near_duplicates": q(EL, provider(1), BOTH, f"""SELECT a.page, a.idx AS kept, b.idx AS duplicate FROM bo a JOIN bo b ON a.page = b.page AND a.text = b.text AND a.idx < b.idx WHERE a.text <> ''
        AND least({area('a')}, {area('b')}) > 0 AND {lo('a', 'b')} / least({area('a')}, {area('b')}) >= 0.9 AND least({area('a')}, {area('b')}) / greatest({area('a')}, {area('b')}) >= 0.25"""),
    "fallback_completion": q(EL, provider(1), f"SELECT page, idx, 'main' AS origin, x0, y0 FROM pv UNION ALL SELECT page, idx, 'extra', x0, y0 FROM el e WHERE NOT EXISTS (SELECT 1 FROM pv p WHERE p.page = e.page AND greatest({cover('e', 'p')}, {cover('p', 'e')}) >= 0.6)"),
    "area_suppression": q(EL, provider(1), BOTH, f"SELECT page, idx FROM bo a WHERE EXISTS (SELECT 1 FROM bo b WHERE a.page = b.page AND a.idx <> b.idx AND ({area('b')} > {area('a')} OR ({area('b')} = {area('a')} AND b.idx < a.idx)) AND {cover('a', 'b')} >= 0.82)"),
    "anchor_match_text": q(EL, provider(2), f"m AS (SELECT o.page, o.idx, p.idx AS anchor, {ANCHOR('o', 'p')} AS score FROM el o JOIN pv p ON o.page = p.page)", "SELECT * FROM m WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY page, idx ORDER BY score DESC, anchor) = 1"),
    "mutual_correspondence": q(EL, provider(2), f"m AS (SELECT a.page, a.idx AS l, b.idx AS r, round({lo('a', 'b')} / greatest({area('a')} + {area('b')} - {lo('a', 'b')}, 1e-9), 8) AS iou FROM el a JOIN pv b ON a.page = b.page)",
        "n AS (SELECT *, row_number() OVER (PARTITION BY page, l ORDER BY iou DESC, r) AS f, row_number() OVER (PARTITION BY page, r ORDER BY iou DESC, l) AS g FROM m WHERE iou >= 0.45)", 'SELECT page, l AS "left", r AS "right", iou FROM n WHERE f = 1 AND g = 1'),
    "caption_targets": q(EL, "p AS (SELECT c.page, c.idx AS caption, t.idx AS target, greatest(0, greatest(c.y0, t.y0) - least(c.y1, t.y1)) AS dy, abs((c.x0 + c.x1) / 2 - (t.x0 + t.x1) / 2) AS dx FROM el c JOIN el t ON c.page = t.page WHERE c.idx % 9 = 0 AND t.idx % 9 = 3)",
        "SELECT page, caption, target FROM p WHERE dy <= 0.12 * 792 AND dx <= 0.35 * 612 QUALIFY row_number() OVER (PARTITION BY page, caption ORDER BY dy / 792.0::DOUBLE + dx / 612.0::DOUBLE, target) = 1"),
    "endpoint_resolution": q(EL, "ks AS (SELECT page, 'k' || (idx // 2) AS ref, count(*) AS kn, min(idx) AS ki FROM el WHERE idx % 4 <> 3 GROUP BY ALL)", "al AS (SELECT page, 'k' || idx AS ref, count(*) AS an, min(idx) AS ai FROM el WHERE idx % 3 <> 0 GROUP BY ALL)",
        "SELECT e.page, 'k' || e.idx AS ref, CASE WHEN kn = 1 THEN ki WHEN kn > 1 THEN -1 WHEN an = 1 THEN ai ELSE -1 END AS idx, CASE WHEN kn = 1 THEN 'key' WHEN kn > 1 THEN 'ambiguous key' WHEN an = 1 THEN 'alias' WHEN an > 1 THEN 'ambiguous alias' ELSE 'unresolved' END AS method FROM el e LEFT JOIN ks ON ks.page = e.page AND ks.ref = 'k' || e.idx LEFT JOIN al ON al.page = e.page AND al.ref = 'k' || e.idx"),
    "mutual_neighbours": q(EL, "p AS (SELECT a.page, a.idx AS s, b.idx AS t, b.y0 - a.y1 AS gap, a.x0 AS ax, b.x0 AS bx FROM el a JOIN el b ON a.page = b.page AND a.idx <> b.idx WHERE b.y0 >= a.y1 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY page, s ORDER BY gap, bx, t) AS d, row_number() OVER (PARTITION BY page, t ORDER BY gap, ax, s) AS u FROM p)", "SELECT page, s AS source, t AS target, gap FROM r WHERE d = 1 AND u = 1"),
    "topk_candidates": q(EL, SCORED, "SELECT * FROM sc WHERE rank <= 6"),
    "topology_budget": q(EL, "n AS (SELECT page, greatest(2, least(16, ceil(sqrt(count(*))))) AS budget FROM el GROUP BY page)",
        "p AS (SELECT a.page, a.idx AS s, b.idx AS t, b.x0, b.y0, greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) + greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) AS distance FROM el a JOIN el b ON a.page = b.page AND a.idx <> b.idx)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY page, s ORDER BY distance, y0, x0, t) AS rank FROM p)", "SELECT r.page, s AS source, t AS target, rank, distance FROM r JOIN n ON n.page = r.page WHERE rank <= budget"),
    "corridor_blockers": q(EL, VO, ED, """SELECT e.page, e.source, e.target, count(c.idx) AS blockers FROM ed e JOIN el a ON a.page = e.page AND a.idx = e.source JOIN el b ON b.page = e.page AND b.idx = e.target
        LEFT JOIN el c ON c.page = e.page AND c.idx <> a.idx AND c.idx <> b.idx AND c.y0 >= a.y1 AND c.y1 <= b.y0 AND c.x0 < least(a.x1, b.x1) AND c.x1 > greatest(a.x0, b.x0) GROUP BY ALL"""),
    "provider_segments": q(EL, VO, "g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY page ORDER BY visual_rank) AS gap, median(y1 - y0) OVER (PARTITION BY page) AS m FROM vo)",
        "SELECT page, idx, sum(CASE WHEN gap NOT BETWEEN -0.25 * m AND 1.25 * m THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY visual_rank)::BIGINT AS segment FROM g"),
    "unassigned_runs": q(EL, VO, "f AS (SELECT *, visual_rank - row_number() OVER (PARTITION BY page ORDER BY visual_rank) AS run FROM vo WHERE idx % 5 = 0)", "SELECT page, min(visual_rank) AS first_rank, max(visual_rank) AS last_rank, count(*) AS size FROM f GROUP BY page, run"),
    "stream_index": q(EL, VO, "s AS (SELECT *, CASE WHEN idx % 9 = 0 THEN 'heading' WHEN x0 >= 300 THEN 'right' ELSE 'left' END AS stream FROM vo)", "SELECT page, idx, stream, row_number() OVER (PARTITION BY page, stream ORDER BY visual_rank) AS stream_index FROM s"),
    "provider_consensus": q(EL, *[x for k in (1, 2, 3) for x in (provider(k, f"p{k}"), visual(f"p{k}", f"v{k}"), f"e{k} AS (SELECT page, idx AS source, lead(idx) OVER (PARTITION BY page ORDER BY visual_rank) AS target, confidence, provider FROM v{k})")],
        "SELECT page, source, target, count(DISTINCT provider) AS providers, min(confidence) AS confidence FROM (FROM e1 UNION ALL FROM e2 UNION ALL FROM e3) WHERE target IS NOT NULL GROUP BY ALL HAVING count(DISTINCT provider) >= 2"),
    "consensus_votes": q(EL, VO, BF, flow(-0.5, name="bc"), CO, "e AS (SELECT page, idx AS source, lead(idx) OVER (PARTITION BY page, c ORDER BY p) AS target FROM co)", "v AS (SELECT page, source, target, count(*) AS votes FROM e WHERE target IS NOT NULL GROUP BY ALL)",
        "SELECT page, source, target, votes, votes - coalesce(other, 0) AS regret FROM (SELECT a.page, a.source, a.target, a.votes, max(b.votes) AS other FROM v a LEFT JOIN v b ON a.page = b.page AND a.source = b.source AND a.target <> b.target GROUP BY a.page, a.source, a.target, a.votes)"),
    "shape_components": q(EL, "p AS (SELECT a.page, a.idx AS s, b.idx AS t, b.y0 - a.y1 AS gap, a.x0 AS ax, b.x0 AS bx FROM el a JOIN el b ON a.page = b.page AND a.idx <> b.idx WHERE b.y0 >= a.y1 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY page, s ORDER BY gap, bx, t) AS d, row_number() OVER (PARTITION BY page, t ORDER BY gap, ax, s) AS u FROM p)", "k AS (SELECT page, s, t FROM r WHERE d = 1 AND u = 1 AND gap <= 18 UNION SELECT page, t, s FROM r WHERE d = 1 AND u = 1 AND gap <= 18)",
        "w(page, node, seen) AS (SELECT DISTINCT page, s, s FROM k UNION SELECT w.page, w.node, k.t FROM w JOIN k ON k.page = w.page AND k.s = w.seen)", "SELECT page, node, min(seen) AS root FROM w GROUP BY page, node", recursive=True),
    "tree_preorder": q(EL, "n AS (SELECT page, idx AS node, CASE WHEN idx > 0 THEN (idx - 1) // 3 END AS parent, idx AS pos FROM el)",
        "w(page, node, depth, path) AS (SELECT page, node, 0, [pos] FROM n WHERE parent IS NULL UNION ALL SELECT n.page, n.node, depth + 1, list_append(path, pos) FROM w JOIN n ON n.page = w.page AND n.parent = w.node)",
        "SELECT page, node, depth::BIGINT AS depth, row_number() OVER (PARTITION BY page ORDER BY path, node) AS place FROM w", recursive=True),
    "anchor_paths": q(EL, VO, ED, "a AS (SELECT page, idx FROM el WHERE idx % 6 = 0)",
        "w(page, origin, node, steps) AS (SELECT e.page, source, target, 1 FROM ed e JOIN a ON a.page = e.page AND a.idx = source UNION ALL SELECT w.page, origin, target, steps + 1 FROM w JOIN ed e ON e.page = w.page AND e.source = w.node WHERE w.node % 6 <> 0)",
        "SELECT page, origin, node AS reached, min(steps)::BIGINT AS steps FROM w WHERE node % 6 = 0 GROUP BY ALL", recursive=True),
    "comembership_prf": q(EL, VO, "t AS (SELECT a.page, a.idx AS source, b.idx AS target FROM el a JOIN el b ON a.page = b.page AND a.idx < b.idx AND a.idx // 4 = b.idx // 4)",
        "f AS (SELECT a.page, a.idx AS source, b.idx AS target FROM vo a JOIN vo b ON a.page = b.page AND a.idx < b.idx AND (a.visual_rank - 1) // 4 = (b.visual_rank - 1) // 4)", prf("f", "t")),
    "edge_prf_partial": q(EL, VO, ED, BF, edges("bf", "flow_rank", "t0"), "t AS (SELECT * FROM t0 WHERE source % 4 <> 0)", "n AS (SELECT page, source AS n FROM t UNION SELECT page, target FROM t)",
        "f AS (SELECT e.* FROM ed e WHERE EXISTS (SELECT 1 FROM n WHERE n.page = e.page AND n.n = source) AND EXISTS (SELECT 1 FROM n WHERE n.page = e.page AND n.n = target))", prf("f", "t")),
    "sequence_quality": q(EL, provider(3), visual("pv"), "e AS (SELECT page, text, idx AS e, row_number() OVER (PARTITION BY page, text ORDER BY idx) AS k FROM el)", "a AS (SELECT page, text, visual_rank AS a, row_number() OVER (PARTITION BY page, text ORDER BY visual_rank) AS k FROM vo)",
        "b AS (SELECT page, e, a FROM e FULL JOIN a USING (page, text, k))", "c AS (SELECT page, count(*) FILTER (e IS NOT NULL AND a IS NOT NULL) AS matched, count(*) FILTER (a IS NULL) AS missing, count(*) FILTER (e IS NULL) AS extra FROM b GROUP BY page)",
        "p AS (SELECT x.page, count(*) AS pairs, count(*) FILTER (x.a < y.a) AS concordant FROM b x JOIN b y ON x.page = y.page AND x.e < y.e WHERE x.a IS NOT NULL AND y.a IS NOT NULL GROUP BY x.page)",
        "SELECT page, matched, missing, extra, coalesce(pairs, 0) AS pairs, coalesce(concordant, 0) AS concordant, round(CASE WHEN pairs > 0 THEN concordant / pairs ELSE 1 END, 8) AS pair_accuracy FROM c LEFT JOIN p USING (page)"),
    "kendall_by_slice": q(EL, VO, BF, DISAGREE, "z AS (SELECT dp.*, n FROM dp JOIN bk USING (page) JOIN (SELECT page, count(*) AS n FROM el GROUP BY page) USING (page))",
        "s AS (SELECT 'all' AS slice, * FROM z UNION ALL SELECT 'two', * FROM z WHERE n >= 2 UNION ALL SELECT 'ten', * FROM z WHERE n >= 10)", "SELECT slice, count(*) AS pages, sum(pairs)::BIGINT AS pairs, sum(discordant)::BIGINT AS discordant, round(1 - 2 * sum(discordant) / sum(pairs), 8) AS tau FROM s GROUP BY slice"),
    "confusion_matrix": q(EL, degraded("a"), roles("el", "ra"), roles("nz", "rb"), "SELECT coalesce(ra.role, 'none') AS expected, coalesce(rb.role, 'none') AS actual, count(*) AS n FROM ra FULL JOIN rb ON ra.page = rb.page AND ra.idx = rb.idx GROUP BY 1, 2"),
    "fragment_merge": q(EL, regions(3), f"m AS (SELECT o.page, o.idx, p.region AS anchor, {ANCHOR('o', 'p')} AS score FROM el o JOIN rg p ON o.page = p.page)", "b AS (SELECT * FROM m WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY page, idx ORDER BY score DESC, anchor) = 1)",
        "s AS (SELECT page, count(*) FILTER (n > 1) AS split_units FROM (SELECT page, idx, count(DISTINCT anchor) AS n FROM b GROUP BY ALL) GROUP BY page)",
        "SELECT page, split_units, count(*) FILTER (n > 1) AS merging_anchors, max(n) AS most_merged FROM (SELECT page, anchor, count(DISTINCT idx) AS n FROM b GROUP BY ALL) JOIN s USING (page) GROUP BY page, split_units"),
    "bbox_error_quantiles": q(EL, degraded("b"), "e AS (SELECT el.page % 4 AS slice, round(abs(el.x0 - nz.x0), 6) AS v FROM el JOIN nz ON el.page = nz.page AND el.idx = nz.idx)", "SELECT slice, count(*) AS n, round(avg(v), 8) AS mean, round(median(v), 8) AS median, round(quantile_cont(v, 0.9), 8) AS p90, round(max(v), 8) AS max FROM e GROUP BY slice"),
    "token_f1": q(f"a AS (SELECT id, token, count(*) AS x FROM (SELECT item_id AS id, unnest(string_split({NORMAL.format('text')}, ' ')) AS token FROM benchmark) WHERE token <> '' GROUP BY ALL)",
        f"b AS (SELECT id, token, count(*) AS y FROM (SELECT doc_id AS id, unnest(string_split({NORMAL.format('text')}, ' ')) AS token FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)) WHERE token <> '' GROUP BY ALL)",
        "SELECT id, sum(least(coalesce(x, 0), coalesce(y, 0)))::BIGINT AS common, sum(coalesce(x, 0) + coalesce(y, 0))::BIGINT AS total, round(2 * sum(least(coalesce(x, 0), coalesce(y, 0))) / sum(coalesce(x, 0) + coalesce(y, 0)), 8) AS f1 FROM a FULL JOIN b USING (id, token) GROUP BY id"),
    "degradation_signature": q(EL, degraded("c"), "r AS (SELECT page, round(count(*) FILTER (nz.text IS NULL) / count(*), 8) AS missing, round(count(*) FILTER (nz.text = '' AND el.text <> '') / count(*), 8) AS masked FROM el LEFT JOIN nz USING (page, idx) GROUP BY page)",
        "d AS (SELECT *, unnest([{'d': round(sqrt((missing * missing + masked * masked) / 2), 8), 'p': 'clean'}, {'d': round(sqrt(((missing - 0.08::DOUBLE) ** 2 + (masked - 0.03::DOUBLE) ** 2) / 2), 8), 'p': 'mild'}, {'d': round(sqrt(((missing - 0.2::DOUBLE) ** 2 + (masked - 0.1::DOUBLE) ** 2) / 2), 8), 'p': 'stress'}]) AS k FROM r)",
        "SELECT page, missing, masked, k.p AS profile, k.d AS distance FROM d QUALIFY row_number() OVER (PARTITION BY page ORDER BY k.d, k.p) = 1"),
    "wilson_gate": """WITH c AS (SELECT doc_id % 8 AS slice, sum(quality)::BIGINT AS hits, count(*) AS total FROM labels GROUP BY 1),
        w AS (SELECT *, round(greatest(0, (hits / total + 3.841458820694124::DOUBLE / (2 * total) - 1.959963984540054::DOUBLE * sqrt((hits / total) * (1 - hits / total) / total + 3.841458820694124::DOUBLE / (4 * total * total))) / (1 + 3.841458820694124::DOUBLE / total)), 8) AS lower FROM c)
        SELECT slice, hits, total, round(hits / total, 8) AS precision, lower, lower >= 0.5 AND total >= 10 AS passes FROM w""",
    "threshold_scan": f"""WITH s AS (SELECT round({sha_bucket("doc_id::VARCHAR", 1000)} / 1000 * 0.7::DOUBLE + quality * 0.3::DOUBLE, 6) AS score, quality AS label FROM labels),
        g AS (SELECT unnest(range(21)) AS c)
        SELECT c / 20 AS threshold, count(score) AS selected, coalesce(sum(label), 0)::BIGINT AS hits, round(CASE WHEN count(score) + (SELECT sum(label) FROM s) > 0 THEN 2 * coalesce(sum(label), 0) / (count(score) + (SELECT sum(label) FROM s)) ELSE 0 END, 8) AS f1
        FROM g LEFT JOIN s ON least(floor(score * 20), 20) >= c GROUP BY c""",
    "stratified_rules_cv": f"""WITH f AS (SELECT {sha_bucket("doc_id::VARCHAR", 5)} AS fold, quality AS y, unnest(list_filter([CASE WHEN n_chars > 1000 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN toxic = 0 THEN 'not toxic' END], lambda x: x IS NOT NULL)) AS rule FROM labels JOIN documents USING (doc_id)),
        b AS (SELECT rule, fold, sum(y)::BIGINT AS hits, count(*) AS total FROM f GROUP BY ALL)
        SELECT rule, fold, hits, total, round(hits / total, 8) AS precision, round(CASE WHEN sum(total) OVER w > total THEN (sum(hits) OVER w - hits) / (sum(total) OVER w - total) ELSE 0 END, 8) AS fit_precision FROM b WINDOW w AS (PARTITION BY rule)""",
    "hash_partition": f"WITH b AS (SELECT doc_id, {sha_bucket('doc_id::VARCHAR', 100)} AS b FROM documents) SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'calibration' ELSE 'test' END AS partition FROM b",
    "stratified_sample": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS round FROM documents) SELECT * FROM r ORDER BY round, lang LIMIT 40",
    "noise_profile": q(EL, degraded("n"), "SELECT * FROM nz"),
    "replacement_fit": q(EL, translated(), "g AS (SELECT page, idx, length(tr.text) - length(regexp_replace(tr.text, '[ilj.,:;''!|\\[\\]() ]', '', 'g')) AS na, length(tr.text) - length(regexp_replace(tr.text, '[mwMW@%]', '', 'g')) AS wi, length(tr.text) AS n, x1 - x0 AS w, y1 - y0 AS h FROM el JOIN tr USING (page, idx))",
        "k AS (SELECT *, round(8.0::DOUBLE * (na * 0.28::DOUBLE + wi * 0.85::DOUBLE + (n - na - wi) * 0.52::DOUBLE), 6) AS nat FROM g)",
        "s AS (SELECT *, round(least(1.0, sqrt(w * h / greatest(nat * 8.0::DOUBLE * 1.2::DOUBLE, 1e-9))), 8) AS scale FROM k)", "SELECT page, idx, nat AS natural, greatest(1, ceil(nat / greatest(w, 1)))::BIGINT AS lines, scale, scale < 0.6 AS overflows FROM s"),
    "padding_conflicts": q(EL, "p AS (SELECT a.page, a.idx, greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) AS gx, greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) AS gy, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS ox, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS oy FROM el a JOIN el b ON a.page = b.page AND a.idx < b.idx)",
        "SELECT page, idx, count(*) AS conflicts, max(4 - greatest(gx, gy)) AS undercut FROM p WHERE (ox > 0 AND gy < 4) OR (oy > 0 AND gx < 4) GROUP BY ALL"),
    "pseudo_translation": q(EL, translated(), "SELECT * FROM tr"),
    "apply_edits": q(EL, "SELECT page, idx, CASE WHEN idx % 10 = 0 OR (idx % 5 = 0 AND text = 'old') THEN reverse(text) ELSE text END AS text, CASE WHEN idx % 10 = 0 OR (idx % 5 = 0 AND text = 'old') THEN 'applied' WHEN idx % 5 = 0 THEN 'stale' ELSE 'unchanged' END AS status FROM el"),
    "risk_score": q(EL, STRATA, "r AS (SELECT page, round(wide_lines / (left_lines + right_lines + wide_lines), 8) AS wide, round(abs(left_lines - right_lines) / (left_lines + right_lines + wide_lines), 8) AS uneven FROM ps0)", "k AS (SELECT *, round(0.6::DOUBLE * wide + 0.4::DOUBLE * uneven, 8) AS risk FROM r)",
        "SELECT *, CASE WHEN risk >= 0.35 THEN 'high' WHEN risk >= 0.15 THEN 'medium' ELSE 'low' END AS band FROM k"),
    "html_blocks": """WITH t AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<(h[1-6]|p|li|nav|article|table|img|script)[ >]', 1) AS g FROM pages), u AS (SELECT page_id, unnest(range(len(g))) AS pos, unnest(g) AS tag FROM t)
        SELECT *, CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN 'title' WHEN tag IN ('p', 'li', 'article') THEN 'text' WHEN tag = 'table' THEN 'table' WHEN tag = 'img' THEN 'figure' ELSE 'artifact' END AS role FROM u""",
    "positioned_html": q(EL, """h AS (SELECT page, string_agg(format('<div data-idx="{}" style="left:{:.1f}pt;top:{:.1f}pt;width:{:.1f}pt;height:{:.1f}pt">{}</div>', idx, x0, y0, x1 - x0, y1 - y0, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')), chr(10) ORDER BY idx) AS html FROM el GROUP BY page)""", "SELECT page, md5(html) AS html_md5, length(html) AS n FROM h"),
    "turn_streams": 'SELECT conv_id AS page, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS stream_index FROM conversations',
    "document_revisions": "SELECT user_id AS document_id, event_type AS payload, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "windowed_events": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
