"""DuckDB SQL with the results of the evidence queries."""

from __future__ import annotations

from leafline.plans.layout_sql import BF, ED, EL, STRATA, VO, edges, flow, provider, q, roles, sha_bucket, visual

BLOCKS = """
bl AS (SELECT page, idx AS slot, CASE WHEN idx % 9 = 0 THEN 'title' WHEN idx % 9 = 8 THEN 'table' ELSE 'text' END AS type, text,
    CASE WHEN idx % 7 = 5 THEN 'no box' WHEN least(x1, 612) <= least(x0, 612) OR least(y1, 792) <= least(y0, 792) THEN 'no area' WHEN trim(text) = '' THEN 'no text' ELSE 'valid' END AS reason,
    CASE WHEN idx % 7 = 5 THEN 0 ELSE least(x0, 612) END AS x0, CASE WHEN idx % 7 = 5 THEN 0 ELSE least(greatest(0, y0), 792) END AS y0,
    CASE WHEN idx % 7 = 5 THEN 0 ELSE least(x1, 612) END AS x1, CASE WHEN idx % 7 = 5 THEN 0 ELSE least(greatest(0, y1), 792) END AS y1 FROM el)"""
STREAMS = "st AS (SELECT *, CASE WHEN idx % 9 = 0 THEN 'heading' WHEN x0 >= 300 THEN 'right' ELSE 'left' END AS stream FROM vo)"
BASE = flow(-0.5, name="bz")


def disagree(rank: str, source: str, name: str) -> str:
    return f"""{name}r AS (SELECT page, idx, bz.flow_rank AS r, c.{rank} AS s FROM bz JOIN {source} c USING (page, idx)),
{name}d AS (SELECT a.page, count(*) AS pairs, count(*) FILTER (a.s > b.s) AS discordant FROM {name}r a JOIN {name}r b ON a.page = b.page AND a.r < b.r GROUP BY a.page),
{name}b AS (SELECT page, count(*) FILTER (n <> s + 1) AS broken FROM (SELECT page, s, lead(s) OVER (PARTITION BY page ORDER BY r) AS n FROM {name}r) WHERE n IS NOT NULL GROUP BY page),
{name} AS (SELECT * FROM {name}d JOIN {name}b USING (page))"""


def nearest(k: int) -> str:
    return f"""pf AS (SELECT * FROM (SELECT a.page, a.idx AS source, b.idx AS target, (b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2 AS dx, (b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2 AS dy,
        greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) AS gap_x, greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) AS gap_y,
        greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(least(greatest(0, a.x1 - a.x0), greatest(0, b.x1 - b.x0)), 1) AS overlap_x,
        (b.visual_rank - a.visual_rank)::DOUBLE AS rank_gap, b.x0 AS bx, b.y0 AS byy FROM vo a JOIN vo b ON a.page = b.page AND a.idx <> b.idx)
        QUALIFY row_number() OVER (PARTITION BY page, source ORDER BY gap_x + gap_y, byy, bx, target) <= {k})"""


ORACLES: dict[str, str] = {
    "bottom_left_blocks": q(EL, BLOCKS, "SELECT * FROM bl"),
    "slot_successors": q(EL, BLOCKS, "SELECT page, slot AS source, t AS target FROM (SELECT page, slot, reason, lead(slot) OVER w AS t, lead(reason) OVER w AS r FROM bl WINDOW w AS (PARTITION BY page ORDER BY slot)) WHERE reason = 'valid' AND r = 'valid'"),
    "block_reject_reasons": q(EL, BLOCKS, "SELECT type, reason, count(*) AS n FROM bl GROUP BY ALL"),
    "parallel_array_blocks": q(EL, "SELECT page, idx AS pos, text, (idx % 10) / 10 AS score, x0, y0, x1, y1 FROM el"),
    "body_tree_runs": q(EL, "t AS (SELECT page, idx // 25 AS parent, idx AS pos FROM el WHERE idx % 9 NOT IN (0, 8))", "g AS (SELECT *, pos - row_number() OVER (PARTITION BY page, parent ORDER BY pos) AS r FROM t)",
        'SELECT page, parent, min(pos) AS "first", max(pos) AS "last", count(*) AS members FROM g GROUP BY page, parent, r HAVING count(*) >= 2'),
    "sidecar_edges": q(EL, VO, STREAMS, """n AS (SELECT page, idx, stream, lead(idx) OVER (PARTITION BY page, stream ORDER BY visual_rank) AS own, lead(idx) OVER w AS nxt, lead(stream) OVER w AS ns FROM st WINDOW w AS (PARTITION BY page ORDER BY visual_rank))""",
        "SELECT page, idx AS source, own AS target, 'successor' AS kind FROM n WHERE own IS NOT NULL UNION ALL SELECT page, idx, nxt, 'review' FROM n WHERE nxt IS NOT NULL AND ns <> stream"),
    "stream_confusion": q(EL, VO, STREAMS, provider(1), "ce AS (SELECT *, (x0 + x1) / 2 AS c FROM pv)", "ex AS (SELECT page, max(x1) - min(x0) AS e FROM ce GROUP BY page)", "gp AS (SELECT page, c, lead(c) OVER (PARTITION BY page ORDER BY c, idx) AS a FROM ce)",
        "bs AS (SELECT page, a - c AS g, (c + a) / 2 AS s FROM gp WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY a - c DESC, c) = 1)",
        "ac AS (SELECT ce.page, idx, CASE WHEN c > s THEN 'right' ELSE 'left' END AS actual FROM ce LEFT JOIN (SELECT page, s FROM bs JOIN ex USING (page) WHERE g > 0.1 * e) k ON k.page = ce.page)",
        "SELECT coalesce(stream, 'none') AS expected, coalesce(actual, 'none') AS actual, count(*) AS n FROM st FULL JOIN ac ON st.page = ac.page AND st.idx = ac.idx GROUP BY 1, 2"),
    "relation_quality": q(EL, VO, BF, edges("bf", "flow_rank", "t0"), "t AS (SELECT * FROM t0 WHERE source % 3 <> 0)", "l AS (SELECT page, source AS idx FROM t UNION SELECT page, target FROM t)",
        "n AS (SELECT l.page, l.idx, visual_rank AS at, row_number() OVER (PARTITION BY l.page ORDER BY visual_rank) AS n FROM l JOIN vo ON vo.page = l.page AND vo.idx = l.idx)",
        "SELECT t.page, count(*) AS edges, count(*) FILTER (a.at < b.at) AS precedence, count(*) FILTER (b.n = a.n + 1) AS successor FROM t JOIN n a ON a.page = t.page AND a.idx = source JOIN n b ON b.page = t.page AND b.idx = target GROUP BY t.page"),
    "line_edit_distance": q(EL, provider(2), visual("pv"), "b AS (SELECT page, 'a' AS s, idx AS p, text FROM el UNION ALL SELECT page, 'b', visual_rank, text FROM vo)",
        "c AS (SELECT page, s, p, chr(19968 + (dense_rank() OVER (PARTITION BY page ORDER BY text))::INT) AS c FROM b)",
        "d AS (SELECT page, string_agg(c, '' ORDER BY p) FILTER (s = 'a') AS a, coalesce(string_agg(c, '' ORDER BY p) FILTER (s = 'b'), '') AS b FROM c GROUP BY page)",
        # DuckDB's levenshtein works on bytes; a distinct character takes three of them, so lists are compared here by a table of prefixes
        "x AS (SELECT page, string_split(a, '') AS u, string_split(b, '') AS v, CASE WHEN b = '' THEN 0 ELSE length(b) END AS m FROM d)",
        "w(page, u, v, m, i, prev) AS (SELECT page, u, v, m, 0, range(m + 1) FROM x UNION ALL SELECT page, u, v, m, i + 1, list_reduce(list_prepend([i + 1]::BIGINT[], list_transform(range(1, m + 1), lambda j: [least(prev[j + 1] + 1, prev[j] + CASE WHEN u[i + 1] = v[j] THEN 0 ELSE 1 END)]::BIGINT[])), lambda s, e: list_append(s, least(e[1], s[len(s)] + 1))) FROM w WHERE i < len(u))",
        "SELECT page, prev[m + 1]::BIGINT AS distance FROM w WHERE i = len(u)", recursive=True),
    "candidate_summary": q(EL, VO, BF, BASE, disagree("visual_rank", "vo", "ca"), disagree("flow_rank", "bf", "cb"),
        "s AS (SELECT 'visual' AS candidate, sum(pairs)::BIGINT AS pairs, sum(discordant)::BIGINT AS discordant, sum(broken)::BIGINT AS broken FROM ca UNION ALL SELECT 'flow', sum(pairs)::BIGINT, sum(discordant)::BIGINT, sum(broken)::BIGINT FROM cb)",
        "a AS (SELECT *, round(1 - discordant / pairs, 8) AS accuracy FROM s)", "SELECT *, row_number() OVER (ORDER BY accuracy DESC, candidate) = 1 AS best FROM a"),
    "ignored_text_zones": q(EL, roles("el", "ro"), provider(1), "z AS (SELECT role, CASE WHEN (y0 + y1) / 2 / 792 < 0.1 THEN 'top' WHEN (y0 + y1) / 2 / 792 > 0.9 THEN 'bottom' ELSE 'body' END AS zone FROM el JOIN ro USING (page, idx) WHERE NOT EXISTS (SELECT 1 FROM pv WHERE pv.page = el.page AND pv.idx = el.idx))",
        "SELECT coalesce(zone, 'all') AS zone, coalesce(role, 'all') AS role, count(*) AS n, grouping_id(zone, role) AS level FROM z GROUP BY ROLLUP (zone, role)"),
    "style_dictionary": q(EL, "s AS (SELECT page, idx, min(idx) OVER (PARTITION BY page, y1 - y0, x0) AS f FROM el)", "SELECT page, idx, dense_rank() OVER (PARTITION BY page ORDER BY f) AS style FROM s"),
    "document_stats": q(EL, roles("el", "ro"), STRATA, "g AS (SELECT page, CASE WHEN left_lines >= 3 AND right_lines >= 3 AND wide_lines > 0 THEN 'mixed' WHEN left_lines >= 3 AND right_lines >= 3 THEN 'columns' WHEN wide_lines > 0 THEN 'single' ELSE 'sparse' END AS stratum FROM ps0)",
        "SELECT stratum, role, count(*) AS n, count(DISTINCT page) AS pages FROM ro JOIN g USING (page) GROUP BY ALL"),
    "page_folds": q(EL, STRATA, "g AS (SELECT page, CASE WHEN left_lines >= 3 AND right_lines >= 3 AND wide_lines > 0 THEN 'mixed' WHEN left_lines >= 3 AND right_lines >= 3 THEN 'columns' WHEN wide_lines > 0 THEN 'single' ELSE 'sparse' END AS stratum FROM ps0)",
        "SELECT page, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY sha256(page::VARCHAR), page) - 1) % 5 AS fold FROM g"),
    "feature_envelope": q(EL, VO, nearest(4), "u AS (UNPIVOT (SELECT dx, dy, gap_y::DOUBLE AS gap_y, overlap_x, rank_gap FROM pf) ON COLUMNS(*) INTO NAME feature VALUE v)", "SELECT feature, round(quantile_cont(v, 0.01), 8) AS low, round(quantile_cont(v, 0.99), 8) AS high FROM u GROUP BY feature"),
    "successor_examples": q(EL, VO, ED, nearest(3), "l AS (SELECT pf.*, CASE WHEN ed.page IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM pf LEFT JOIN ed ON ed.page = pf.page AND ed.source = pf.source AND ed.target = pf.target)",
        "SELECT label, count(*) AS n, round(avg(gap_y), 6) AS gap_y, round(avg(overlap_x), 6) AS overlap_x FROM l GROUP BY label"),
    "frozen_threshold": f"""WITH s AS (SELECT round({sha_bucket("doc_id::VARCHAR", 100)} / 100 * 0.6::DOUBLE + quality * 0.4::DOUBLE, 6) AS score, quality AS label FROM labels),
        c AS (SELECT DISTINCT unnest(quantile_cont(score, [{", ".join(str(i / 20) for i in range(21))}])) AS t FROM s),
        m AS (SELECT t, count(*) AS selected, sum(label)::BIGINT AS hits, sum(label) / count(*) AS p, 2 * sum(label) / (count(*) + (SELECT sum(label) FROM s)) AS f FROM c JOIN s ON score >= t GROUP BY t)
        SELECT round(t, 6) AS threshold, selected, hits, round(p, 8) AS precision, round(f, 8) AS f1 FROM m WHERE p >= 0.5 AND selected >= 20 ORDER BY f DESC, t DESC LIMIT 1""",
    "ab_deltas": q(EL, VO, BF, BASE, disagree("visual_rank", "vo", "ca"), disagree("flow_rank", "bf", "cb"),
        "SELECT ca.page, ca.discordant AS a, cb.discordant AS b, ca.discordant - cb.discordant AS delta, CASE WHEN ca.discordant < cb.discordant THEN 'a' WHEN ca.discordant > cb.discordant THEN 'b' ELSE 'tie' END AS better FROM ca JOIN cb USING (page)"),
    "weighted_means": q(EL, STRATA, "g AS (SELECT *, left_lines + right_lines + wide_lines AS n, CASE WHEN right_lines > 0 THEN left_lines / right_lines END AS rate, CASE WHEN left_lines >= 3 AND right_lines >= 3 AND wide_lines > 0 THEN 'mixed' WHEN left_lines >= 3 AND right_lines >= 3 THEN 'columns' WHEN wide_lines > 0 THEN 'single' ELSE 'sparse' END AS stratum FROM ps0)",
        "SELECT stratum, count(rate) AS pages, round(avg(rate), 8) AS mean, round(sum(rate * n) / sum(CASE WHEN rate IS NOT NULL THEN n END), 8) AS weighted, round(min(rate), 8) AS least FROM g GROUP BY stratum"),
}
