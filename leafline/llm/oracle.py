"""DuckDB SQL with the same results as the queries of this subpackage."""

from __future__ import annotations

from leafline.llm.license_scan import RULES, SENTENCES
from leafline.llm.preferences import CLOSE, LEARNED_ROLE, OPEN
from leafline.llm.quality_rules import CHAR_CLASSES, COMMON_WORDS, OTHER, QualityParams, _pooled_words, prior
from leafline.llm.secret_scan import ACCESS, ALLOWED, ASSIGN, CANDIDATE, HEX, EntropyParams


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def quality_rules_sql(params: QualityParams = QualityParams(), source: str = "documents") -> str:
    commons = {**COMMON_WORDS, OTHER: _pooled_words()}
    width = max(map(len, commons.values())) + 1
    count = lambda cls: f"length(regexp_replace(t, '[^{cls}]', '', 'g'))"
    lists = " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in commons.items())
    priors = {k: prior(k, params) for k in commons}
    of = lambda kind, i: "CASE ref " + " ".join(f"WHEN '{k}' THEN {x[kind][i]!r}::DOUBLE" for k, x in priors.items() if i < len(x[kind])) + " END"
    sums = ", ".join(f"{of('chars', i)} + sum(chars[{i + 1}])::DOUBLE AS c{i}" for i in range(len(CHAR_CLASSES)))
    sums += ", " + ", ".join(f"{of('words', i)} + sum(hist[{i + 1}])::DOUBLE AS w{i}" for i in range(width))
    rc = "[" + ", ".join(f"c{i}" for i in range(len(CHAR_CLASSES))) + "]"
    rw = "list_filter([" + ", ".join(f"w{i}" for i in range(width)) + "], lambda x: x IS NOT NULL)"

    def distance(p: str, q: str) -> str:
        half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
        x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half(x, y)} + {half(y, x)})) / 2))"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) THEN lang ELSE '{OTHER}' END AS ref FROM {source}),
s AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
             CASE ref {lists} END AS common FROM d),
f AS (SELECT doc_id, ref, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             {count("#*$%&|<>")} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             length(t) AS n, strlen(t) - length(t) AS wide, {count("0-9")} AS digit, {count("A-Z")} AS upper, {count(".,;:!?''" + '"' + "()-")} AS punct,
             list_transform(common, lambda c: len(list_filter(ws, lambda x: lower(x) = c))) AS hits FROM s),
h AS (SELECT *, [greatest(n - (upper + digit + n - word_chars + punct + n_symbols + wide), 0), upper, digit, n - word_chars, punct, n_symbols, wide]::DOUBLE[] AS chars,
             list_append(hits, n_words - list_sum(hits))::DOUBLE[] AS hist FROM f),
r AS (SELECT ref, {sums} FROM h GROUP BY ref),
refs AS (SELECT ref, {rc} AS rc, {rw} AS rw FROM r),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM
        (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, n_words - 3)) AS i FROM f WHERE n_words >= 5))),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM win, (SELECT unnest(range(0, 5)) AS o) WHERE c > 1 GROUP BY doc_id),
j AS (SELECT h.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n >= {params.min_chars_compared} AND n_words >= {params.min_words_compared} AS compared,
             {distance("chars", "rc")} AS cd, {distance("hist", "rw")} AS wd,
             n_words < {params.min_words} OR 100 * coalesce(n_repeat_words, 0) > {params.max_repeat_percent} * n_words AS base_failed
      FROM h LEFT JOIN rep USING (doc_id) LEFT JOIN refs USING (ref))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (compared AND (coalesce(cd, 0) > {params.max_char_distance} OR coalesce(wd, 0) > {params.max_word_distance})) AS kept
FROM j"""


def spans_sql(name: str, pattern: str, source: str, text: str = "t") -> str:
    """CTEs that give (doc_id, a, b, v) for each match of a pattern: starts and ends in code points, and its text."""
    mark = "chr(1)"
    return f"""
{name}_p AS (SELECT doc_id, string_split(regexp_replace(replace({text}, {mark}, chr(2)), '({pattern})', {mark} || '\\1' || {mark}, 'g'), {mark}) AS p FROM {source}),
{name}_i AS (SELECT doc_id, unnest(p) AS v, unnest(range(1, len(p) + 1)) AS i FROM {name}_p WHERE len(p) > 1),
{name} AS (SELECT doc_id, e - length(v) AS a, e AS b, v FROM (
    SELECT doc_id, i, v, (sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM {name}_i) WHERE i % 2 = 0)"""


def secret_scan_sql(params: EntropyParams = EntropyParams(), source: str = "documents") -> str:
    q = lambda x: x.replace("'", "''")
    assign = q(ASSIGN.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+"))
    tail = q(ASSIGN)
    suppressed = " OR ".join(f"regexp_matches(v, '{q(x)}')" for x in ALLOWED.values())
    digits = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
    low, up = digits.replace("0-9", "a-z"), digits.replace("0-9", "A-Z")
    limit = {k: v for k, _, v in params.classes}
    least = (
        f"CASE WHEN {digits} >= 1 AND regexp_matches(v, '[a-fA-F]') AND (regexp_full_match(v, '[0-9a-f]*') OR regexp_full_match(v, '[0-9A-F]*')) THEN {limit['hex']} "
        f"WHEN {digits} >= 1 AND {low} >= 1 AND {up} >= 1 THEN {limit['alnum']} WHEN {digits} >= 2 AND {low} + {up} >= 1 THEN {limit['one case']} "
        f"WHEN {low} >= 2 AND {up} >= 3 THEN {limit['letters']} ELSE 99 END"
    )
    w = params.window
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
{spans_sql("assigns", assign, "d")},
{spans_sql("accesses", ACCESS, "d")},
{spans_sql("hexes", HEX, "d")},
{spans_sql("cands", CANDIDATE, "d")},
base AS (SELECT doc_id, a, b, 0 AS r, 'assign' AS k FROM assigns WHERE length(regexp_extract(v, '{tail}', 1)) >= 12
    UNION ALL SELECT doc_id, a, b, 1, 'access' FROM accesses UNION ALL SELECT doc_id, a, b, 2, 'hex' FROM hexes),
cand AS (SELECT * FROM (SELECT *, {least} AS least FROM cands c WHERE NOT ({suppressed})
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = c.doc_id AND x.a <= c.a AND x.b >= c.b)) WHERE least < 99),
wins AS (SELECT doc_id, a, b, least, s, v[s:s + {w - 1}] AS win FROM (SELECT *, unnest(range(1, length(v) - {w - 2})) AS s FROM cand)),
freq AS (SELECT doc_id, a, b, least, s, ch, count(*) / {w}.0 AS p FROM (SELECT *, unnest(string_split(win, '')) AS ch FROM wins) GROUP BY ALL),
ent AS (SELECT doc_id, a, b, least, s, -sum(p * log2(p)) AS e FROM freq GROUP BY ALL),
added AS (SELECT doc_id, a, b, 3 AS r, 'entropy' AS k FROM ent GROUP BY doc_id, a, b, least HAVING max(e) > least),
bd AS (SELECT doc_id, count(*) FILTER (k = 'assign') AS n_assign, count(*) FILTER (k = 'access') AS n_access, count(*) FILTER (k = 'hex') AS n_hex,
    string_agg(k || ':' || a || ':' || b, ',' ORDER BY a, r, k, b) AS base FROM base GROUP BY doc_id),
sd AS (SELECT doc_id, string_agg(k || ':' || a || ':' || b, ',' ORDER BY a, r, k, b) AS spans FROM (FROM base UNION ALL FROM added) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN bd USING (doc_id) LEFT JOIN sd USING (doc_id)"""


def decontamination_sql(window: int = 10, docs: str = "documents", benchmark: str = "benchmark") -> str:
    words = "list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH b AS (SELECT item_id, {words} AS ws FROM {benchmark}),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (
    SELECT item_id, ws, least(len(ws), {window}) AS n, unnest(range(1, greatest(len(ws) - {window} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, {words} AS ws FROM {docs}),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def license_scan_sql(source: str = "documents") -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    rules = ", ".join(f"({i}, '{name}', '|{'||'.join(seq)}|')" for i, (name, seq) in enumerate(RULES))
    return f"""
WITH RECURSIVE known(id, sentence) AS (VALUES {known}), rules(i, name, pattern) AS (VALUES {rules}),
parts AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[\\n\\r]+|[.;:!?]+(?:[\\x20\\t]+|$)') AS p FROM {source}),
cut AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS pos FROM parts),
seq AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids, string_agg('|' || id || '|', '' ORDER BY pos) AS chain
    FROM cut JOIN known ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY doc_id),
steps(doc_id, i, left_over, out) AS (
    SELECT doc_id, 0, chain, []::VARCHAR[] FROM seq
    UNION ALL
    SELECT doc_id, steps.i + 1, replace(left_over, pattern, '|#|'), CASE WHEN contains(left_over, pattern) THEN list_append(out, name) ELSE out END
    FROM steps JOIN rules ON rules.i = steps.i)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(list_sort(list_distinct(out)), ','), '') AS licenses
FROM {source} d LEFT JOIN seq USING (doc_id) LEFT JOIN (SELECT * FROM steps WHERE i = {len(RULES)}) s USING (doc_id)"""


def preferences_sql(source: str = "conversations") -> str:
    turn = f"'{OPEN}' || role || chr(10) || text || '{CLOSE.strip()}' || chr(10)"
    side = lambda name, parity: f"""
{name} AS (SELECT pair_id, string_agg({turn}, '' ORDER BY k) AS body, coalesce(string_agg((e - length(text) - {len(CLOSE)})::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY k) FILTER (role = '{LEARNED_ROLE}'), '') AS mask
    FROM (SELECT *, (sum(length({turn})) OVER (PARTITION BY pair_id ORDER BY k))::BIGINT AS e FROM t JOIN shared USING (pair_id) WHERE side = {parity} AND k > n) GROUP BY pair_id)"""  # noqa: E731
    return f"""
WITH own AS (SELECT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, (conv_id % 2 + 2) % 2 AS side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn IS NULL, turn, coalesce(role, 'unknown'), coalesce(text, '')) AS k FROM {source} WHERE conv_id IS NOT NULL),
ends AS (SELECT pair_id, max(k) FILTER (side = 0 AND role = '{LEARNED_ROLE}') AS la, max(k) FILTER (side = 1 AND role = '{LEARNED_ROLE}') AS lb FROM own GROUP BY pair_id),
t AS (SELECT pair_id, 0 AS side, role, text, k FROM own WHERE side = 0
    UNION ALL SELECT pair_id, 1, role, text, k FROM own JOIN ends USING (pair_id) WHERE la IS NOT NULL AND lb IS NOT NULL AND side = 0 AND k < la
    UNION ALL SELECT pair_id, 1, role, text, la FROM own JOIN ends USING (pair_id) WHERE la IS NOT NULL AND lb IS NOT NULL AND side = 1 AND k = lb
    UNION ALL SELECT pair_id, 1, role, text, k FROM own JOIN ends USING (pair_id) WHERE (la IS NULL OR lb IS NULL) AND side = 1),
sizes AS (SELECT pair_id, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM t GROUP BY pair_id),
unequal AS (SELECT pair_id, k FROM t GROUP BY pair_id, k HAVING count(DISTINCT side) < 2 OR count(DISTINCT (role, text)) > 1),
shared AS (SELECT s.pair_id, a > 0 AND b > 0 AS paired, CASE WHEN a > 0 AND b > 0 THEN coalesce(min(k) - 1, a) ELSE 0 END AS n
    FROM sizes s LEFT JOIN unequal u ON u.pair_id = s.pair_id GROUP BY s.pair_id, a, b),
prompts AS (SELECT pair_id, string_agg({turn}, '' ORDER BY k) AS prompt FROM t JOIN shared USING (pair_id) WHERE side = 0 AND k <= n GROUP BY pair_id),
{side("c", 0)}, {side("r", 1)}
SELECT pair_id, paired, n AS n_shared, coalesce(prompt, '') AS prompt, coalesce(c.body, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
       coalesce(r.body, '') AS rejected, coalesce(r.mask, '') AS rejected_mask
FROM shared LEFT JOIN prompts USING (pair_id) LEFT JOIN c USING (pair_id) LEFT JOIN r USING (pair_id)"""


def repeated_bytes_sql(length: int = 400, source: str = "documents", words: int = 51) -> str:
    """Texts as hexadecimal digits, so that places are bytes; windows are told apart by MD5.

    Windows are cut from parts of a text, as cutting them from its start would take the square of its length.
    """
    part = 200
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM {source}),
c AS (SELECT doc_id, start, substring(h, 2 * start + 1, {2 * (part + length - 1)}) AS p, least({part}, n - {length - 1} - start) AS m FROM (SELECT doc_id, h, n, unnest(range(0, n - {length - 1}, {part})) AS start FROM d WHERE n >= {length})),
w AS (SELECT doc_id, start + o AS i, md5(substring(p, 2 * o + 1, {2 * length})) AS k FROM (SELECT doc_id, start, p, unnest(range(m)) AS o FROM c)),
t AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM t),
r AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f) GROUP BY doc_id, run),
ws AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {source}),
ww AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {words - 1}], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {words - 2})) AS i FROM ws WHERE len(ws) >= {words})),
wr AS (SELECT doc_id, i FROM ww WHERE k IN (SELECT k FROM ww GROUP BY k HAVING count(*) > 1)),
pw AS (SELECT doc_id, sum(least({words}, i - last))::BIGINT AS n_passage_words FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{words}) AS last FROM wr) GROUP BY doc_id),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS tail, string_agg(substring(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substring(h, 2 * tail + 1), h))) AS kept_sha256, coalesce(n_passage_words, 0) AS n_passage_words
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN pw USING (doc_id)"""
