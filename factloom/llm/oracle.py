"""SQL of the found queries, by the definitions alone; quadratic or worse, so for small scales."""

from __future__ import annotations

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')".format

P1 = f"""WITH w AS (SELECT id, namespace, {WORDS('content')} AS s FROM memory WHERE superseded_at IS NULL), u AS (SELECT *, list_distinct(s) AS d FROM w WHERE len(s) > 0),
p AS (SELECT x.id AS id_a, y.id AS id_b, len(list_intersect(x.d, y.d)) AS i, len(x.d) + len(y.d) AS n FROM u x JOIN u y ON x.namespace = y.namespace AND x.id < y.id AND x.s <> y.s AND 10 * least(len(x.d), len(y.d)) >= 7 * greatest(len(x.d), len(y.d)))
SELECT id_a, id_b FROM p WHERE 10 * i >= 7 * (n - i)"""

P1_GROUPS = f"""WITH RECURSIVE w AS (SELECT id, namespace, list_sort(list_distinct({WORDS('content')})) AS d FROM memory WHERE superseded_at IS NULL),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min(id)) AS k, namespace, d, min(id) AS first FROM w WHERE len(d) > 0 GROUP BY namespace, d),
l AS MATERIALIZED (SELECT x.k AS x, y.k AS y FROM c x JOIN c y ON x.namespace = y.namespace AND x.k <> y.k AND 10 * least(len(x.d), len(y.d)) >= 7 * greatest(len(x.d), len(y.d)) AND 10 * len(list_intersect(x.d, y.d)) >= 7 * (len(x.d) + len(y.d) - len(list_intersect(x.d, y.d)))),
r(k, o) AS (SELECT k, k FROM c UNION SELECT l.y, r.o FROM r JOIN l ON l.x = r.k), g AS (SELECT r.k, min(c.first) AS group_id FROM r JOIN c ON r.o = c.k GROUP BY r.k), n AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT w.id, g.group_id, coalesce(n.links, 0) AS links FROM w JOIN c ON w.namespace = c.namespace AND w.d = c.d JOIN g ON c.k = g.k LEFT JOIN n ON c.k = n.x"""

P2 = """WITH r AS (SELECT namespace, id, CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence END AS c, last_retrieved FROM memory WHERE superseded_at IS NULL),
n AS (SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY c DESC NULLS LAST, last_retrieved DESC NULLS LAST, id) AS rank_no FROM r) SELECT namespace, rank_no::INTEGER AS rank_no, id FROM n WHERE rank_no <= 5"""

_TAGS = "array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda g: lower(trim(g))), lambda g: g <> ''))), chr(3))"
_PAIRS = f"""array_to_string(list_sort(list_distinct(list_transform(json_keys(content), lambda k: array_to_string({WORDS('k')}, ' ') || chr(4) || array_to_string({WORDS("coalesce(json_extract_string(content, '$.' || json_quote(k)), 'null')")}, ' ')))), chr(3))"""
_FORM = f"""CASE WHEN CASE WHEN json_valid(content) THEN json_type(content) = 'OBJECT' ELSE false END THEN 'o' || {_PAIRS} ELSE 't' || array_to_string({WORDS("coalesce(content, '')")}, ' ') END"""
_P3_ROWS = f"WITH f AS (SELECT id, min(id) OVER w AS keep_id, count(*) OVER w AS copies FROM (SELECT id, namespace, {_FORM} AS form, {_TAGS} AS tag FROM memory WHERE superseded_at IS NULL) WINDOW w AS (PARTITION BY namespace, form, tag))"
P3 = f"{_P3_ROWS} SELECT keep_id, id AS copy_id FROM f WHERE id <> keep_id"
P3_KEPT = f"{_P3_ROWS} SELECT DISTINCT keep_id, copies FROM f"

_NEAR = "(x.namespace = y.namespace AND 10 * least(len(x.d), len(y.d)) >= 7 * greatest(len(x.d), len(y.d)) AND 10 * len(list_intersect(x.d, y.d)) >= 7 * (len(x.d) + len(y.d) - len(list_intersect(x.d, y.d))) AND len(x.d) > 0)"
_SAME = "(x.source_ref = y.source_ref AND trim(x.source_ref) <> '' AND x.ingestion_ts = y.ingestion_ts)"
P4 = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT row_id, row_number() OVER (ORDER BY batch_no, line_no, row_id) AS i, namespace, list_distinct({WORDS("coalesce(content, '')")}) AS d, source_ref, ingestion_ts FROM memory_batch),
m AS MATERIALIZED (SELECT namespace, list_distinct({WORDS("coalesce(content, '')")}) AS d, source_ref, ingestion_ts FROM memory WHERE superseded_at IS NULL),
hist AS MATERIALIZED (SELECT DISTINCT i FROM (SELECT x.i FROM b x JOIN m y ON {_NEAR} UNION ALL SELECT x.i FROM b x JOIN m y ON {_SAME})),
e AS (SELECT i, list(j) AS js FROM (SELECT x.i, y.i AS j FROM b x JOIN b y ON {_NEAR} AND y.i < x.i UNION ALL SELECT x.i, y.i FROM b x JOIN b y ON {_SAME} AND y.i < x.i) GROUP BY i),
n AS MATERIALIZED (SELECT b.i, b.row_id, hist.i IS NOT NULL AS h, coalesce(e.js, []) AS js FROM b LEFT JOIN hist ON b.i = hist.i LEFT JOIN e ON b.i = e.i),
s(i, acc) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.i, CASE WHEN n.h OR list_has_any(s.acc, n.js) THEN s.acc ELSE list_append(s.acc, n.i) END FROM s JOIN n ON n.i = s.i + 1)
SELECT row_id FROM n WHERE NOT list_contains((SELECT arg_max(acc, i) FROM s), i)"""

_TEXT = """CASE WHEN CASE WHEN json_valid(content) THEN json_type(content) = 'ARRAY' ELSE false END THEN array_to_string(list_filter(list_transform(list_filter(CAST(json_extract(content, '$') AS JSON[]), lambda b: json_extract_string(b, '$.type') = 'text'), lambda b: json_extract_string(b, '$.text')), lambda s: s IS NOT NULL), '') ELSE content END"""
P5 = f"""WITH k AS (SELECT *, regexp_replace(lower(role), '^\\s+|\\s+$', '', 'g') AS who, row_number() OVER (PARTITION BY session_id, seq ORDER BY stored_ts DESC NULLS LAST, message_id DESC) AS nth FROM message WHERE session_id IS NOT NULL),
c AS (SELECT *, who = 'system' OR coalesce(is_meta, false) OR (tool_use_id IS NULL AND coalesce(regexp_matches({_TEXT}, '^\\s*$'), true)) AS left_out FROM k WHERE nth = 1),
whole AS (SELECT session_id FROM c GROUP BY session_id HAVING count(*) = count(seq) AND min(seq) = 1 AND max(seq) = count(*) AND count(DISTINCT seq) = count(*) AND bool_and(coalesce(who IN ('user', 'assistant', 'system'), false))),
kept AS (SELECT c.* FROM c SEMI JOIN whole ON c.session_id = whole.session_id WHERE NOT coalesce(left_out, false)),
bad_tools AS (SELECT session_id FROM kept WHERE tool_use_id IS NOT NULL GROUP BY session_id, tool_use_id HAVING NOT (count(*) FILTER (who = 'assistant') = 1 AND count(*) FILTER (who = 'user') = 1 AND coalesce(max(seq) FILTER (who = 'user') > max(seq) FILTER (who = 'assistant'), false))),
said AS (SELECT session_id, seq, who, lag(who) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM kept WHERE tool_use_id IS NULL),
good AS (SELECT session_id FROM said GROUP BY session_id HAVING arg_min(who, seq) = 'user' AND arg_max(who, seq) = 'assistant' AND NOT bool_or(who = 'user' AND coalesce(before, '') = 'user'))
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY seq))::INTEGER AS turn_no, message_id FROM kept WHERE session_id IN (SELECT session_id FROM good) AND session_id NOT IN (SELECT session_id FROM bad_tools)"""

P8 = """WITH g AS (SELECT doc_id, s, substr(text, s + 1, 120) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text) - 119)) AS s FROM documents WHERE length(text) >= 120)),
shared AS (SELECT w FROM g GROUP BY w HAVING min(doc_id) <> max(doc_id)), hit AS (SELECT doc_id, s FROM g SEMI JOIN shared ON g.w = shared.w),
cut AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 120 THEN 0 ELSE 1 END AS fresh FROM hit), no AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM cut)
SELECT doc_id, min(s)::INTEGER AS span_start, (max(s) + 120)::INTEGER AS span_end FROM no GROUP BY doc_id, n"""

P6_PROMISES = """SELECT container_kind, capacity_tokens::BIGINT AS capacity, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS tokens_lost, 0::BIGINT AS cut_though_fitting, 0::BIGINT AS over_capacity, 0::BIGINT AS over_documents, 0::BIGINT AS over_cost, true AS little_unused
FROM container_kind WHERE container_kind IS NOT NULL AND capacity_tokens > 0"""
_SOURCE = r"lower(regexp_replace({0}, '^[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+|[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '', 'g'))".format
P7_PROMISES = f"""WITH d AS (SELECT {_SOURCE('source')} AS source, count(DISTINCT doc_id) AS n FROM documents WHERE text <> '' GROUP BY 1)
SELECT t.source, target_share, max_repeats, coalesce(n, 0) AS available, 0::BIGINT AS strange, 0::BIGINT AS too_often, true AS as_planned FROM (SELECT {_SOURCE('source')} AS source, target_share, max_repeats FROM mix_target WHERE source IS NOT NULL) t LEFT JOIN d ON t.source = d.source"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p1_groups": P1_GROUPS, "p2_found": P2, "p3_found": P3, "p3_kept": P3_KEPT, "p4_found": P4, "p4_last_batch": P4 + " AND row_id IN (SELECT row_id FROM memory_batch WHERE batch_no = (SELECT max(batch_no) FROM memory_batch))", "p5_found": P5, "p5_gap_agreement": "SELECT true AS precise, true AS complete", "p6_promises": P6_PROMISES, "p7_promises": P7_PROMISES, "p8_found": P8}
