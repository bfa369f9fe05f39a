"""Pieces of the SQL that the queries are compared with."""

from __future__ import annotations

from factloom.functions import fixed

NOW_US = 1767225600000000
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g')"


def plain(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')))"


def lexical(x: str) -> str:
    stop = ", ".join(quoted(w) for w in fixed.STOPWORDS)
    return f"list_filter({plain(x)}, lambda w: length(w) >= 3 AND NOT list_contains([{stop}], w))"


SCRUBBED = r"""regexp_replace(regexp_replace(text, '[A-Za-z][A-Za-z0-9+.-]*://\S+', '<uri>', 'g'), '(?:[A-Za-z]:)?(?:[\\/][^\s\\/:''"]+){2,}', '<path>', 'g')"""


def any_match(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({x}, {quoted(p)}), false)" for p in patterns) + ")"


def negated(x: str) -> str:
    plain_ = f"regexp_replace(regexp_replace(replace(coalesce({x}, ''), '\u2019', ''''), '`[^`]*`', ' ', 'g'), '\"[^\"\\n]*\"', ' ', 'g')"
    return f"regexp_matches({plain_}, {quoted('(?i)' + fixed.NEGATORS)})"


def redact(x: str) -> str:
    out = f"coalesce({x}, '')"
    for p in fixed.SECRETS:
        out = f"regexp_replace({out}, {quoted(p)}, '{fixed.SECRET_MARK}', 'g')"
    return out


def tag_list(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda g: trim(g)), lambda g: g <> '')))"


def with_tag(x: str, tag: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_append({tag_list(x)}, '{tag}'))), ',')"


def one_line(x: str) -> str:
    t = f"translate(coalesce({x}, ''), chr(13) || chr(10) || chr(8232) || chr(8233) || chr(133), '     ')"
    return f"regexp_replace(replace(replace(replace({t}, '```', ''''''''), '<!--', '<! --'), '-->', '-- >'), '^\\s+|\\s+$', '', 'g')"


USABLE = "CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence END"
NEAR_MISS = f"(regexp_replace(lower(namespace), '[\\s:_\\-.]+', '', 'g') IN ({', '.join(quoted(s) for s in fixed.NEAR_MISS_STEMS)}) AND namespace <> 'user:global')"
SIGNAL_RANK = "CASE signal WHEN 'test' THEN 5 WHEN 'compile' THEN 4 WHEN 'lint' THEN 3 WHEN 'reviewer' THEN 2 WHEN 'user' THEN 2 ELSE 1 END"
REJECT = f"""CASE WHEN NOT regexp_matches(b.id, '^[0-9a-fA-F-]{{36}}$') THEN 'id' WHEN trim(b.namespace) = '' THEN 'namespace' WHEN {NEAR_MISS.replace('namespace', 'b.namespace')} THEN 'near-miss' WHEN b.content IS NULL OR trim(b.content) = '' THEN 'content'
WHEN length(b.content) > 65536 THEN 'size' WHEN b.type NOT IN ('fact', 'lesson', 'convention', 'preference') THEN 'type' END"""


def bm25(query: str) -> str:
    terms = query.split()
    tf = ", ".join(f"len(list_filter(toks, lambda w: starts_with(w, '{t}'))) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((rows_n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf{i} * (1.2::DOUBLE + 1) / (tf{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avg_dl))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""WITH toks AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', content, tags, namespace)), '[a-z0-9]+') AS toks FROM memory), counted AS (SELECT id, len(toks) AS dl, {tf} FROM toks),
totals AS (SELECT count(*) AS rows_n, avg(dl) AS avg_dl, {df} FROM counted), scored AS (SELECT id, {score} AS bm25 FROM counted, totals WHERE {hit})"""


def score(rel: str) -> str:
    days = f"greatest(({NOW_US} - epoch_us(ingestion_ts)) / 86400000000.0::DOUBLE, 0::DOUBLE)"
    recency = f"CASE WHEN ingestion_ts IS NULL THEN 0.5::DOUBLE ELSE pow(0.5::DOUBLE, {days} / 90) END"
    uses = "(coalesce(retrieval_count, 0) + coalesce(surfaced_count, 0))"
    return f"0.55::DOUBLE * {rel} + 0.2::DOUBLE * confidence + 0.15::DOUBLE * {recency} + 0.1::DOUBLE * least(1::DOUBLE, 0.15::DOUBLE * sqrt({uses}::DOUBLE))"


def tier(name: str, where: str, limit: int, floor: float) -> str:
    return f"""{name}_m AS (SELECT m.*, s.bm25 FROM scored s JOIN memory m ON s.id = m.id WHERE superseded_at IS NULL AND {USABLE} >= {floor} AND {where} ORDER BY s.bm25 DESC, m.id LIMIT {max(3 * limit, limit + 5)}),
{name} AS (SELECT *, {score('(abs(bm25) / (1 + abs(bm25)))')} AS score FROM {name}_m ORDER BY score DESC, id LIMIT {limit})"""


def hybrid(query: str, limit: int = 10) -> str:
    return f"""{bm25(query)}, rows_ AS (SELECT * FROM memory WHERE superseded_at IS NULL AND {USABLE} >= 0.25),
text_ AS (SELECT r.id, s.bm25, row_number() OVER (ORDER BY s.bm25 DESC, r.id) AS rank FROM scored s JOIN rows_ r ON s.id = r.id ORDER BY rank LIMIT {max(3 * limit, limit + 5)}),
vec AS (SELECT r.id, list_inner_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS sim FROM rows_ r JOIN embeddings e ON CAST('0x' || substr(md5(r.id), 1, 6) AS BIGINT) % (SELECT count(*) FROM embeddings) = e.vec_id),
near AS (SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM vec ORDER BY rank LIMIT {max(5 * limit, limit + 10)}),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT id, rank FROM text_ UNION ALL SELECT id, rank FROM near) GROUP BY id),
j AS (SELECT r.*, f.rrf, t.bm25, n.sim FROM fused f JOIN rows_ r ON f.id = r.id LEFT JOIN text_ t ON t.id = f.id LEFT JOIN near n ON n.id = f.id)
SELECT id, round(score, 4) AS score, round(rrf, 6) AS rrf FROM (SELECT id, rrf, {score('coalesce(abs(bm25) / (1 + abs(bm25)), greatest(sim, 0::DOUBLE), 0)')} AS score FROM j) ORDER BY score DESC, rrf DESC, id LIMIT {limit}"""


# The transcripts' failures: a content that isn't JSON has no block.
FAILURES = """WITH m AS (SELECT *, CASE WHEN starts_with(content, '[') AND json_valid(content) THEN json_extract(content, '$[0]') END AS b FROM message WHERE tool_use_id IS NOT NULL AND session_id IS NOT NULL),
calls AS (SELECT session_id, tool_use_id, min(json_extract_string(b, '$.name')) AS tool_name FROM m WHERE lower(trim(role)) = 'assistant' GROUP BY 1, 2),
res AS (SELECT session_id, tool_use_id, seq, coalesce(is_error, CAST(json_extract_string(b, '$.is_error') AS BOOLEAN), false) AS is_error,
CASE WHEN json_type(b, '$.content') = 'ARRAY' THEN coalesce(array_to_string(list_filter(list_transform(list_filter(CAST(json_extract(b, '$.content') AS JSON[]), lambda x: json_extract_string(x, '$.type') = 'text'), lambda x: json_extract_string(x, '$.text')), lambda x: x IS NOT NULL AND x <> ''), ' '), '') ELSE json_extract_string(b, '$.content') END AS text,
row_number() OVER (PARTITION BY session_id, tool_use_id ORDER BY stored_ts DESC NULLS LAST, message_id DESC) AS nth FROM m WHERE lower(trim(role)) = 'user'),
g AS (SELECT r.session_id, r.tool_use_id, coalesce(c.tool_name, '?') AS tool_name, seq, is_error, coalesce(text, '') AS t FROM res r LEFT JOIN calls c ON r.session_id = c.session_id AND r.tool_use_id = c.tool_use_id WHERE nth = 1),
f AS (SELECT session_id, tool_use_id, tool_name, seq, CASE WHEN contains(lower(t), 'the user doesn''t want to proceed') THEN 'rejection' ELSE 'failure' END AS kind,
CASE WHEN strpos(lower(t), 'user said:') > 0 THEN array_to_string(list_filter(list_transform(string_split_regex(substr(t, strpos(lower(t), 'user said:') + 10), '\\r\\n|\\r|\\n'), lambda x: trim(x)), lambda x: x <> ''), ' ') ELSE '' END AS reason,
substr(regexp_replace(t, '[\\r\\n]+', ' ', 'g'), 1, 200) AS text FROM g WHERE is_error OR starts_with(lower(ltrim(t)), 'error'))
"""

USER_MESSAGES = f"""WITH m AS (SELECT *, CASE WHEN starts_with(content, '[') AND json_valid(content) THEN CAST(json_extract(content, '$') AS JSON[]) END AS bs FROM message WHERE lower(trim(type)) = 'user' AND NOT coalesce(is_meta, false) AND tool_use_id IS NULL),
x AS (SELECT session_id, project_folder, message_id, sent_ts, CASE WHEN bs IS NOT NULL THEN coalesce(array_to_string(list_filter(list_transform(list_filter(bs, lambda b: json_extract_string(b, '$.type') = 'text'), lambda b: json_extract_string(b, '$.text')), lambda s: s IS NOT NULL), chr(10)), '') ELSE content END AS text FROM m),
u AS (SELECT * FROM x WHERE trim(text) <> '' AND NOT {any_match('text', fixed.NOT_A_MESSAGE)})
"""


def collapse_key(x: str) -> str:
    return f"regexp_replace(trim(translate(lower({x}), '.,!?;:''\"()[]', '')), '\\s+', ' ', 'g')"


def error_type(x: str) -> str:
    noise = any_match(x, tuple("(?i)" + p for p in fixed.ERROR_NOISE))
    cases = " ".join(f"WHEN regexp_matches({x}, {quoted('(?i)' + p)}) THEN '{n}'" for n, p, _ in fixed.ERRORS)
    return f"CASE WHEN {x} IS NULL OR {x} = '' OR {noise} THEN NULL {cases} END"


def correction_classes() -> str:
    m = lambda p: f"coalesce(regexp_matches(message, {quoted('(?i)' + p)}), false)"
    any_ = lambda ps: "(" + " OR ".join(m(p) for p in ps) + ")"
    hits = ", ".join(f"CASE WHEN {m(p)}{'' if s else ' AND length(message) <= 150'} THEN {{'n': {quoted(n)}, 's': {str(s).lower()}}} END" for p, n, s in fixed.CORRECTIONS)
    cjk = ", ".join(f"CASE WHEN {m(p)} THEN '{n}' END" for p, n in fixed.CJK)
    strong = any_([r[0] for r in fixed.CORRECTIONS if r[2]] + [r[0] for r in fixed.CJK])
    made = lambda k, p, c, s, d: f"{{'kind': {k}, 'patterns': {p}, 'confidence': round(({c})::DOUBLE, 2), 'sentiment': '{s}', 'decay_days': ({d})::INTEGER}}"
    none = made("NULL::VARCHAR", "''", "0.0", "correction", "90")
    cases = [f"WHEN message IS NULL OR length(message) <= CASE WHEN regexp_matches(message, '{fixed.CJK_CHARS}') THEN 2 ELSE 4 END THEN {none}"]
    cases += [f"WHEN {m(p)} THEN {made(quoted('explicit'), quoted(n), c, 'correction', d)}" for p, n, c, d in fixed.EXPLICIT]
    cases += [f"WHEN {m(p)} THEN {made(quoted('guardrail'), quoted(n), c, 'correction', d)}" for p, n, c, d in fixed.GUARDRAILS]
    cases += [f"WHEN {any_(fixed.FALSE_POSITIVES)} AND NOT {strong} THEN {none}", f"WHEN {any_(fixed.POLITE)} THEN {none}"]
    cases += [f"WHEN {m(p)} THEN {made(quoted('positive'), quoted(n), c, 'positive', d)}" for p, n, c, d in fixed.POSITIVE]
    cases += [f"WHEN len(cjk) > 0 THEN {made(quoted('auto'), 'array_to_string(cjk, chr(32))', 'CASE WHEN length(message) < 80 THEN 0.85 WHEN length(message) > 300 THEN 0.60 ELSE 0.75 END', 'correction', '90')}"]
    base = "CASE WHEN told OR len(hits) >= 3 THEN 0.85 WHEN len(hits) = 2 THEN 0.75 WHEN strong_hit THEN 0.70 ELSE 0.55 END"
    decay = "CASE WHEN told OR len(hits) >= 3 THEN 120 WHEN len(hits) = 2 THEN 90 WHEN strong_hit THEN 60 ELSE 45 END"
    sized = f"CASE WHEN length(message) < 80 THEN least({base} + 0.10, 0.90) WHEN length(message) > 300 THEN greatest({base} - 0.15, 0.50) WHEN length(message) > 150 THEN greatest({base} - 0.10, 0.55) ELSE {base} END"
    cases += [f"WHEN len(hits) > 0 THEN {made(quoted('auto'), 'array_to_string(list_transform(hits, lambda h: h.n), chr(32))', sized, 'correction', decay)}"]
    return f"""WITH h AS (SELECT item_id, message, list_filter([{hits}], lambda h: h IS NOT NULL) AS hits, list_filter([{cjk}], lambda h: h IS NOT NULL) AS cjk FROM correction_item),
g AS (SELECT *, len(list_filter(hits, lambda h: h.n = 'I-told-you')) > 0 AS told, len(list_filter(hits, lambda h: h.s)) > 0 AS strong_hit FROM h), c AS (SELECT item_id, CASE {' '.join(cases)} ELSE {none} END AS c FROM g)
SELECT item_id, c.kind AS kind, c.patterns AS patterns, c.confidence AS confidence, c.sentiment AS sentiment, c.decay_days AS decay_days FROM c"""


def hybrid_tiers(query: str, project: str, alias: str) -> str:
    """Both tiers by text and vectors, with demotion."""
    tier_ = f"CASE WHEN namespace IN ('{project}', '{alias}') THEN 1 WHEN namespace = '{fixed.GLOBAL_NAMESPACE}' THEN 2 END"
    most = "CASE tier WHEN 1 THEN {0} ELSE {1} END".format
    sims = "list_inner_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
    return f"""{bm25(query)}, rows_ AS (SELECT * REPLACE (({USABLE}) AS confidence), {tier_} AS tier FROM memory WHERE superseded_at IS NULL AND {USABLE} >= 0.25 AND {tier_} IS NOT NULL),
text_ AS (SELECT r.id, r.tier, s.bm25, row_number() OVER (PARTITION BY tier ORDER BY s.bm25 DESC, r.id) AS rank FROM scored s JOIN rows_ r ON s.id = r.id QUALIFY rank <= {most(15, 9)}),
near AS (SELECT r.id, r.tier, {sims} AS sim, row_number() OVER (PARTITION BY tier ORDER BY {sims} DESC, r.id) AS rank FROM rows_ r JOIN embeddings e ON CAST('0x' || substr(md5(r.id), 1, 6) AS BIGINT) % (SELECT count(*) FROM embeddings) = e.vec_id QUALIFY rank <= {most(25, 15)}),
fused AS (SELECT id, max(bm25) AS bm25, max(sim) AS sim, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT id, bm25, NULL AS sim, rank FROM text_ UNION ALL SELECT id, NULL, sim, rank FROM near) GROUP BY id),
c AS (SELECT source_ref, max(source_hash) AS h FROM memory WHERE source_hash IS NOT NULL AND source_ref IS NOT NULL GROUP BY source_ref),
j AS (SELECT r.* REPLACE (CASE WHEN coalesce(r.source_hash <> c.h, false) THEN 0.5 ELSE 1.0 END * r.confidence AS confidence), coalesce(r.source_hash <> c.h, false) AS stale, f.bm25, f.sim, f.rrf FROM fused f JOIN rows_ r ON f.id = r.id LEFT JOIN c ON r.source_ref = c.source_ref),
k AS (SELECT *, {score('coalesce(abs(bm25) / (1 + abs(bm25)), greatest(sim, 0::DOUBLE), 0)')} AS score FROM j)
SELECT id, namespace, tier, round(score, 4) AS score, round(confidence, 3) AS confidence, stale, round(rrf, 6) AS rrf FROM k QUALIFY row_number() OVER (PARTITION BY tier ORDER BY score DESC, rrf DESC, id) <= {most(5, 3)}"""


def detect(batch: str) -> str:
    pick = "CAST('0x' || substr(md5(coalesce(content, '')), 1, 6) AS BIGINT) % (SELECT count(*) FROM embeddings)"
    return f"""WITH b AS (SELECT row_id, namespace, {norm('content')} AS norm, e.embedding::DOUBLE[] AS v FROM (SELECT *, {pick} AS k FROM {batch}) x JOIN embeddings e ON x.k = e.vec_id),
m AS (SELECT id, namespace, {norm('content')} AS norm, e.embedding::DOUBLE[] AS v FROM (SELECT *, {pick} AS k FROM memory WHERE superseded_at IS NULL) x JOIN embeddings e ON x.k = e.vec_id),
s AS (SELECT row_id, m.id AS dup_of, list_inner_product(b.v, m.v) AS sim FROM b JOIN m ON b.namespace = m.namespace AND list_inner_product(b.v, m.v) >= 0.85 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(list_inner_product(b.v, m.v), 9) DESC, m.id) = 1),
x AS (SELECT row_id, min(m.id) AS dup_of FROM b JOIN m ON b.namespace = m.namespace AND b.norm = m.norm WHERE row_id NOT IN (SELECT row_id FROM s) GROUP BY row_id)
SELECT row_id, dup_of, round(sim, 5) AS sim, 'semantic' AS how FROM s UNION ALL SELECT row_id, dup_of, 1.0::DOUBLE, 'exact' FROM x"""


# Seeded star clusters, one seed a step: what is taken and parked is carried along.
CLUSTERS = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT namespace, id, content, {lexical('content')} AS toks, {negated('content')} AS neg, row_number() OVER (ORDER BY namespace, coalesce({USABLE}, 0) * (coalesce(retrieval_count, 0) + coalesce(surfaced_count, 0)) DESC, {USABLE} DESC NULLS LAST, ingestion_ts NULLS FIRST, id) AS place FROM memory WHERE superseded_at IS NULL AND namespace IS NOT NULL),
p AS MATERIALIZED (SELECT x.id AS a, y.id AS b, y.place AS place, y.neg AS neg, len(list_intersect(x.toks, y.toks)) AS i, len(x.toks) + len(y.toks) AS n FROM w x JOIN w y ON x.namespace = y.namespace AND x.id <> y.id AND len(x.toks) > 0 AND least(len(x.toks), len(y.toks)) >= 0.59 * greatest(len(x.toks), len(y.toks))),
nb AS MATERIALIZED (SELECT a, list({{'id': b, 'neg': neg}} ORDER BY place) AS nb FROM p WHERE i / (n - i) >= 0.6 GROUP BY a),
q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY place) AS i, w.namespace, w.id, w.neg, nb.nb FROM w JOIN nb ON w.id = nb.a),
s(i, namespace, keeper, members, contested, taken, parked) AS (SELECT 0::BIGINT, '', '', []::STRUCT(id VARCHAR, neg BOOLEAN)[], false, []::VARCHAR[], []::VARCHAR[]
UNION ALL SELECT i, namespace, id, CASE WHEN act THEN mem ELSE [] END, con, CASE WHEN act AND NOT con THEN list_concat(taken, list_append(list_transform(mem, lambda x: x.id), id)) ELSE taken END, CASE WHEN act AND con THEN list_concat(parked, list_append(list_transform(mem, lambda x: x.id), id)) ELSE parked END
FROM (SELECT *, len(mem) > 0 AND NOT list_contains(taken, id) AND NOT list_contains(parked, id) AS act, len(list_filter(mem, lambda x: x.neg <> neg)) > 0 AS con FROM (SELECT q.i, q.namespace, q.id, q.neg, s.taken, s.parked, list_filter(q.nb, lambda x: NOT list_contains(s.taken, x.id)) AS mem FROM s JOIN q ON q.i = s.i + 1)))
"""

# Members folded into their keeper in order of place.
FOLD = CLUSTERS.rstrip() + f""", g AS (SELECT keeper, unnest(members).id AS member FROM s WHERE len(members) > 0 AND NOT contested), l AS (SELECT g.keeper, k.content AS kc, list({{'c': coalesce(m.content, ''), 'ids': m.id}} ORDER BY m.place) AS xs FROM g JOIN w m ON g.member = m.id JOIN w k ON g.keeper = k.id GROUP BY 1, 2),
f AS (SELECT keeper, list_reduce(xs, lambda a, x: CASE WHEN {norm('x.c')} = '' OR contains({norm('a.c')}, {norm('x.c')}) THEN {{'c': a.c, 'ids': CASE WHEN a.ids = '' THEN x.ids ELSE a.ids || ',' || x.ids END}}
WHEN length(a.c) + length(x.c) + 26 + length(x.ids) > 65536 THEN {{'c': a.c, 'ids': CASE WHEN a.ids = '' THEN x.ids ELSE a.ids || ',' || x.ids END || ':truncated'}}
ELSE {{'c': a.c || chr(10) || chr(10) || '--- merged from ' || x.ids || ' ---' || chr(10) || x.c, 'ids': CASE WHEN a.ids = '' THEN x.ids ELSE a.ids || ',' || x.ids END}} END, {{'c': kc, 'ids': ''}}) AS z FROM l)"""

SYNC_AUTO = f"""WITH k AS (SELECT id, superseded_at IS NULL AS live FROM memory), h AS (SELECT DISTINCT namespace, {norm('content')} AS norm FROM memory WHERE superseded_at IS NULL),
mb AS (SELECT * REPLACE (CASE WHEN row_id % 7 = 0 THEN content || ' token: abcdefghij' ELSE content END AS content, CASE WHEN row_id % 11 = 0 THEN 'password=hunter2hunter2' ELSE source_ref END AS source_ref), row_id % 3 = 0 AND arrived_ts IS NOT NULL AS dead FROM memory_batch),
r AS (SELECT row_id, b.id, b.namespace, dead, {norm(redact('content'))} AS norm, row(batch_no, line_no) AS ord, {REJECT} AS reject, k.live AS known, {any_match("coalesce(source_ref, '')", fixed.SECRETS)} AS refused FROM mb b LEFT JOIN k ON b.id = k.id),
e AS (SELECT *, reject IS NULL AND known IS NULL AND NOT refused AND ord = min(CASE WHEN reject IS NULL AND known IS NULL AND NOT refused THEN ord END) OVER (PARTITION BY id) AS entering FROM r),
f AS (SELECT e.*, h.norm IS NOT NULL AS have, min(CASE WHEN entering AND NOT dead THEN ord END) OVER (PARTITION BY e.namespace, e.norm) AS first FROM e LEFT JOIN h ON e.namespace = h.namespace AND e.norm = h.norm)
SELECT row_id, CASE WHEN reject IS NOT NULL THEN 'malformed' WHEN known IS NOT NULL THEN CASE WHEN dead AND known THEN 'tombstoned' ELSE 'skipped' END WHEN refused THEN 'capture_refused' WHEN dead AND entering THEN 'added' WHEN have THEN 'deduped' WHEN entering AND ord = first THEN 'added' WHEN first < ord AND entering THEN 'deduped' ELSE 'skipped' END AS outcome FROM f"""


def applied(outcomes: str) -> str:
    """The table after an ingest in manual mode."""
    sig = "CASE WHEN signal IN ('test', 'compile', 'lint', 'reviewer', 'user', 'none') THEN signal ELSE 'none' END"
    conf = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN confidence IS NOT NULL AND isfinite(confidence) THEN confidence ELSE CASE sig WHEN 'test' THEN 0.9 WHEN 'compile' THEN 0.9 WHEN 'lint' THEN 0.85 WHEN 'reviewer' THEN 0.6 WHEN 'user' THEN 0.6 ELSE 0.2 END END))"
    rank = SIGNAL_RANK.replace("CASE signal", "CASE {0}").format
    risky = any_match("concat_ws(' ', nullif(content, ''), nullif(source_ref, ''), nullif(tags, ''))", fixed.INJECTIONS)
    return f"""WITH o AS ({outcomes}), v AS (SELECT *, {sig} AS sig FROM memory_batch), b AS (SELECT v.*, {conf} AS conf, {norm('content')} AS norm, CASE WHEN {risky} THEN {with_tag('tags', 'prompt-injection-risk')} ELSE tags END AS tags2, o.outcome FROM v JOIN o ON v.row_id = o.row_id),
base AS (SELECT id, namespace, {USABLE} AS confidence, signal, tags, retrieval_count, superseded_at IS NULL AS live, {norm('content')} AS norm FROM memory UNION ALL SELECT id, namespace, conf, sig, tags2, 0, true, norm FROM b WHERE outcome = 'added'),
f AS (SELECT namespace, norm, max(conf) AS conf, list(sig ORDER BY {rank('sig')} DESC, batch_no, line_no)[1] AS sig, list_distinct(flatten(list({tag_list('tags2')}))) AS tags, count(*) AS n FROM b WHERE outcome = 'deduped' GROUP BY 1, 2),
k AS (SELECT namespace, norm, min(id) AS id FROM base WHERE live GROUP BY 1, 2), j AS (SELECT k.id, f.* EXCLUDE (namespace, norm) FROM f JOIN k ON f.namespace = k.namespace AND f.norm = k.norm)
SELECT s.id, namespace, round(CASE WHEN n IS NULL THEN confidence ELSE greatest(confidence, conf) END, 6) AS confidence, CASE WHEN n IS NOT NULL AND {rank('sig')} > {rank('signal')} THEN sig ELSE signal END AS signal,
CASE WHEN n IS NOT NULL AND len(list_distinct(list_concat({tag_list('s.tags')}, j.tags))) > 0 THEN array_to_string(list_sort(list_distinct(list_concat({tag_list('s.tags')}, j.tags))), ',') ELSE s.tags END AS tags, retrieval_count + coalesce(n, 0) AS retrieval_count FROM base s LEFT JOIN j ON s.id = j.id"""


def mined() -> str:
    """New queue items of all transcripts."""
    classes = correction_classes().replace("WITH h AS", "h AS").replace("FROM correction_item", "FROM (SELECT message_id AS item_id, text AS message FROM u)")
    with_classes, last = classes.rsplit("\nSELECT", 1)
    failures = FAILURES.strip().removeprefix("WITH ").replace("m AS (", "fm AS (", 1).replace(" FROM m ", " FROM fm ").replace("g AS (SELECT r.", "fg AS (SELECT r.").replace(" FROM g ", " FROM fg ").replace("f AS (SELECT session_id, tool_use_id", "ff AS (SELECT session_id, tool_use_id")
    return f"""{USER_MESSAGES.rstrip()}, {with_classes}, cls AS (SELECT{last}), said AS (SELECT u.*, {collapse_key('text')} AS key, cls.confidence, cls.decay_days FROM u JOIN cls ON u.message_id = cls.item_id WHERE kind IS NOT NULL),
cor AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY project_folder, key ORDER BY sent_ts DESC NULLS LAST, message_id) = 1), {failures},
fold AS (SELECT session_id, min(project_folder) AS project_folder FROM message GROUP BY 1), er AS (SELECT project_folder, {error_type('text')} AS error_type FROM ff JOIN fold ON ff.session_id = fold.session_id WHERE kind = 'failure'), ep AS (SELECT project_folder, error_type FROM er WHERE error_type IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
items AS (SELECT sha256(concat_ws('|', 'correction', project_folder, key)) AS dedup_key, 'correction' AS item_kind, project_folder, {redact('text')} AS message, confidence, decay_days FROM cor
UNION ALL SELECT sha256(concat_ws('|', 'error', project_folder, error_type)), 'error', project_folder, CASE error_type {' '.join(f'WHEN {quoted(n)} THEN {quoted(g)}' for n, _, g in fixed.ERRORS)} END, 0.6::DOUBLE, 180 FROM ep)
SELECT * FROM items WHERE dedup_key NOT IN (SELECT sha256(concat_ws('|', 'correction', namespace, {collapse_key('message')})) FROM correction_item)"""
