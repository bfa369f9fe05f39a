"""The named queries of the core over the test tables, and the SQL each is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed, policy
from factloom.functions import text as T
from factloom.operators import consolidate, diagnostics, mining, records, render, search, semantic
from factloom.plans import sql as Q
from factloom.session import checkpoint_dir
from factloom.sources import sync
from factloom.store import Store
from factloom.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
TERMS = "cache queue timeout"
PROJECT = "project:relay-core"
QUERIES: dict[str, tuple[Query, str | None]] = {}


SYNC_OUTCOMES = f"""WITH k AS (SELECT id, superseded_at IS NULL AS live FROM memory), h AS (SELECT DISTINCT namespace, {Q.norm('content')} AS norm FROM memory WHERE superseded_at IS NULL),
r AS (SELECT row_id, b.id, b.namespace, {Q.norm('content')} AS norm, row(batch_no, line_no) AS ord, {Q.REJECT} AS reject, k.live AS known FROM memory_batch b LEFT JOIN k ON b.id = k.id),
e AS (SELECT *, reject IS NULL AND known IS NULL AND ord = min(CASE WHEN reject IS NULL AND known IS NULL THEN ord END) OVER (PARTITION BY id) AS entering FROM r),
f AS (SELECT e.*, h.norm IS NOT NULL AS have, min(CASE WHEN entering THEN ord END) OVER (PARTITION BY e.namespace, e.norm) AS first FROM e LEFT JOIN h ON e.namespace = h.namespace AND e.norm = h.norm)
SELECT row_id, CASE WHEN reject IS NOT NULL THEN 'malformed' WHEN known IS NOT NULL THEN 'skipped' WHEN have THEN 'deduped' WHEN entering AND ord = first THEN 'added' WHEN first < ord THEN CASE WHEN entering THEN 'deduped' ELSE 'skipped' END ELSE 'skipped' END AS outcome FROM f"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def now() -> F.Column:
    """The present of the test tables."""
    return F.timestamp_micros(F.lit(Q.NOW_US))


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "memory")


_STORED: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def index_path(spark: SparkSession, sf_dir: str) -> str:
    """The stored index of the records; a session makes it once for each folder of tables, and its recalls read postings only."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORED:
        path = shared_folder(spark, "index")
        search.write_index(memory(spark, sf_dir), path)
        _STORED[at] = path
    return _STORED[at]


def micros(col: str) -> F.Column:
    return F.unix_micros(col)


# Retrieval


@query(f"""{Q.bm25(TERMS)} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY bm25 DESC, id LIMIT 20""")
def recall_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(memory(spark, sf_dir), TERMS, index_path=index_path(spark, sf_dir)).orderBy(F.col("bm25").desc(), "id").limit(20).select("id", F.round("bm25", 6).alias("bm25"))


@query(f"""{Q.bm25(TERMS)}, {Q.tier('one', f"namespace = '{PROJECT}'", 10, fixed.RECALL_FLOOR)} SELECT id, namespace, round(score, 4) AS score, round(confidence, 3) AS confidence FROM one""")
def recall_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recall(memory(spark, sf_dir), TERMS, now(), PROJECT, 10, index_path=index_path(spark, sf_dir))


@query(f"""{Q.bm25(TERMS)}, {Q.tier('one', f"namespace = '{PROJECT}'", 5, fixed.RECALL_FLOOR)}, {Q.tier('two', f"namespace = '{fixed.GLOBAL_NAMESPACE}'", 3, fixed.RECALL_FLOOR)}
SELECT id, namespace, round(score, 4) AS score, round(confidence, 3) AS confidence, 1 AS tier FROM one
UNION ALL SELECT id, namespace, round(score, 4), round(confidence, 3), 2 FROM two WHERE id NOT IN (SELECT id FROM one)""")
def recall_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recall_tiers(memory(spark, sf_dir), TERMS, now(), PROJECT, index_path=index_path(spark, sf_dir))


@query(f"""{Q.bm25('no relay')}, {Q.tier('one', 'true', 10, 0.0)} SELECT id, namespace, round(score, 4) AS score, round(confidence, 3) AS confidence FROM one""")
def search_floor0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recall(memory(spark, sf_dir), "no relay", now(), None, 10, 0.0, index_path=index_path(spark, sf_dir))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(concat_ws(' ', content, tags, namespace)), '[a-z0-9]+')) AS term, id FROM memory)
SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM w GROUP BY term""")
def postings_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(memory(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"""WITH r AS (SELECT id, namespace, type, confidence, ingestion_ts FROM memory WHERE superseded_at IS NULL AND {Q.USABLE} >= {fixed.RECENT_FLOOR}),
a AS (SELECT * FROM r WHERE namespace = '{PROJECT}' ORDER BY ingestion_ts DESC NULLS LAST, id LIMIT 5), b AS (SELECT * FROM r WHERE namespace = '{fixed.GLOBAL_NAMESPACE}' ORDER BY ingestion_ts DESC NULLS LAST, id LIMIT 3)
SELECT id, namespace, type, round(confidence, 3) AS confidence, 1 AS tier FROM a UNION ALL SELECT id, namespace, type, round(confidence, 3), 2 FROM b WHERE id NOT IN (SELECT id FROM a)""")
def recent_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent_tiers(memory(spark, sf_dir), PROJECT)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT e FROM q)), 5) AS sim FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], (SELECT e FROM q)) DESC, vec_id LIMIT 10""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings")
    return search.nearest(v, vector(v, 0), 10).select("vec_id", F.round("sim", 5).alias("sim"))


def vector(v: DataFrame, vec_id: int) -> list[float]:
    row = v.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [0.0] if row is None else row["embedding"]


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM p) SELECT query_id, id, rank, round(sim, 5) AS sim FROM r WHERE rank <= 5""")
def knn_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.nearest_many(v, v.filter("vec_id % 50 = 0"), 5).select("query_id", "id", "rank", F.round("sim", 5).alias("sim"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label = v.label AS same, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM p), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM r WHERE rank <= 5 AND same AND sim >= 0.3)
SELECT query_id, id AS dup_of, round(sim, 5) AS sim FROM h WHERE nth = 1""")
def semantic_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the five nearest of any label the first with the query's label at or above the threshold: the reference's cut, which
    its SQL fixes and which loses duplicates at rank 6 and later. semantic_duplicates_by_label has no cut."""
    v = t(spark, sf_dir, "embeddings")
    near = search.nearest_many(v.select("vec_id", "embedding"), v.filter("vec_id % 50 = 0").select("vec_id", "embedding"), 5)
    a, b = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), v.select(F.col("vec_id").alias("id"), F.col("label").alias("vl"))
    hit = near.join(a, "query_id").join(b, "id").filter((F.col("ql") == F.col("vl")) & (F.col("sim") >= 0.3))
    return hit.groupBy("query_id").agg(F.min_by("id", "rank").alias("dup_of"), F.round(F.min_by("sim", "rank"), 5).alias("sim"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM p) SELECT query_id, id AS dup_of, round(sim, 5) AS sim FROM r WHERE rank = 1 AND sim >= 0.3""")
def semantic_duplicates_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors with the query's label, at or above the threshold: filtered before they are ranked."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    near = search.nearest_many(v, v.filter("vec_id % 50 = 0"), 1, within="label").filter("sim >= 0.3")
    return near.select("query_id", F.col("id").alias("dup_of"), F.round("sim", 5).alias("sim"))


@query("""WITH d AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS a, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) AS b FROM embeddings),
l AS (SELECT vec_id, rank FROM (SELECT vec_id, row_number() OVER (ORDER BY a DESC, vec_id) AS rank FROM d) WHERE rank <= 50 UNION ALL SELECT vec_id, rank FROM (SELECT vec_id, row_number() OVER (ORDER BY b DESC, vec_id) AS rank FROM d) WHERE rank <= 50)
SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf FROM l GROUP BY vec_id""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings")
    w = search.Window.orderBy(F.col("sim").desc(), F.col("vec_id"))
    lists = [search.nearest(v, vector(v, i), 50).withColumn("rank", F.row_number().over(w)) for i in (0, 1)]
    return search.fuse(*lists, id_col="vec_id").select("vec_id", F.round("rrf", 6).alias("rrf"))


def assigned(m: DataFrame, n: int) -> DataFrame:
    """id and vec_id: the test tables have no vectors of records, so each record is given one of n by the hash of its id."""
    return m.select("id", F.pmod(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long"), F.lit(max(n, 1))).alias("vec_id"))


@query(Q.hybrid(TERMS))
def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings")
    m = memory(spark, sf_dir)
    vec = assigned(m, v.count()).join(v.select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    return search.hybrid(m, TERMS, vec, vector(v, 0), now(), 10, index_path=index_path(spark, sf_dir))


@query(Q.hybrid_tiers(TERMS, PROJECT, "project:lantern"))
def recall_hybrid_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tiers, the first with an alias, by text and vectors, after demotion of rows whose source has changed."""
    v, m = t(spark, sf_dir, "embeddings"), memory(spark, sf_dir)
    vec = assigned(m, v.count()).join(v.select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    current = m.filter("source_hash is not null and source_ref is not null").groupBy("source_ref").agg(F.max("source_hash").alias("current_hash"))
    return search.recall_all(m, TERMS, now(), PROJECT, current=current, include_global=True, aliases={"project:lantern": PROJECT}, vectors=vec, query_vector=vector(v, 0), index_path=index_path(spark, sf_dir))


@query(f"""{Q.bm25(TERMS)}, {Q.tier('one', f"namespace = '{PROJECT}'", 5, fixed.RECALL_FLOOR)}, {Q.tier('two', f"namespace = '{fixed.GLOBAL_NAMESPACE}'", 3, fixed.RECALL_FLOOR)}
SELECT m.id, coalesce(retrieval_count, 0) + (s.id IS NOT NULL)::BIGINT AS retrieval_count, coalesce(surfaced_count, 0) AS surfaced_count FROM memory m LEFT JOIN (SELECT id FROM one UNION SELECT id FROM two) s ON m.id = s.id""")
def recall_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after an explicit recall."""
    m = memory(spark, sf_dir)
    found = search.recall_tiers(m, TERMS, now(), PROJECT, index_path=index_path(spark, sf_dir))
    return records.bump(m, search.telemetry(found, now())).select("id", "retrieval_count", "surfaced_count")


@query("""SELECT x.label, x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS sim FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id AND list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.4""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = semantic.cosine_pairs(t(spark, sf_dir, "embeddings"), 0.4, "label", "vec_id", recall=0.99999)
    return pairs.select("label", "a", "b", F.round("sim", 5).alias("sim"))


@query(Q.detect("memory_batch"))
def detect_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the batches that a live record stands for, by vector first, then by text. A content's vector is picked by its hash."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.count()
    picked = lambda d, key: d.withColumn("vec_id", F.pmod(F.conv(F.substring(F.md5(F.encode(F.coalesce("content", F.lit("")), "UTF-8")), 1, 6), 16, 10).cast("long"), F.lit(max(n, 1)))).join(v, "vec_id").select(*key, "embedding")
    m, b = memory(spark, sf_dir), t(spark, sf_dir, "memory_batch")
    found = semantic.detect_duplicates(picked(b, ["row_id", "namespace", "content"]), m, picked(m, ["id"]))
    return found.select("row_id", "dup_of", F.round("sim", 5).alias("sim"), "how")


@query("""WITH e AS (SELECT id, count(*) FILTER (line_no % 2 = 0) AS r, max(arrived_ts) FILTER (line_no % 2 = 0) AS rt, count(*) FILTER (line_no % 2 = 1) AS s, max(arrived_ts) FILTER (line_no % 2 = 1) AS st FROM memory_batch GROUP BY id)
SELECT m.id, coalesce(retrieval_count, 0) + coalesce(r, 0) AS retrieval_count, coalesce(surfaced_count, 0) + coalesce(s, 0) AS surfaced_count, epoch_us(greatest(last_retrieved, rt)) AS last_retrieved, epoch_us(greatest(last_surfaced, st)) AS last_surfaced FROM memory m LEFT JOIN e ON m.id = e.id""")
def telemetry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "memory_batch").select("id", F.when(F.col("line_no") % 2 == 0, "explicit").otherwise("passive").alias("kind"), F.col("arrived_ts").alias("ts"))
    return records.bump(memory(spark, sf_dir), events).select("id", "retrieval_count", "surfaced_count", micros("last_retrieved").alias("last_retrieved"), micros("last_surfaced").alias("last_surfaced"))


# Filters, point access, statistics


@query("SELECT id, namespace, type FROM memory WHERE superseded_at IS NULL")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.live(memory(spark, sf_dir)).select("id", "namespace", "type")


@query("""SELECT id, namespace, type, substr(content, 1, 80) AS preview, CASE WHEN superseded_at IS NULL THEN 'live' ELSE concat_ws(': ', 'superseded', supersede_reason) END AS status
FROM memory WHERE namespace = 'user:global' ORDER BY ingestion_ts DESC NULLS LAST, id LIMIT 50""")
def list_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.listing(memory(spark, sf_dir), fixed.GLOBAL_NAMESPACE, 50, True)


@query("SELECT id, namespace, type, content, tags FROM memory WHERE id = (SELECT min(id) FROM memory)")
def get_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory(spark, sf_dir)
    return records.get(m, m.agg(F.min("id")).first()[0]).select("id", "namespace", "type", "content", "tags")


@query("SELECT namespace, count(*) AS n FROM memory WHERE namespace IN ('user:global', 'USER:GLOBAL', 'project:lantern') GROUP BY namespace")
def namespace_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.in_namespaces(memory(spark, sf_dir), ["user:global", "project:lantern"], {"USER:GLOBAL": "user:global", "a": "b"}).groupBy("namespace").agg(F.count("*").alias("n"))


@query(f"SELECT type, count(*) AS n FROM memory WHERE superseded_at IS NULL AND {Q.USABLE} >= {fixed.RECALL_FLOOR} GROUP BY type")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.live(memory(spark, sf_dir)).filter(search.sure(fixed.RECALL_FLOOR)).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT source_ref, max(source_hash) AS h FROM memory WHERE source_hash IS NOT NULL AND source_ref IS NOT NULL GROUP BY source_ref)
SELECT id, coalesce(source_hash <> h, false) AS stale, round(CASE WHEN coalesce(source_hash <> h, false) THEN 0.5 ELSE 1.0 END * ({Q.USABLE}), 6) AS confidence
FROM memory m LEFT JOIN c ON m.source_ref = c.source_ref WHERE superseded_at IS NULL""")
def staleness_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory(spark, sf_dir)
    current = m.filter("source_hash is not null and source_ref is not null").groupBy("source_ref").agg(F.max("source_hash").alias("current_hash"))
    return records.with_staleness(records.live(m), current).select("id", "stale", F.round("confidence", 6).alias("confidence"))


@query("""SELECT DISTINCT session_id FROM tool_usage WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT regexp_extract(source_ref, '^session:(.+)$', 1) FROM memory WHERE superseded_at IS NULL AND source_ref LIKE 'session:%')""")
def lessons_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.lessons_missing(t(spark, sf_dir, "tool_usage").filter("session_id is not null"), memory(spark, sf_dir))


@query("""SELECT id, namespace FROM memory WHERE superseded_at IS NULL AND coalesce(retrieval_count, 0) = 0 AND coalesce(surfaced_count, 0) = 0 AND signal = 'none' AND confidence BETWEEN 0 AND 1 AND confidence < 0.35
AND (ingestion_ts AT TIME ZONE 'UTC')::DATE < DATE '2026-01-01' - 30""")
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.prune_candidates(memory(spark, sf_dir), now()).select("id", "namespace")


@query(f"""WITH p AS (SELECT *, coalesce(retrieval_count, 0) + coalesce(surfaced_count, 0) AS uses, {Q.one_line('content')} AS line FROM memory WHERE superseded_at IS NULL AND type = 'lesson' AND signal IN ('test', 'compile', 'lint') AND {Q.USABLE} >= 0.85 AND coalesce(retrieval_count, 0) + coalesce(surfaced_count, 0) > 3),
s AS (SELECT *, CASE WHEN regexp_extract(line, '^(.*?[.!?])(?:\\s|$)', 1) = '' THEN line ELSE regexp_extract(line, '^(.*?[.!?])(?:\\s|$)', 1) END AS sent,
list_filter(list_transform({Q.tag_list('lower(tags)')}, lambda x: regexp_replace(regexp_replace(x, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x <> '')[1:4] AS sl FROM p)
SELECT id, namespace, uses, confidence, CASE WHEN array_to_string(sl, '-') <> '' THEN array_to_string(sl, '-') ELSE substr(id, 1, 8) END AS slug,
CASE WHEN length(sent) <= 220 THEN sent ELSE regexp_replace(substr(sent, 1, 220), '\\s+\\S*$', '') END AS trigger_line FROM s""")
def promote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.promote_candidates(memory(spark, sf_dir))


@query(f"SELECT namespace, count(*) AS n FROM memory WHERE {Q.NEAR_MISS} GROUP BY namespace")
def namespace_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).filter(T.near_miss(F.col("namespace"))).groupBy("namespace").agg(F.count("*").alias("n"))


@query(f"SELECT id, namespace, 'user:global' AS new_namespace FROM memory WHERE superseded_at IS NULL AND {Q.NEAR_MISS}")
def rekey_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rekey(memory(spark, sf_dir)).select("id", "namespace", "new_namespace")


@query("SELECT CASE namespace WHEN 'project:relay-core' THEN 'git.example.org/team/relay-core' WHEN 'USER:GLOBAL' THEN 'user:global' ELSE namespace END AS namespace, count(*) AS n, count(superseded_at) AS dead FROM memory GROUP BY 1")
def rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, tombstones too, under their new keys, as a migration from version 4 leaves them."""
    out = sync.migrated(memory(spark, sf_dir).drop("surfaced_count", "merged_from"), 4, {PROJECT: "git.example.org/team/relay-core", "USER:GLOBAL": "user:global"})
    return out.groupBy("namespace").agg(F.count("*").alias("n"), F.count("superseded_at").alias("dead"))


@query("""SELECT m.id, epoch_us(coalesce(superseded_at, b.ts)) AS superseded_at, CASE WHEN superseded_at IS NULL AND b.id IS NOT NULL THEN 'synced' ELSE supersede_reason END AS supersede_reason
FROM memory m LEFT JOIN (SELECT id, max(arrived_ts) AS ts FROM memory_batch GROUP BY id) b ON m.id = b.id""")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = t(spark, sf_dir, "memory_batch").groupBy("id").agg(F.max("arrived_ts").alias("superseded_at")).withColumn("reason", F.lit("synced"))
    return records.supersede(memory(spark, sf_dir), marks, now()).select("id", micros("superseded_at").alias("superseded_at"), "supersede_reason")


@query("SELECT count(*) AS total, count(*) FILTER (superseded_at IS NULL) AS live, count(*) FILTER (superseded_at IS NOT NULL) AS superseded FROM memory")
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stats(memory(spark, sf_dir))


@query("SELECT namespace, count(*) AS n FROM memory WHERE superseded_at IS NULL GROUP BY namespace")
def stats_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.live_counts(memory(spark, sf_dir), "namespace")


@query("SELECT signal, count(*) AS n FROM memory WHERE superseded_at IS NULL GROUP BY signal")
def stats_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.live_counts(memory(spark, sf_dir), "signal")


@query("""SELECT label, count(*) AS n, count(*) FILTER (embedding IS NOT NULL AND len(embedding) > 0) AS with_vector FROM embeddings GROUP BY label""")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings")
    return v.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).alias("with_vector"))


@query("""SELECT v.id FROM (SELECT id, CAST('0x' || substr(md5(id), 1, 6) AS BIGINT) % (SELECT count(*) + count(*) * 2 // 5 FROM embeddings) AS vec_id FROM memory WHERE superseded_at IS NULL) v WHERE vec_id NOT IN (SELECT vec_id FROM embeddings)""")
def reembed_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows whose vector is missing from the index."""
    v = t(spark, sf_dir, "embeddings").select("vec_id")
    n = v.count()
    return assigned(records.live(memory(spark, sf_dir)), n + n * 2 // 5).join(v, "vec_id", "left_anti").select("id")


@query(f"SELECT count(DISTINCT namespace) AS n FROM memory WHERE {Q.NEAR_MISS}")
def stranded_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).filter(T.near_miss(F.col("namespace"))).agg(F.count_distinct("namespace").alias("n"))


@query("""SELECT live, round((live - 3000) / greatest(3000, 1), 6) AS growth, NOT (date_diff('day', DATE '2025-12-28', DATE '2026-01-01') < 7 AND (live - 3000) / greatest(3000, 1) < 0.2) AS due FROM (SELECT count(*) AS live FROM memory WHERE superseded_at IS NULL)""")
def cadence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cadence(memory(spark, sf_dir), F.lit("2025-12-28").cast("date"), now(), F.lit(3000))


@query("""WITH s AS (SELECT 'batch-' || batch_no AS name, max(arrived_ts) AS mtime FROM memory_batch GROUP BY batch_no), r AS (SELECT name, row_number() OVER (ORDER BY mtime DESC NULLS LAST, name) AS nth FROM s) SELECT name FROM r WHERE nth > 3""")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "memory_batch").groupBy(F.concat(F.lit("batch-"), "batch_no").alias("name")).agg(F.max("arrived_ts").alias("mtime"))
    return records.retention(s, 3).select("name")


@query("""SELECT a.total AS total_a, a.live AS live_a, a.total AS total_b, a.live AS live_b, true AS agrees FROM (SELECT count(*) AS total, count(*) FILTER (superseded_at IS NULL) AS live FROM memory) a""")
def snapshot_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and the snapshot that was written of it."""
    m, path = memory(spark, sf_dir), shared_folder(spark, "snapshot")
    sync.snapshot(m, path)
    return sync.agreement(m, spark.read.parquet(path))


# Text kernels and policy


@query(f"SELECT id, md5({Q.norm('content')}) AS norm_md5 FROM memory")
def content_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.with_norm(memory(spark, sf_dir)).select("id", F.md5(F.encode("content_norm", "UTF-8")).alias("norm_md5"))


@query(f"SELECT id, len({Q.lexical('content')}) AS n, md5(array_to_string({Q.lexical('content')}, ' ')) AS toks_md5 FROM memory")
def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory(spark, sf_dir).select("id", T.lexical_tokens(F.col("content")).alias("toks"))
    return m.select("id", F.size("toks").cast("long").alias("n"), F.md5(F.encode(F.array_join("toks", " "), "UTF-8")).alias("toks_md5"))


@query(f"SELECT id, {Q.negated('content')} AS negated FROM memory")
def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).select("id", T.negated(F.col("content")).alias("negated"))


@query(f"SELECT doc_id, {Q.any_match('text', fixed.SECRETS)} AS has_secret, {Q.any_match('text', fixed.INJECTIONS)} AS has_injection FROM documents")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", policy.has_secret(F.col("text")).alias("has_secret"), policy.has_injection(F.col("text")).alias("has_injection"))


@query(f"""WITH d AS (SELECT doc_id, concat('api_key = abcdefgh', doc_id, ' ', coalesce(text, '')) AS text FROM documents) SELECT doc_id, md5({Q.redact('text')}) AS text_md5 FROM d""")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("api_key = abcdefgh"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(policy.redacted(text)[0], "UTF-8")).alias("text_md5"))


@query(f"""WITH b AS (SELECT row_id, CASE WHEN row_id % 7 = 0 THEN content || ' token: abcdefghij' ELSE content END AS content, CASE WHEN row_id % 11 = 0 THEN 'password=hunter2hunter2' ELSE source_ref END AS source_ref, CASE WHEN row_id % 5 = 0 THEN tags || ',system prompt' ELSE tags END AS tags FROM memory_batch),
o AS (SELECT *, CASE WHEN {Q.any_match("coalesce(source_ref, '')", fixed.SECRETS)} THEN 'refused' WHEN {Q.any_match("coalesce(content, '')", fixed.SECRETS)} OR {Q.any_match("coalesce(tags, '')", fixed.SECRETS)} THEN 'redacted' ELSE 'clean' END AS outcome FROM b),
n AS (SELECT *, CASE WHEN outcome = 'redacted' THEN {Q.redact('content')} ELSE content END AS c2, CASE WHEN outcome = 'redacted' THEN {Q.with_tag(Q.redact('tags'), 'auto-redacted')} ELSE tags END AS t2 FROM o)
SELECT row_id, outcome, md5(c2) AS content_md5, CASE WHEN {Q.any_match("concat_ws(' ', nullif(c2, ''), nullif(source_ref, ''), nullif(t2, ''))", fixed.INJECTIONS)} THEN {Q.with_tag('t2', 'prompt-injection-risk')} ELSE t2 END AS tags FROM n""")
def capture_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t(spark, sf_dir, "memory_batch").select(
        "row_id", F.when(F.col("row_id") % 7 == 0, F.concat("content", F.lit(" token: abcdefghij"))).otherwise(F.col("content")).alias("content"),
        F.when(F.col("row_id") % 11 == 0, "password=hunter2hunter2").otherwise(F.col("source_ref")).alias("source_ref"), F.when(F.col("row_id") % 5 == 0, F.concat("tags", F.lit(",system prompt"))).otherwise(F.col("tags")).alias("tags"),
    )
    return policy.capture(b, "auto").select("row_id", "outcome", F.md5(F.encode("new_content", "UTF-8")).alias("content_md5"), F.col("new_tags").alias("tags"))


@query("""SELECT id, CASE WHEN ingestion_ts IS NULL THEN '' WHEN s < 0 THEN strftime(ingestion_ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age
FROM (SELECT id, ingestion_ts, 1767225600 - epoch_us(ingestion_ts) // 1000000 AS s FROM memory)""")
def recency_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).select("id", T.age_text(F.col("ingestion_ts"), now()).alias("age"))


@query(r"""WITH u AS (SELECT DISTINCT namespace, CASE length(namespace) % 4 WHEN 0 THEN 'git@GIT.example.org:team/' || split_part(namespace, ':', -1) || '.git' WHEN 1 THEN 'https://me:pw@git.example.org:8443/team/' || split_part(namespace, ':', -1) || '/' WHEN 2 THEN 'http://local_proxy@127.0.0.1:4711/git/team/' || split_part(namespace, ':', -1) ELSE namespace END AS url FROM memory WHERE namespace LIKE 'project:%'),
x AS (SELECT namespace, regexp_extract(regexp_replace(url, '(\.git)?/*$', ''), '^(?:[a-z+]+://)?(?:[^@/]+@)?([^:/]+)(?::\d+)?[:/]+(.+)$', ['h', 'p']) AS k FROM u)
SELECT namespace, CASE WHEN k.h = '' OR NOT contains(k.p, '/') THEN NULL WHEN k.h IN ('localhost', '127.0.0.1') AND regexp_matches(k.p, '^git/[^/]+/[^/]+$') THEN 'github.com/' || substr(k.p, 5) ELSE lower(k.h) || '/' || k.p END AS remote FROM x""")
def remote_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remotes in ssh and http form and behind a local proxy, made from the project names; every fourth name is no remote."""
    name, n = F.substring_index("namespace", ":", -1), F.length("namespace") % 4
    url = F.when(n == 0, F.concat(F.lit("git@GIT.example.org:team/"), name, F.lit(".git"))).when(n == 1, F.concat(F.lit("https://me:pw@git.example.org:8443/team/"), name, F.lit("/"))).when(n == 2, F.concat(F.lit("http://local_proxy@127.0.0.1:4711/git/team/"), name)).otherwise(F.col("namespace"))
    return memory(spark, sf_dir).filter(F.col("namespace").startswith("project:")).select("namespace").distinct().select("namespace", T.remote_key(url).alias("remote"))


@query(r"""SELECT DISTINCT namespace, array_to_string(list_transform(string_split(namespace, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9.\-]$') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '_\1', 'g') END), '') AS file FROM memory WHERE namespace IS NOT NULL""")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).filter("namespace is not null").select("namespace").distinct().select("namespace", T.file_key(F.col("namespace")).alias("file"))


@query(r"""WITH p AS (SELECT DISTINCT project_folder, CASE WHEN length(project_folder) % 2 = 0 THEN '/srv/work_a/' ELSE 'E:\Work-b\' END || project_folder AS path FROM message WHERE project_folder IS NOT NULL),
d AS (SELECT project_folder, '-' || regexp_replace(translate(path, '/\', '--'), '^-', '') AS x, regexp_extract(path, '([^/\\]+)$', 1) AS base FROM p),
c AS (SELECT project_folder, list_filter([x, CASE WHEN contains(base, '-') AND ends_with(x, base) THEN substr(x, 1, length(x) - length(base)) || translate(base, '-', '_') END, CASE WHEN contains(x, ':') THEN translate(substr(x, 2), ':', '-') END], lambda y: y IS NOT NULL) AS l FROM d)
SELECT project_folder, array_to_string(l, '|') AS names FROM c""")
def folder_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = t(spark, sf_dir, "message").filter("project_folder is not null").select("project_folder").distinct()
    path = F.concat(F.when(F.length("project_folder") % 2 == 0, F.lit("/srv/work_a/")).otherwise(F.lit("E:\\Work-b\\")), "project_folder")
    return folders.select("project_folder", F.array_join(mining.folder_candidates(path), "|").alias("names"))


@query(r"""SELECT id, regexp_replace(regexp_replace('https://' || CASE WHEN type = 'fact' THEN 'me:pw@' ELSE '' END || 'a.example/' || id || '?token=' || id || '#f', '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\1'), '[?#].*$', '') AS url FROM memory""")
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://"), F.when(F.coalesce(F.col("type") == "fact", F.lit(False)), "me:pw@").otherwise(""), F.lit("a.example/"), "id", F.lit("?token="), "id", F.lit("#f"))
    return memory(spark, sf_dir).select("id", T.public_url(url).alias("url"))


@query(f"SELECT id, list_contains({Q.tag_list('tags')}, 'prompt-injection-risk') AS risky FROM (SELECT id, CASE WHEN type = 'fact' THEN tags || ', prompt-injection-risk' ELSE tags END AS tags FROM memory)")
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("type") == "fact", F.concat("tags", F.lit(", prompt-injection-risk"))).otherwise(F.col("tags"))
    return memory(spark, sf_dir).select("id", T.is_risky(tags).alias("risky"))


@query("""WITH s AS (SELECT doc_id, try_cast(CASE doc_id % 4 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN '-5' WHEN 2 THEN 'x' || n_chars ELSE (n_chars * 1000)::VARCHAR END AS DOUBLE) AS n FROM documents)
SELECT doc_id, (CASE WHEN n IS NULL OR n <= 0 THEN 9000 ELSE least(floor(n), 1000000) END)::INTEGER AS budget FROM s""")
def budget_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("doc_id") % 4, F.col("n_chars").cast("string")
    setting = F.when(k == 0, n).when(k == 1, F.lit("-5")).when(k == 2, F.concat(F.lit("x"), n)).otherwise((F.col("n_chars") * 1000).cast("string"))
    return t(spark, sf_dir, "documents").select("doc_id", render.budget_of(setting).alias("budget"))


@query("""SELECT doc_id, list_max(list_filter(range(0, least(length(text), 120) + 1), lambda n: strlen(to_json(substr(text, 1, n))::VARCHAR) <= 120)) AS n FROM documents WHERE text IS NOT NULL""")
def envelope_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of each text fit an envelope of 120 bytes as a JSON string."""
    return t(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.length(render.fit_json(F.col("text"), 120)).cast("long").alias("n"))


# Dedup and consolidation


@query(f"SELECT namespace, min(id) AS first_id, count(*) AS n FROM (SELECT namespace, id, {Q.norm('content')} AS norm FROM memory WHERE superseded_at IS NULL) GROUP BY namespace, norm HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.exact_duplicates(memory(spark, sf_dir)).select("namespace", "first_id", "n")


@query(f"""SELECT b.row_id, m.id AS dup_of FROM (SELECT row_id, namespace, {Q.norm('content')} AS norm FROM memory_batch) b JOIN (SELECT namespace, {Q.norm('content')} AS norm, min(id) AS id FROM memory WHERE superseded_at IS NULL GROUP BY 1, 2) m ON b.namespace = m.namespace AND b.norm = m.norm""")
def known_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.known_duplicates(t(spark, sf_dir, "memory_batch"), memory(spark, sf_dir))


@query(f"""WITH r AS (SELECT *, {Q.norm('content')} AS norm, {Q.SIGNAL_RANK} AS rank, {Q.USABLE} AS sure FROM memory WHERE superseded_at IS NULL)
SELECT namespace, list(id ORDER BY ingestion_ts NULLS FIRST, id)[1] AS id, max(sure) AS confidence, list(signal ORDER BY rank DESC, ingestion_ts NULLS FIRST, id)[1] AS signal,
array_to_string(list_sort(list_distinct(flatten(list({Q.tag_list('tags')})))), ',') AS tags, list(coalesce(retrieval_count, 0) ORDER BY ingestion_ts NULLS FIRST, id)[1] + count(*) - 1 AS retrieval_count, count(*) AS folded FROM r GROUP BY namespace, norm""")
def merge_on_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sync.with_norm(records.live(memory(spark, sf_dir)))
    return consolidate.merged_metadata(m, ["namespace", "content_norm"], ["ingestion_ts", "id"]).drop("content_norm")


@query(f"""WITH r AS (SELECT id, row_number() OVER (PARTITION BY namespace ORDER BY coalesce({Q.USABLE}, 0) * (coalesce(retrieval_count, 0) + coalesce(surfaced_count, 0)) DESC, {Q.USABLE} DESC NULLS LAST, ingestion_ts NULLS FIRST, id) AS place FROM memory WHERE superseded_at IS NULL) SELECT id, place FROM r WHERE place <= 20""")
def candidate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.candidate_window(memory(spark, sf_dir), 20).select("id", "place")


@query(f"""WITH s AS (SELECT namespace, toks, min(id) AS id FROM (SELECT namespace, id, {Q.lexical('content')} AS toks FROM memory WHERE superseded_at IS NULL) WHERE len(toks) > 0 GROUP BY namespace, toks), p AS (SELECT x.namespace, x.id AS a, y.id AS b, len(list_intersect(x.toks, y.toks)) AS i, len(x.toks) AS n, len(y.toks) AS m FROM s x JOIN s y ON x.namespace = y.namespace AND x.id < y.id AND least(len(x.toks), len(y.toks)) >= 0.59 * greatest(len(x.toks), len(y.toks)))
SELECT namespace, a, b, round(i / (n + m - i), 6) AS sim FROM p WHERE i / (n + m - i) >= 0.6""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal tokens, each named by its smallest id; jaccard_classes says which rows a class holds."""
    rows = records.live(memory(spark, sf_dir))
    named = consolidate.lexical_classes(rows).select(F.col("class_id").alias("id")).distinct()
    return consolidate.lexical_pairs(rows.join(named, "id", "left_semi")).select("namespace", "a", "b", F.round("sim", 6).alias("sim"))


@query(f"SELECT namespace, id, min(id) OVER (PARTITION BY namespace, toks) AS class_id FROM (SELECT namespace, id, {Q.lexical('content')} AS toks FROM memory WHERE superseded_at IS NULL) WHERE len(toks) > 0")
def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.lexical_classes(records.live(memory(spark, sf_dir)))


@query(f"""WITH k AS (SELECT namespace, min(id) AS keeper FROM memory WHERE superseded_at IS NULL GROUP BY namespace), j AS (SELECT m.id AS member, c.content AS kc, m.content AS mc FROM memory m JOIN k ON m.namespace = k.namespace JOIN memory c ON c.id = k.keeper WHERE m.superseded_at IS NULL AND m.id <> k.keeper)
SELECT member, CASE WHEN {Q.norm('mc')} = '' THEN 'empty' WHEN contains({Q.norm('kc')}, {Q.norm('mc')}) THEN 'already-represented' WHEN length(kc) + length(mc) + 20 + length(member) + 6 > 65536 THEN 'size-cap' ELSE 'unique' END AS reason,
len(list_filter({Q.plain('mc')}, lambda x: NOT list_contains({Q.plain('kc')}, x))) AS n_new FROM j""")
def absorb_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What folding each live row into the first of its namespace would do."""
    m = records.live(memory(spark, sf_dir)).select("namespace", "id", "content")
    keepers = m.groupBy("namespace").agg(F.min_by("content", "id").alias("kc"), F.min("id").alias("keeper"))
    j = m.join(keepers, "namespace").filter("id <> keeper")
    return j.select(F.col("id").alias("member"), consolidate.absorb_reason(F.col("kc"), F.col("content"), F.col("id")).alias("reason"), F.size(consolidate.new_tokens(F.col("kc"), F.col("content"))).cast("long").alias("n_new"))


@query(Q.CLUSTERS + "SELECT namespace, keeper, unnest(list_transform(members, lambda x: x.id)) AS member, contested FROM s WHERE len(members) > 0")
def consolidate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.clusters(memory(spark, sf_dir))


@query(Q.FOLD + """, e AS (SELECT unnest(string_split(z.ids, ',')) AS m FROM f), c AS (SELECT * FROM s WHERE len(members) > 0)
SELECT (SELECT coalesce(sum(len(members)) FILTER (NOT contested), 0)::BIGINT FROM c) AS merged, (SELECT count(DISTINCT keeper) FILTER (NOT contested) FROM c) AS clusters, (SELECT count(DISTINCT keeper) FILTER (contested) FROM c) AS contested,
(SELECT count(*) FILTER (NOT ends_with(m, ':truncated')) FROM e) AS absorbed, (SELECT count(*) FILTER (ends_with(m, ':truncated')) FROM e) AS truncated_content, (SELECT coalesce(array_to_string(list(keeper || ':' || array_to_string(list_sort(list_transform(members, lambda x: x.id)), ',') ORDER BY namespace, keeper), ' '), '') FROM c WHERE contested) AS contested_clusters, 0::BIGINT AS truncated, 'lexical' AS mode""")
def consolidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory(spark, sf_dir)
    done = consolidate.report(m, consolidate.clusters(m).persist())
    listed = F.array_join(F.transform("contested_clusters", lambda x: F.concat(x["keeper"], F.lit(":"), F.array_join(x["members"], ","))), " ")
    return done.select("merged", "clusters", "contested", "absorbed", "truncated_content", listed.alias("contested_clusters"), "truncated", "mode")


@query(f"SELECT id, md5({Q.SCRUBBED}) AS text_md5 FROM (SELECT id, content || ' at https://a.b/' || id || '?q=1 in /srv/' || id || '/x' AS text FROM memory)")
def error_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("content", F.lit(" at https://a.b/"), "id", F.lit("?q=1 in /srv/"), "id", F.lit("/x"))
    return memory(spark, sf_dir).select("id", F.md5(F.encode(T.scrubbed(text), "UTF-8")).alias("text_md5"))


@query(Q.FOLD + " SELECT keeper AS id, md5(z.c) AS content_md5, z.ids AS merged_from FROM f")
def consolidate_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory(spark, sf_dir)
    return consolidate.fold(m, consolidate.clusters(m)).select("id", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "merged_from")


# Rendering


@query(f"""SELECT id, row_number() OVER (ORDER BY confidence DESC, coalesce(retrieval_count, 0) + coalesce(surfaced_count, 0) DESC, ingestion_ts DESC NULLS LAST, id) AS place FROM memory
WHERE superseded_at IS NULL AND namespace = '{PROJECT}' AND {Q.USABLE} >= 0.6 ORDER BY place LIMIT 50""")
def pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.pack_rows(memory(spark, sf_dir), PROJECT, 50).select("id", "place")


@query(f"""WITH r AS (SELECT type, content, row_number() OVER (ORDER BY confidence DESC, coalesce(retrieval_count, 0) + coalesce(surfaced_count, 0) DESC, ingestion_ts DESC NULLS LAST, id) AS place FROM memory WHERE superseded_at IS NULL AND namespace = '{PROJECT}' AND {Q.USABLE} >= 0.6),
l AS (SELECT list({{'b': strlen('- [' || type || '] ' || {Q.one_line('content')}) + 1, 'k': 0, 's': 0, 't': '- [' || type || '] ' || {Q.one_line('content')} || chr(10)}} ORDER BY place) AS xs FROM r WHERE place <= 50),
f AS (SELECT list_reduce(xs, lambda a, x: CASE WHEN a.b + x.b <= 4000 THEN {{'b': a.b + x.b, 'k': a.k + 1, 's': a.s, 't': a.t || x.t}} ELSE {{'b': a.b, 'k': a.k, 's': a.s + 1, 't': a.t}} END, {{'b': 11::BIGINT, 'k': 0, 's': 0, 't': '## Memory' || chr(10) || chr(10)}}) AS z FROM l)
SELECT z.b AS bytes, z.k AS kept, z.s AS skipped, md5(z.t || CASE WHEN z.s > 0 THEN chr(10) || '(' || z.s || ' omitted)' || chr(10) ELSE '' END) AS pack_md5 FROM f""")
def pack_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_pack(memory(spark, sf_dir), PROJECT, 50, 4000).select("bytes", "kept", "skipped", F.md5(F.encode("pack", "UTF-8")).alias("pack_md5"))


@query(f"""WITH s AS (SELECT namespace, id, length(substr({Q.one_line('content')}, 1, 300)) + 1 AS n, ingestion_ts FROM memory WHERE superseded_at IS NULL), c AS (SELECT namespace, id, sum(n) OVER (PARTITION BY namespace ORDER BY ingestion_ts DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS upto FROM s) SELECT namespace, id, upto::BIGINT AS upto FROM c WHERE upto <= 2000""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.context_rows(records.live(memory(spark, sf_dir)), [F.col("ingestion_ts").desc_nulls_last(), F.col("id")], "namespace", 2000).select("namespace", "id", "upto")


# Sync


@query(f"""SELECT id, namespace, type, md5(content) AS content_md5, tags, source_ref, round({Q.USABLE}, 6) AS confidence, signal, strftime(valid_from AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS valid_from, strftime(ingestion_ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ingestion_ts,
strftime(superseded_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS superseded_at, supersede_reason, merged_from FROM memory""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported lines, tombstones too, read back; what isn't usable of the confidences comes out null."""
    lines = sync.export_lines(memory(spark, sf_dir), include_superseded=True).withColumn("line_no", F.lit(0))
    back = sync.parse_lines(lines).withColumn("confidence", F.col("confidence").try_cast("double"))
    same = ["id", "namespace", "type", "tags", "source_ref", "signal", "valid_from", "ingestion_ts", "superseded_at", "supersede_reason", "merged_from"]
    return back.select(*same, F.md5(F.encode("content", "UTF-8")).alias("content_md5"), F.round(records.usable(), 6).alias("confidence"))


@query(f"""WITH v AS (SELECT *, CASE WHEN signal IN ('test', 'compile', 'lint', 'reviewer', 'user', 'none') THEN signal ELSE 'none' END AS sig FROM memory_batch)
SELECT row_id, {Q.REJECT} AS reject, sig AS signal, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN confidence IS NOT NULL AND isfinite(confidence) THEN confidence ELSE CASE sig WHEN 'test' THEN 0.9 WHEN 'compile' THEN 0.9 WHEN 'lint' THEN 0.85 WHEN 'reviewer' THEN 0.6 WHEN 'user' THEN 0.6 ELSE 0.2 END END)), 6) AS confidence,
CASE WHEN ingestion_ts IS NULL OR epoch_us(ingestion_ts) > 1767225600000000 + 86400000000 THEN 1767225600000000 ELSE epoch_us(ingestion_ts) END AS ts FROM v b""")
def sync_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.validated(t(spark, sf_dir, "memory_batch"), now()).select("row_id", "reject", "signal", F.round("confidence", 6).alias("confidence"), micros("ingestion_ts").alias("ts"))


@query(SYNC_OUTCOMES)
def sync_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.outcomes(t(spark, sf_dir, "memory_batch"), memory(spark, sf_dir), now())


@query(Q.SYNC_AUTO)
def sync_outcomes_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes in auto mode of batches with secrets in some contents and sources, and with tombstones, which are allowed."""
    b = t(spark, sf_dir, "memory_batch")
    k = F.col("row_id")
    b = b.withColumn("content", F.when(k % 7 == 0, F.concat("content", F.lit(" token: abcdefghij"))).otherwise(F.col("content"))).withColumn("source_ref", F.when(k % 11 == 0, "password=hunter2hunter2").otherwise(F.col("source_ref")))
    return sync.outcomes(b.withColumn("superseded_at", F.when(k % 3 == 0, F.col("arrived_ts"))), memory(spark, sf_dir), now(), True, "auto")


@query(SYNC_OUTCOMES.replace("SELECT row_id, CASE", ", o AS (SELECT CASE") + """) SELECT count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'tombstoned') AS tombstoned, count(*) FILTER (outcome = 'tombstone_refused') AS tombstones_refused, count(*) FILTER (outcome = 'capture_refused') AS capture_refused,
count(*) FILTER (outcome = 'deduped') AS deduped, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'malformed') AS malformed FROM o""")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.summary(sync.outcomes(t(spark, sf_dir, "memory_batch"), memory(spark, sf_dir), now()))


@query(Q.applied(SYNC_OUTCOMES))
def sync_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after all batches were taken in."""
    out = sync.applied(t(spark, sf_dir, "memory_batch"), memory(spark, sf_dir), now())
    return out.select("id", "namespace", F.round(records.usable(), 6).alias("confidence"), "signal", "tags", "retrieval_count")


# Log mining


@query("SELECT session_id, tool_name, epoch_us(completed_at) AS completed_at, exit_code FROM tool_usage WHERE coalesce(read_only, 0) = 0 AND (lower(status) = 'error' OR exit_code <> 0)")
def tool_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.tool_failures(t(spark, sf_dir, "tool_usage")).select("session_id", "tool_name", micros("completed_at").alias("completed_at"), "exit_code")


@query("SELECT tool_name, count(*) AS n FROM tool_usage WHERE coalesce(read_only, 0) = 0 AND (lower(status) = 'error' OR exit_code <> 0) GROUP BY tool_name")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.tool_failures(t(spark, sf_dir, "tool_usage")).groupBy("tool_name").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT * FROM tool_usage WHERE coalesce(read_only, 0) = 0 AND (lower(status) = 'error' OR exit_code <> 0) AND session_id IS NOT NULL),
r AS (SELECT session_id, tool_name, completed_at, row_number() OVER (PARTITION BY session_id ORDER BY completed_at DESC NULLS LAST, tool_name NULLS LAST, logged_at DESC NULLS LAST, error_message NULLS LAST) AS back, count(*) OVER (PARTITION BY session_id) AS n FROM f) SELECT session_id, tool_name, epoch_us(completed_at) AS completed_at, back, n AS of FROM r WHERE back <= 3""")
def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = mining.tool_failures(t(spark, sf_dir, "tool_usage")).filter("session_id is not null")
    order = [F.col("completed_at").desc_nulls_last(), F.col("tool_name").asc_nulls_last(), F.col("logged_at").desc_nulls_last(), F.col("error_message").asc_nulls_last()]
    return mining.latest_per_session(f, 3, "session_id", order).select("session_id", "tool_name", micros("completed_at").alias("completed_at"), "back", "of")


@query(Q.FAILURES + "SELECT session_id, tool_use_id, tool_name, seq, kind, reason, md5(text) AS text_md5 FROM f")
def transcript_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.failures(t(spark, sf_dir, "message")).select("session_id", "tool_use_id", "tool_name", "seq", "kind", "reason", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(Q.FAILURES + ", r AS (SELECT session_id, tool_use_id, reason, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC NULLS LAST, tool_use_id) AS back FROM f WHERE kind = 'rejection') SELECT session_id, tool_use_id, reason FROM r WHERE back <= 5")
def rejection_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = mining.failures(t(spark, sf_dir, "message")).filter("kind = 'rejection'")
    return mining.latest_per_session(f, 5, "session_id", [F.col("seq").desc_nulls_last(), F.col("tool_use_id")]).select("session_id", "tool_use_id", "reason")


@query(Q.USER_MESSAGES + "SELECT message_id, md5(text) AS text_md5 FROM u")
def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.user_messages(t(spark, sf_dir, "message")).select("message_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(Q.correction_classes())
def correction_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t(spark, sf_dir, "correction_item").withColumn("c", mining.classify_correction(F.col("message")))
    return m.select("item_id", F.col("c.kind").alias("kind"), F.col("c.patterns").alias("patterns"), F.col("c.confidence").alias("confidence"), F.col("c.sentiment").alias("sentiment"), F.col("c.decay_days").alias("decay_days"))


@query(f"""WITH k AS (SELECT item_id, namespace, captured_ts, {Q.collapse_key('message')} AS key FROM correction_item), r AS (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY captured_ts DESC NULLS LAST, item_id) AS nth, count(*) OVER (PARTITION BY namespace, key) AS occurrences FROM k)
SELECT namespace, item_id, occurrences FROM r WHERE nth = 1""")
def correction_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t(spark, sf_dir, "correction_item").withColumn("seq", F.conv(F.substring(F.col("item_id"), -8, 8), 10, 10).cast("long")).select("item_id", "namespace", "message", "captured_ts", "seq")
    return mining.collapse(items, "namespace", "message", "captured_ts", "seq").select("namespace", "item_id", "occurrences")


@query("""SELECT pattern, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(patterns, '\\s+')) AS pattern FROM correction_item) WHERE pattern <> '' GROUP BY pattern""")
def pattern_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.pattern_histogram(t(spark, sf_dir, "correction_item"))


@query(f"SELECT error_type, count(*) AS n FROM (SELECT {Q.error_type('error_message')} AS error_type FROM tool_usage) GROUP BY error_type")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "tool_usage").select(mining.error_type(F.col("error_message")).alias("error_type")).groupBy("error_type").agg(F.count("*").alias("n"))


@query(Q.FAILURES + f"SELECT {Q.error_type('text')} AS error_type, count(*) AS n FROM f WHERE kind = 'failure' GROUP BY 1")
def transcript_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = mining.failures(t(spark, sf_dir, "message")).filter("kind = 'failure'")
    return f.select(mining.error_type(F.col("text")).alias("error_type")).groupBy("error_type").agg(F.count("*").alias("n"))


@query(Q.FAILURES + f""", e AS (SELECT *, {Q.error_type('text')} AS error_type FROM f WHERE kind = 'failure'), r AS (SELECT *, row_number() OVER (PARTITION BY error_type, tool_name ORDER BY session_id, seq NULLS FIRST, tool_use_id) AS nth FROM e WHERE error_type IS NOT NULL)
SELECT error_type, tool_name, count(*) AS n, array_to_string(list(substr(text, 1, 200) ORDER BY nth) FILTER (nth <= 3), ' | ') AS samples, CASE WHEN count(*) >= 5 THEN 0.90 WHEN count(*) >= 3 THEN 0.85 ELSE 0.70 END::DOUBLE AS priority FROM r GROUP BY error_type, tool_name""")
def error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = mining.failures(t(spark, sf_dir, "message")).filter("kind = 'failure'")
    return mining.error_patterns(f, "tool_name", ["session_id", "seq", "tool_use_id"], min_count=1).select("error_type", "tool_name", "n", "samples", "priority")


@query(f"SELECT item_id, message FROM ({Q.correction_classes()}) JOIN correction_item USING (item_id) WHERE kind IS NULL ORDER BY item_id LIMIT 50")
def unmatched_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items whose message is no correction."""
    items = t(spark, sf_dir, "correction_item").withColumn("patterns", mining.classify_correction(F.col("message"))["kind"])
    return mining.unmatched_sample(items, 50)


@query(Q.USER_MESSAGES + f", k AS (SELECT *, {Q.collapse_key('text')} AS key FROM u) SELECT project_folder, key, count(*) AS occurrences FROM k GROUP BY project_folder, key")
def message_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mining.user_messages(t(spark, sf_dir, "message"))
    return mining.collapse(m, "project_folder", "text", "sent_ts", "message_id").select("project_folder", "key", "occurrences")


@query(Q.mined())
def mine_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections and error patterns of all transcripts as new queue items, those the queue has left out."""
    corrections, errors, _ = mining.mined(t(spark, sf_dir, "message"))
    queue = t(spark, sf_dir, "correction_item").select(F.sha2(F.concat_ws("|", F.lit("correction"), "namespace", mining.collapse_key(F.col("message"))), 256).alias("dedup_key"))
    return mining.queue_new(mining.queue_items(corrections, errors), queue)


@query("""WITH r AS (SELECT item_id, namespace, row_number() OVER (PARTITION BY namespace ORDER BY captured_ts DESC NULLS LAST, item_id) AS place FROM correction_item) SELECT item_id, namespace, place FROM r WHERE place <= 5""")
def queue_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.queue_capped(t(spark, sf_dir, "correction_item"), 5).select("item_id", "namespace", "place")


@query("""SELECT item_id, coalesce(decay_days >= 1 AND (1767225600000000 - epoch_us(captured_ts)) / 86400000000.0 > decay_days, false) AS stale FROM correction_item""")
def queue_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "correction_item").select("item_id", mining.is_stale(F.col("captured_ts"), F.col("decay_days"), now()).alias("stale"))


@query("""SELECT item_id FROM correction_item WHERE NOT (coalesce(decay_days >= 1 AND (1767225600000000 - epoch_us(captured_ts)) / 86400000000.0 > decay_days, false) AND coalesce(confidence < 0.6, false))""")
def queue_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.queue_clear(t(spark, sf_dir, "correction_item"), now()).select("item_id")


# Session state


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.coalesce((F.lower("status") == "error") | (F.col("exit_code") != 0), F.lit(False))
    u = t(spark, sf_dir, "tool_usage").filter("session_id is not null and completed_at is not null")
    return u.groupBy("session_id", "tool_name", "completed_at").agg(F.bool_or(failed).alias("failed")).select("session_id", "tool_name", "failed", (F.col("tool_name") == "Bash").alias("is_commit"), F.col("completed_at").alias("ts"))


@query("""WITH e AS (SELECT session_id, tool_name, completed_at AS ts, bool_or(coalesce(lower(status) = 'error' OR exit_code <> 0, false)) AS failed FROM tool_usage WHERE session_id IS NOT NULL AND completed_at IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, tool_name NULLS FIRST) AS at_call FROM e)
SELECT session_id, 'convention' AS nudge, min(at_call) AS at_call FROM n WHERE at_call >= 10 GROUP BY 1 UNION ALL SELECT session_id, 'commit', min(at_call) FROM n WHERE tool_name = 'Bash' GROUP BY 1 UNION ALL SELECT session_id, 'failure', min(at_call) FROM n WHERE failed GROUP BY 1""")
def session_nudges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.nudges_batch(_events(spark, sf_dir), [F.col("ts"), F.col("tool_name")])


@query("""WITH e AS (SELECT session_id, tool_name, completed_at AS ts FROM tool_usage WHERE session_id IS NOT NULL AND completed_at IS NOT NULL GROUP BY 1, 2, 3)
SELECT tool_name, epoch_us(ts) // 600000000 * 600000000 AS start, count(*) AS calls FROM e GROUP BY 1, 2""")
def windowed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.windowed_counts(_events(spark, sf_dir)).select("tool_name", F.unix_micros("window.start").alias("start"), "calls")


EVENTS_SQL = """WITH e AS (SELECT session_id, tool_name, completed_at AS ts, bool_or(coalesce(lower(status) = 'error' OR exit_code <> 0, false)) AS failed FROM tool_usage WHERE session_id IS NOT NULL AND completed_at IS NOT NULL GROUP BY 1, 2, 3)"""
LESSONS = "(SELECT regexp_extract(source_ref, '^session:(.+)$', 1) FROM memory WHERE superseded_at IS NULL AND source_ref LIKE 'session:%')"


@query(EVENTS_SQL + """, n AS (SELECT *, row_number() OVER w AS at_call, count(*) FILTER (NOT failed) OVER w AS good FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ts, tool_name NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT session_id, at_call FROM n WHERE NOT failed AND good % 3 = 0""")
def every_nth_nudges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.every_nth_batch(_events(spark, sf_dir), [F.col("ts"), F.col("tool_name")], 3)


@query(EVENTS_SQL + f" SELECT DISTINCT session_id FROM e WHERE failed AND session_id NOT IN {LESSONS}")
def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lessons = records.live(memory(spark, sf_dir)).select(F.regexp_extract("source_ref", "^session:(.+)$", 1).alias("session_id")).filter("session_id <> ''").distinct()
    return sessions.first_failures(_events(spark, sf_dir), lessons).select("session_id")


@query(EVENTS_SQL + " SELECT session_id, CASE WHEN bool_or(failed) THEN 'failure' WHEN count(*) >= 10 THEN 'convention' ELSE 'commit' END AS nudge FROM e GROUP BY session_id HAVING bool_or(failed) OR count(*) >= 10 OR bool_or(coalesce(tool_name = 'Bash', false))")
def nudge_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.delivery(sessions.nudges_batch(_events(spark, sf_dir), [F.col("ts"), F.col("tool_name")]))


@query("SELECT tool_name, count(*) AS n FROM tool_usage WHERE NOT coalesce(destructive = 1, false) GROUP BY tool_name")
def stop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without the flag; here destructive calls stand for stops that a hook caused."""
    return sessions.not_looping(t(spark, sf_dir, "tool_usage").withColumn("flag", F.col("destructive") == 1), "flag").groupBy("tool_name").agg(F.count("*").alias("n"))


@query("SELECT id, coalesce(date_diff('day', (last_retrieved AT TIME ZONE 'UTC')::DATE, DATE '2026-01-01') >= 1, true) AS due FROM memory")
def backup_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).select("id", Store.backup_due(F.col("last_retrieved"), now()).alias("due"))


# Diagnostics


@query("""WITH d AS (SELECT round((1767225600000000 - epoch_us(date_trunc('second', max(ingestion_ts) FILTER (epoch_us(ingestion_ts) < 1767225600000000)))) / 86400000000.0, 1) AS b FROM memory)
SELECT 'operational-health-backup' AS "check", CASE WHEN b IS NULL OR b > 2 THEN 'warn' ELSE 'pass' END AS status, b AS days_ago FROM d UNION ALL SELECT 'operational-health-consolidation', 'warn', NULL""")
def operational_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record's time stands for the last backup; consolidation never ran."""
    last = memory(spark, sf_dir).filter(F.unix_micros("ingestion_ts") < Q.NOW_US).agg(F.max("ingestion_ts").alias("ts"))
    return diagnostics.operational_health(last.select(F.lit("last_backup").alias("key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value")), now())


@query("""SELECT 'ns-migration' AS "check", CASE WHEN count(DISTINCT namespace) > 0 THEN 'warn' ELSE 'pass' END AS status, count(DISTINCT namespace) AS stranded FROM memory WHERE namespace IN ('USER:GLOBAL', 'user_global', 'global', 'absent')""")
def pending_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.pending_migration(memory(spark, sf_dir), ["USER:GLOBAL", "user_global", "global", "absent"])


TEXT_SIZES = """SELECT doc_id::VARCHAR AS name, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + CASE WHEN coalesce(text, '') <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n_lines, strlen(coalesce(text, '')) AS n_bytes FROM documents"""
SIZED = f"SELECT *, CASE WHEN n_lines > 200 OR n_bytes > 16384 THEN 'warn' ELSE 'pass' END AS status FROM ({TEXT_SIZES})"


@query(SIZED)
def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.text_sizes(t(spark, sf_dir, "documents").withColumn("name", F.col("doc_id").cast("string")), "name", "text")


@query(f"SELECT count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warn') AS warn, 0::BIGINT AS fail, 0::BIGINT AS skip FROM ({SIZED})")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.status_counts(text_sizes(spark, sf_dir))


@query("""SELECT 'session-retention' AS "check", 'pass' AS status, coalesce(arg_max(max_repeats, source) FILTER (max_repeats % 2 = 0 AND max_repeats > 0), 30)::INTEGER AS days, count(*) FILTER (max_repeats % 2 = 0 AND max_repeats > 0) > 0 AS configured FROM mix_target""")
def retention_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings made of the small table: even numbers are written as numbers, odd ones as text, which counts as unset."""
    n = F.col("max_repeats").cast("string")
    value = F.concat(F.lit('{"cleanupPeriodDays": '), F.when(F.col("max_repeats") % 2 == 0, n).otherwise(F.concat(F.lit('"'), n, F.lit('"'))), F.lit("}"))
    return diagnostics.retention_setting(t(spark, sf_dir, "mix_target").select(F.col("source").alias("place"), value.alias("value")))


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
