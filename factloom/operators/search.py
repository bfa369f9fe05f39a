"""Ranked retrieval: postings, BM25, nearest vectors, rank fusion, the composite score and tiers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.operators import index
from factloom.operators.records import expanded, live, usable, uses, with_staleness

INDEXED = ("content", "tags", "namespace")


def terms_of(query: str) -> list[str]:
    """The query's terms: runs of a-z0-9 of each blank-separated word, lower-cased, in order, once each."""
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))


def tokens(columns: tuple[str, ...] = INDEXED) -> Column:
    """All indexed text of a row as one array of tokens, repeats kept."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(r"([a-z0-9]+)"), F.lit(1))


def bm25(rows: DataFrame, query: str, columns: tuple[str, ...] = INDEXED, id_col: str = "id", index_path: str | None = None) -> DataFrame:
    """id and bm25 of the rows that hold a token with one of the terms as prefix; higher is better.

    Number of rows, mean length and document frequencies are those of all rows, tombstones and other namespaces included. With
    index_path, the folder of a stored index of these rows, only the postings of the terms are read. Without one the texts are
    scanned: one pass for the frequencies, which come to the driver as one row, and one that scores the matching rows.
    """
    terms = terms_of(query)
    if not terms:
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("bm25")).limit(0)
    dfs = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    if index_path is not None:
        counted, (n, mean) = index.lookup(rows.sparkSession, index_path, terms)
        counted = counted.persist()
        sums = counted.agg(*dfs).first()
    else:
        # A token with a term as prefix is a place where the term stands without a token character before it.
        low = F.lower(F.concat_ws(" ", *columns))
        tf = [F.when(F.col("low").contains(t), F.regexp_count("low", F.lit(f"(?<![a-z0-9]){t}"))).otherwise(0).alias(f"tf{i}") for i, t in enumerate(terms)]
        counted = rows.select(F.col(id_col).alias("id"), low.alias("low")).select("id", F.regexp_count("low", F.lit("[a-z0-9]+")).alias("dl"), *tf)
        # One row of sums, as an aggregate that is combined map-side.
        sums = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("dl"), *dfs).first()
        n, mean = sums["n"], float(sums["dl"] or 1.0)
    hit, score = F.lit(False), F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}").cast("double"), sums[f"df{i}"]
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), fixed.BM25_LEAST_IDF)
        hit = hit | (f > 0)
        score = score + idf * f * (fixed.BM25_K1 + 1) / (f + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("dl") / F.lit(mean)))
    return counted.filter(hit).select("id", score.alias("bm25"))


def write_index(rows: DataFrame, path: str, columns: tuple[str, ...] = INDEXED, append: bool = False) -> None:
    """Stores the inverted index of some rows in a folder, for bm25 and all that ranks by it."""
    index.write(rows, tokens(columns), path, append=append)


def postings(rows: DataFrame, columns: tuple[str, ...] = INDEXED, id_col: str = "id") -> DataFrame:
    """The inverted index (term, id, tf)."""
    return index.postings(rows, tokens(columns), id_col).drop("dl")


def checked(*limits: int) -> None:
    """Negative limits are refused."""
    if any(n < 0 for n in limits):
        raise ValueError("a limit must not be negative")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors as double; 0 when their lengths differ or one is null."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k unit vectors with the largest cosine to the query, ties by id: a scan and a top-k, no shuffle of vectors."""
    checked(k)
    q = F.array(*(F.lit(float(x)) for x in query))
    sims = vectors.select(F.col(id_col), dot(F.col(vector_col), q).alias("sim"))
    return sims.orderBy(F.col("sim").desc(), F.col(id_col)).limit(k)


#: Query vectors that one scan answers.
QUERY_BLOCK = 4096


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", within: str | None = None) -> DataFrame:
    """query_id, id, sim: for each query vector the k others with the largest dot product, exactly; ties by id.

    within: a column of both; only vectors with the query's value are ranked at all. A null value is equal to none.

    Queries are taken in blocks of a fixed size, each answered by one scan: every batch of vectors gives its own k best for each
    query, and the survivors are ranked by query. No vector is shuffled. Null vectors and those of another length are left out.
    """
    import numpy as np
    import pandas as pd

    checked(k)
    if within is not None:
        vectors, queries = (x.filter(F.col(within).isNotNull()) for x in (vectors, queries))
    names = queries.select(id_col).filter(F.col(vector_col).isNotNull()) if vector_col in queries.columns else queries.select(id_col)
    blocks = max(1, -(-names.count() // QUERY_BLOCK))
    kind = vectors.schema[id_col].dataType.simpleString()
    group = F.lit(0) if within is None else F.col(within)
    out = None
    for b in range(blocks):
        part = queries.filter(F.col(vector_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b)).select(id_col, vector_col, group.alias("g")).collect()
        if not part:
            continue
        ids, size = [r[0] for r in part], len(part[0][1])
        rows = [i for i, r in enumerate(part) if len(r[1]) == size]
        matrix = np.array([part[i][1] for i in rows], dtype=np.float64)

        def scan(batches, ids=[ids[i] for i in rows], groups=[part[i]["g"] for i in rows], matrix=matrix, size=size):  # noqa: ANN001, ANN202
            for pdf in batches:
                pdf = pdf[[v is not None and len(v) == size for v in pdf["v"]]]
                if not len(pdf):
                    continue
                other, of = pdf["i"].to_numpy(), pdf["g"].to_numpy()
                sims = matrix @ np.stack(pdf["v"].to_numpy()).astype(np.float64).T
                for q, g, row in zip(ids, groups, sims):
                    row = np.where((other == q) | (of != g), -np.inf, row)
                    top = np.flatnonzero(row >= np.partition(row, -k)[-k]) if 0 < k < len(row) else np.arange(len(row))
                    best = top[np.lexsort((other[top], -row[top]))[:k]]
                    best = best[row[best] > -np.inf]
                    if len(best):
                        yield pd.DataFrame({"query_id": q, "id": other[best], "sim": row[best]})

        found = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"), group.alias("g")).mapInPandas(scan, f"query_id {kind}, id {kind}, sim double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, sim double")
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("id"))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sure(floor: float) -> Column:
    """A confidence at or above the floor; a missing one is below any."""
    return usable() >= floor


def fuse(*ranked: DataFrame, id_col: str = "id", k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lists of (id, rank): the sum of 1 / (k + rank)."""
    both = ranked[0].select(id_col, "rank")
    for r in ranked[1:]:
        both = both.unionAll(r.select(id_col, "rank"))
    return both.groupBy(id_col).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))


def recency(ts: Column, now: Column) -> Column:
    days = F.greatest((F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000.0, F.lit(0.0))
    return F.when(ts.isNull(), fixed.UNKNOWN_RECENCY).otherwise(F.pow(F.lit(0.5), days / fixed.HALF_LIFE_DAYS))


def popularity(n: Column) -> Column:
    return F.least(F.lit(1.0), fixed.POPULARITY_STEP * F.sqrt(F.greatest(n, F.lit(0)).cast("double")))


def relevance(bm25_: Column, cosine: Column | None = None) -> Column:
    by_text = F.abs(bm25_) / (1 + F.abs(bm25_))
    if cosine is None:
        return F.coalesce(by_text, F.lit(0.0))
    return F.coalesce(by_text, F.greatest(cosine, F.lit(0.0)), F.lit(0.0))


def score(rel: Column, confidence: Column, ts: Column, n: Column, now: Column) -> Column:
    sure = F.when(confidence.isNull() | F.isnan(confidence), fixed.UNKNOWN_CONFIDENCE).otherwise(confidence)
    return fixed.W_RELEVANCE * rel + fixed.W_CONFIDENCE * sure + fixed.W_RECENCY * recency(ts, now) + fixed.W_POPULARITY * popularity(n)


def recall_all(
    memory: DataFrame, query: str, now: Column, namespace: str | None = None, limit: int = 5, floor: float = fixed.RECALL_FLOOR, current: DataFrame | None = None, include_global: bool = False, global_limit: int = 3,
    aliases: dict[str, str] | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, index_path: str | None = None,
) -> DataFrame:
    """id, namespace, tier, score, confidence, stale and rrf of the rows recalled, in both tiers from one match.

    The first tier is the namespace with its aliases, in either direction (all rows without a namespace); with include_global the
    second is the global one, whose rows never displace those of the first. A tier takes the best max(3 * limit, limit + 5) rows
    by BM25 among its live rows at or above the floor, with vectors (id, embedding) and a query vector also its max(5 * limit,
    limit + 10) nearest ones, and keeps the best by composite score; the fused rank, then the id, breaks ties. A row found by text
    keeps its text relevance. The floor is tested before stale rows lose confidence; current, if given, has the hashes of the
    sources now. Null namespaces belong to no tier but that of no namespace.
    """
    checked(limit, global_limit)
    wanted = None if namespace is None else expanded([namespace], aliases)
    tier = F.lit(1) if wanted is None else F.when(F.col("namespace").isin(wanted), 1)
    sizes = {1: limit}
    if include_global and wanted is not None and fixed.GLOBAL_NAMESPACE not in wanted:
        tier, sizes[2] = tier.when(F.col("namespace") == fixed.GLOBAL_NAMESPACE, 2), global_limit
    of = lambda fn: F.element_at(F.create_map(*(F.lit(x) for t, n in sizes.items() for x in (t, fn(n)))), F.col("tier"))
    rows = live(memory).filter(sure(floor)).withColumn("tier", tier).filter("tier is not null")
    rows = rows.select("id", "namespace", "tier", usable().alias("confidence"), "ingestion_ts", "source_ref", "source_hash", uses().alias("n_uses"))
    by = lambda *order: Window.partitionBy("tier").orderBy(*order)
    most = lambda fn: max(fn(n) for n in sizes.values())

    def best(found: DataFrame, col: str, fn) -> DataFrame:  # noqa: ANN001
        ranked = found.withColumn("rank", F.row_number().over(by(F.col(col).desc(), F.col("id")))).filter(F.col("rank") <= most(fn))
        return ranked.filter(F.col("rank") <= of(fn))

    found = best(bm25(memory, query, index_path=index_path).join(rows, "id"), "bm25", lambda n: max(3 * n, n + 5)).withColumn("sim", F.lit(None).cast("double"))
    if vectors is not None and query_vector is not None and terms_of(query):
        q = F.array(*(F.lit(float(x)) for x in query_vector))
        near = best(vectors.select("id", dot(F.col("embedding"), q).alias("sim")).join(rows, "id"), "sim", lambda n: max(5 * n, n + 10)).withColumn("bm25", F.lit(None).cast("double"))
        cols = ["namespace", "tier", "confidence", "ingestion_ts", "source_ref", "source_hash", "n_uses"]
        found = found.unionByName(near).groupBy("id", *cols).agg(F.max("bm25").alias("bm25"), F.max("sim").alias("sim"), F.sum(1.0 / (fixed.RRF_K + F.col("rank"))).alias("rrf"))
    else:
        found = found.withColumn("rrf", 1.0 / (fixed.RRF_K + F.col("rank")))
    found = with_staleness(found, current) if current is not None else found.withColumn("stale", F.lit(False))
    rel = relevance(F.col("bm25"), F.col("sim"))
    scored = found.withColumn("score", score(rel, F.col("confidence"), F.col("ingestion_ts"), F.col("n_uses"), now))
    kept = scored.withColumn("place", F.row_number().over(by(F.col("score").desc(), F.col("rrf").desc(), F.col("id")))).filter(F.col("place") <= of(int))
    return kept.orderBy("tier", "place").select("id", "namespace", "tier", F.round("score", 4).alias("score"), F.round("confidence", 3).alias("confidence"), "stale", F.round("rrf", 6).alias("rrf"))


def recall(memory: DataFrame, query: str, now: Column, namespace: str | None = None, limit: int = 5, floor: float = fixed.RECALL_FLOOR, current: DataFrame | None = None, index_path: str | None = None) -> DataFrame:
    """One tier of recall_all by text alone."""
    return recall_all(memory, query, now, namespace, limit, floor, current, index_path=index_path).select("id", "namespace", "score", "confidence")


def recall_tiers(memory: DataFrame, query: str, now: Column, namespace: str, limit: int = 5, general_limit: int = 3, floor: float = fixed.RECALL_FLOOR, index_path: str | None = None) -> DataFrame:
    """The namespace's tier and the global one by text alone."""
    return recall_all(memory, query, now, namespace, limit, floor, include_global=True, global_limit=general_limit, index_path=index_path).select("id", "namespace", "score", "confidence", "tier")


def telemetry(found: DataFrame, now: Column, explicit: bool = True) -> DataFrame:
    """The events (id, kind, ts) by which rows that were shown are counted: explicit or passive, never both."""
    return found.select("id", F.lit("explicit" if explicit else "passive").alias("kind"), now.alias("ts"))


def tiers(project: DataFrame, general: DataFrame, project_limit: int, general_limit: int) -> DataFrame:
    """The project's rows come first and are never displaced; then the general ones that aren't among them."""
    first = project.limit(project_limit).withColumn("tier", F.lit(1))
    rest = general.join(first.select("id"), "id", "left_anti").limit(general_limit).withColumn("tier", F.lit(2))
    return first.unionByName(rest)


def recent(memory: DataFrame, namespace: str, limit: int = 5, floor: float = fixed.RECENT_FLOOR, aliases: dict[str, str] | None = None) -> DataFrame:
    """The newest live rows of a namespace and its aliases at or above the floor; ties by id."""
    checked(limit)
    rows = live(memory).filter(F.col("namespace").isin(expanded([namespace], aliases)) & sure(floor))
    return rows.orderBy(F.col("ingestion_ts").desc_nulls_last(), F.col("id")).limit(limit).select("id", "namespace", "type", F.round("confidence", 3).alias("confidence"))


def recent_tiers(memory: DataFrame, namespace: str, limit: int = 5, general_limit: int = 3, floor: float = fixed.RECENT_FLOOR, aliases: dict[str, str] | None = None) -> DataFrame:
    checked(limit, general_limit)
    return tiers(recent(memory, namespace, limit, floor, aliases), recent(memory, fixed.GLOBAL_NAMESPACE, general_limit, floor), limit, general_limit)


def hybrid(memory: DataFrame, query: str, vectors: DataFrame, query_vector: list[float], now: Column, limit: int = 5, floor: float = fixed.RECALL_FLOOR, index_path: str | None = None) -> DataFrame:
    """Text and vector search fused over all namespaces: id, score, rrf. See recall_all."""
    return recall_all(memory, query, now, None, limit, floor, vectors=vectors, query_vector=query_vector, index_path=index_path).select("id", "score", "rrf")
