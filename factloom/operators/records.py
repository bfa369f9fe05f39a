"""Filters, point access, statistics and maintenance over the record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions import text as T


def live(memory: DataFrame) -> DataFrame:
    return memory.filter(F.col("superseded_at").isNull())


def uses() -> Column:
    return F.coalesce("retrieval_count", F.lit(0)) + F.coalesce("surfaced_count", F.lit(0))


def usable(confidence: str = "confidence") -> Column:
    """A confidence in 0..1; one that is null, NaN or outside counts as missing, everywhere."""
    c = F.col(confidence)
    return F.when(~F.isnan(c) & c.between(0.0, 1.0), c)


def expanded(namespaces: list[str], aliases: dict[str, str] | None = None) -> list[str]:
    """The namespaces with those that an alias maps to or from them."""
    wanted = set(namespaces)
    for old, new in (aliases or {}).items():
        if old in namespaces or new in namespaces:
            wanted |= {old, new}
    return sorted(wanted)


def in_namespaces(memory: DataFrame, namespaces: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows of the requested namespaces and of their aliases."""
    return memory.filter(F.col("namespace").isin(expanded(namespaces, aliases)))


def get(memory: DataFrame, id_: str) -> DataFrame:
    return memory.filter(F.col("id") == id_)


def listing(memory: DataFrame, namespace: str | None = None, limit: int = 50, include_superseded: bool = False) -> DataFrame:
    """The newest rows with an 80-character preview and their status. Ties go by id."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    rows = memory if include_superseded else live(memory)
    if namespace is not None:
        rows = rows.filter(F.col("namespace") == namespace)
    status = F.when(F.col("superseded_at").isNull(), "live").otherwise(F.concat_ws(": ", F.lit("superseded"), "supersede_reason"))
    top = rows.orderBy(F.col("ingestion_ts").desc_nulls_last(), F.col("id")).limit(limit)
    return top.select("id", "namespace", "type", F.substring("content", 1, 80).alias("preview"), status.alias("status"))


def with_staleness(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Halves the confidence of rows whose source has another hash now; an unusable one comes out null.

    current: source_ref, current_hash, one row a source."""
    stale = F.col("source_hash").isNotNull() & F.col("current_hash").isNotNull() & (F.col("source_hash") != F.col("current_hash"))
    return rows.join(current, "source_ref", "left").withColumn("stale", stale).withColumn("confidence", usable() * F.when(F.col("stale"), fixed.STALE_FACTOR).otherwise(1.0))


def lessons_missing(sessions: DataFrame, memory: DataFrame) -> DataFrame:
    """Sessions that no live record names as its source."""
    have = live(memory).select(F.regexp_extract("source_ref", r"^session:(.+)$", 1).alias("session_id")).filter("session_id <> ''").distinct()
    return sessions.select("session_id").distinct().join(have, "session_id", "left_anti")


def prune_candidates(memory: DataFrame, now: Column) -> DataFrame:
    """Live rows that nobody used, without signal and of little confidence, more than 30 days old by date."""
    unused = (F.coalesce("retrieval_count", F.lit(0)) == 0) & (F.coalesce("surfaced_count", F.lit(0)) == 0)
    return live(memory).filter(unused & (F.col("signal") == "none") & (usable() < fixed.PRUNE_CONFIDENCE) & (F.to_date("ingestion_ts") < F.date_sub(F.to_date(now), fixed.PRUNE_DAYS)))


def promote_candidates(memory: DataFrame) -> DataFrame:
    """Live lessons proven by a tool and used often enough, the most used first, with a slug and a trigger line."""
    bar = (F.col("type") == "lesson") & F.col("signal").isin(*fixed.PROMOTE_SIGNALS) & (usable() >= fixed.PROMOTE_CONFIDENCE) & (uses() > fixed.PROMOTE_USES)
    rows = live(memory).filter(bar).select("id", "namespace", uses().alias("uses"), "confidence", T.slug(F.col("tags"), F.col("id")).alias("slug"), T.first_sentence(F.col("content")).alias("trigger_line"))
    return rows.orderBy(F.col("uses").desc(), F.col("confidence").desc(), F.col("id"))


def rekey(memory: DataFrame, target: str = fixed.GLOBAL_NAMESPACE, source: str | None = None) -> DataFrame:
    """Live rows that would move to the target namespace: those of one namespace, or all misspellings of the global one."""
    if not target.strip() or T_is_near_miss(target):
        raise ValueError("the target namespace is empty or a misspelling")
    moves = T.near_miss(F.col("namespace")) if source is None else F.col("namespace") == source
    return live(memory).filter(moves).withColumn("new_namespace", F.lit(target))


def rekey_all(memory: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The table with old namespace keys replaced, tombstones included; keys that the mapping lacks stay as they are."""
    if not keys:
        return memory
    new = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(keys.items()) for x in kv)), F.col("namespace"))
    return memory.withColumn("namespace", F.coalesce(new, "namespace"))


def T_is_near_miss(namespace: str) -> bool:
    import re

    return namespace != fixed.GLOBAL_NAMESPACE and re.sub(r"[\s:_\-.]+", "", namespace.lower()) in fixed.NEAR_MISS_STEMS


def supersede(memory: DataFrame, tombstones: DataFrame, now: Column) -> DataFrame:
    """The table with live rows named in tombstones (id, reason, optional superseded_at) made dead; rows dead already keep their time."""
    at = F.coalesce("t_at", now) if "superseded_at" in tombstones.columns else now
    marks = tombstones.select("id", F.col("reason").alias("t_reason"), *([F.col("superseded_at").alias("t_at")] if "superseded_at" in tombstones.columns else []), F.lit(True).alias("t_hit"))
    hit = F.col("t_hit") & F.col("superseded_at").isNull()
    out = memory.join(marks, "id", "left").withColumn("t_new", F.coalesce(hit, F.lit(False)))
    out = out.withColumn("supersede_reason", F.when(F.col("t_new"), F.col("t_reason")).otherwise(F.col("supersede_reason"))).withColumn("superseded_at", F.when(F.col("t_new"), at).otherwise(F.col("superseded_at")))
    return out.select(*memory.columns)


def stats(memory: DataFrame) -> DataFrame:
    dead = F.col("superseded_at").isNotNull()
    return memory.agg(F.count("*").alias("total"), F.count_if(~dead).alias("live"), F.count_if(dead).alias("superseded"))


def live_counts(memory: DataFrame, by: str) -> DataFrame:
    return live(memory).groupBy(by).agg(F.count("*").alias("n"))


def growth(live_rows: Column, last: Column) -> Column:
    return (live_rows - last) / F.greatest(last, F.lit(1))


def cadence(memory: DataFrame, last_run: Column, now: Column, last_live: Column) -> DataFrame:
    """Whether consolidation is due: a week has passed, or the live rows grew by a fifth."""
    days = F.date_diff(F.to_date(now), F.to_date(last_run))
    rows = live(memory).agg(F.count("*").alias("live"))
    return rows.select("live", F.round(growth(F.col("live"), last_live), 6).alias("growth"), (~((days < fixed.CADENCE_DAYS) & (growth(F.col("live"), last_live) < fixed.CADENCE_GROWTH))).alias("due"))


def candidate_window(memory: DataFrame, per_namespace: int = fixed.CLUSTER_ROWS) -> DataFrame:
    """The best live rows of each namespace by the reference's order of consolidation, with their place. A cap, for callers that ask for one."""
    ranked = live(memory).withColumn("place", F.row_number().over(Window.partitionBy("namespace").orderBy(best_first())))
    return ranked.filter(F.col("place") <= per_namespace)


def best_first() -> Column:
    """The order in which consolidation takes rows, smallest first: much used and sure, then sure, then old, then by id. A missing
    confidence weighs nothing and comes after all others."""
    weight = F.coalesce(usable(), F.lit(0.0)) * uses()
    return F.struct((-weight).alias("w"), usable().isNull().alias("c0"), (-usable()).alias("c"), "ingestion_ts", "id")


def bump(memory: DataFrame, events: DataFrame) -> DataFrame:
    """The table with usage counted in: events are (id, kind, ts), kind explicit or passive, aggregated by id first."""
    explicit, passive = F.col("kind") == "explicit", F.col("kind") == "passive"
    added = events.groupBy("id").agg(F.count_if(explicit).alias("r"), F.max(F.when(explicit, F.col("ts"))).alias("r_ts"), F.count_if(passive).alias("s"), F.max(F.when(passive, F.col("ts"))).alias("s_ts"))
    out = memory.join(added, "id", "left")
    for count, last, n, ts in (("retrieval_count", "last_retrieved", "r", "r_ts"), ("surfaced_count", "last_surfaced", "s", "s_ts")):
        out = out.withColumn(count, F.coalesce(count, F.lit(0)) + F.coalesce(n, F.lit(0))).withColumn(last, F.greatest(last, ts))
    return out.select(*memory.columns)


def retention(snapshots: DataFrame, keep: int, name: str = "name", mtime: str = "mtime") -> DataFrame:
    """Snapshots beyond the newest `keep`; those made before a restore are never among them, and keep <= 0 keeps all."""
    rows = snapshots.filter(~F.col(name).startswith("prerestore-"))
    if keep <= 0:
        return rows.limit(0)
    return rows.withColumn("nth", F.row_number().over(Window.orderBy(F.col(mtime).desc_nulls_last(), F.col(name)))).filter(F.col("nth") > keep).drop("nth")
