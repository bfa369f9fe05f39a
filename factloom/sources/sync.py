"""Records as JSON lines: export, validated ingest, harvests and transcripts, and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from factloom.functions import fixed, policy
from factloom.functions import text as T
from factloom.operators.consolidate import default_confidence, signal_rank
from factloom.operators.records import live, rekey_all, usable

EXPORTED = ("id", "namespace", "type", "content", "tags", "source_ref", "confidence", "signal", "valid_from", "ingestion_ts", "superseded_at", "supersede_reason", "merged_from")
ID_SHAPE = r"^[0-9a-fA-F-]{36}$"

MEMORY = S.StructType([
    S.StructField("id", S.StringType()), S.StructField("namespace", S.StringType()), S.StructField("type", S.StringType()), S.StructField("content", S.StringType()),
    S.StructField("tags", S.StringType()), S.StructField("source_ref", S.StringType()), S.StructField("source_hash", S.StringType()), S.StructField("confidence", S.DoubleType()),
    S.StructField("signal", S.StringType()), S.StructField("valid_from", S.TimestampType()), S.StructField("ingestion_ts", S.TimestampType()), S.StructField("superseded_at", S.TimestampType()),
    S.StructField("supersede_reason", S.StringType()), S.StructField("retrieval_count", S.LongType()), S.StructField("last_retrieved", S.TimestampType()), S.StructField("surfaced_count", S.LongType()),
    S.StructField("last_surfaced", S.TimestampType()), S.StructField("merged_from", S.StringType()),
])
VERSION = 8


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMORY).parquet(path)


def migrated(df: DataFrame, version: int, keys: dict[str, str] | None = None) -> DataFrame:
    """A table of an older version with the columns it lacks, typed and null; one of a newer version is refused.

    Before version 5 namespaces have old keys: those in `keys` are replaced in all rows, tombstones included; the others stay, to
    be replaced when their new key is known. The normalized content is computed where it is needed and not stored.
    """
    if version > VERSION:
        raise ValueError(f"version {version} is newer than {VERSION}")
    for f in MEMORY.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(0 if f.name.endswith("_count") else None).cast(f.dataType))
    if version < 5:
        df = rekey_all(df, keys or {})
    return df.select(*(F.col(f.name).cast(f.dataType) for f in MEMORY.fields))


def with_norm(memory: DataFrame) -> DataFrame:
    return memory.withColumn("content_norm", T.normalized(F.col("content")))


def export_lines(memory: DataFrame, namespace: str | None = None, include_superseded: bool = False) -> DataFrame:
    """One JSON object a row in order of ingestion_ts and id; line separators inside are escaped."""
    rows = memory if include_superseded else live(memory)
    if namespace is not None:
        rows = rows.filter(F.col("namespace") == namespace)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    cols = [stamp(c) if c in ("valid_from", "ingestion_ts", "superseded_at") else F.col(c) for c in EXPORTED]
    line = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    for ch, esc in (("\u2028", "\\u2028"), ("\u2029", "\\u2029"), ("\u0085", "\\u0085")):
        line = F.replace(line, F.lit(ch), F.lit(esc))
    return rows.orderBy(F.col("ingestion_ts").asc_nulls_first(), "id").select(line.alias("value"))


def write_export(memory: DataFrame, path: str, **options: object) -> None:
    """Writes the lines as text in their order: range-partitioned files whose names sort as their rows do."""
    export_lines(memory, **options).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no of a text file: lines are numbered from their order in the file, across its splits.

    Each split counts its lines once; the numbers are then the sums before, plus the place in the split.
    """
    raw = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("m"))
    placed = raw.withColumn("nth", F.row_number().over(Window.partitionBy("file", "at").orderBy("m")))
    counts = placed.groupBy("file", "at").agg(F.max("nth").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("file", "at")) - F.col("n")).drop("n")
    return placed.join(before, ["file", "at"]).select("value", (F.col("nth") + F.col("before")).alias("line_no"))


LINE = "id string, namespace string, type string, content string, tags string, source_ref string, confidence string, signal string, valid_from string, ingestion_ts string, superseded_at string, supersede_reason string, merged_from string"


def parse_lines(lines: DataFrame) -> DataFrame:
    """The fields of each line as strings; a line that is no JSON object, or is too long, has parsed = false."""
    ok = F.length("value") <= fixed.LINE_CHARS
    row = F.from_json(F.when(ok, F.col("value")), LINE)
    return lines.select("line_no", row.isNotNull().alias("parsed"), row.alias("r")).select("line_no", "parsed", "r.*")


def reject_reason(namespace: Column, type_: Column, content: Column, id_: Column) -> Column:
    """Why a row is malformed; null when it isn't."""
    return (
        F.when(id_.isNull() | ~id_.rlike(ID_SHAPE), "id").when(namespace.isNull() | (F.trim(namespace) == ""), "namespace").when(T.near_miss(namespace), "near-miss")
        .when(content.isNull() | (F.trim(content) == ""), "content").when(F.length(content) > fixed.CONTENT_CHARS, "size").when(type_.isNull() | ~type_.isin(*fixed.TYPES), "type")
    )


def validated(rows: DataFrame, now: Column) -> DataFrame:
    """Adds reject, and repairs what can be: unknown signals, confidences (default of the signal, then 0..1), times ahead."""
    signal = F.when(F.col("signal").isin(*fixed.SIGNAL_RANK), F.col("signal")).otherwise("none")
    c = F.col("confidence").try_cast("double") if dict(rows.dtypes)["confidence"] == "string" else F.col("confidence")
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = rows.withColumn("reject", reject_reason(F.col("namespace"), F.col("type"), F.col("content"), F.col("id"))).withColumn("signal", signal)
    out = out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(finite, c).otherwise(default_confidence(F.col("signal"))))))
    ts = F.col("ingestion_ts") if dict(rows.dtypes)["ingestion_ts"].startswith("timestamp") else F.try_to_timestamp("ingestion_ts")
    ahead = F.unix_micros(ts) > F.unix_micros(now) + fixed.FUTURE_SECONDS * 1_000_000
    return out.withColumn("ingestion_ts", F.when(ts.isNull() | ahead, now).otherwise(ts))


def outcomes(batch: DataFrame, memory: DataFrame, now: Column, allow_tombstones: bool = False, mode: str = "manual") -> DataFrame:
    """row_id and outcome of each row, in order of batch_no and line_no: what a row finds depends on the rows before it.

    malformed; skipped, tombstoned or tombstone_refused for a known id; capture_refused; deduped for a content that the namespace
    has, in the table or from an earlier added row; else added. A repeated id is known from its first added row on. The first
    usable row of an id and of a (namespace, content) decides for the later ones, so two aggregates replace the sequence.
    """
    has_tomb = "superseded_at" in batch.columns
    dead = F.col("superseded_at").isNotNull() if has_tomb else F.lit(False)
    rows = validated(batch, now).withColumn("dead", dead)
    if mode == "auto":  # what is stored, and so compared, is the redacted text
        rows = policy.capture(rows, mode).withColumn("content", F.col("new_content")).drop("new_content", "new_tags", "outcome")
    rows = rows.withColumn("norm", F.sha2(F.concat_ws("\u0001", "namespace", T.normalized(F.col("content"))), 256))
    known = memory.select("id", F.col("superseded_at").isNull().alias("known_live"))
    have = live(memory).select(F.sha2(F.concat_ws("\u0001", "namespace", T.normalized(F.col("content"))), 256).alias("norm")).distinct().withColumn("have", F.lit(True))
    rows = rows.join(known, "id", "left").join(have, "norm", "left")
    refused = F.lit(mode == "auto") & policy.has_secret(F.col("source_ref"))
    usable = F.col("reject").isNull() & F.col("known_live").isNull() & ~refused
    order = F.struct("batch_no", "line_no")
    # A row can be added only if no earlier usable row has its id; of those, only the first of a content is, unless it is there.
    # The minima are combined map-side, so that an id or a content of a third of all rows is gathered nowhere.
    rows = rows.withColumn("usable", usable).withColumn("ord", order)
    firsts = rows.filter("usable").groupBy("id").agg(F.min("ord").alias("first_of_id"))
    rows = rows.join(firsts, "id", "left").withColumn("entering", F.coalesce(F.col("usable") & (F.col("ord") == F.col("first_of_id")), F.lit(False)))
    norms = rows.filter(F.col("entering") & ~F.col("dead")).groupBy("norm").agg(F.min("ord").alias("first_of_norm"))
    rows = rows.join(norms, "norm", "left")
    # An id whose first row was deduped isn't in the table, so its later rows meet the same content rules as any new row.
    tomb = F.when(F.col("known_live") & F.lit(allow_tombstones), "tombstoned").when(F.col("known_live"), "tombstone_refused").otherwise("skipped")
    outcome = (
        F.when(F.col("reject").isNotNull(), "malformed").when(F.col("known_live").isNotNull(), F.when(F.col("dead"), tomb).otherwise("skipped")).when(refused, "capture_refused")
        .when(F.col("dead") & F.col("entering"), "added").when(F.coalesce("have", F.lit(False)), "deduped").when(F.col("entering") & (F.col("ord") == F.col("first_of_norm")), "added")
        .when(F.col("first_of_norm") < F.col("ord"), F.when(F.col("entering"), "deduped").otherwise("skipped")).otherwise("skipped")
    )
    return rows.select("row_id", outcome.alias("outcome"))


def harvest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files that hold one JSON array each; a missing source becomes session:harvest-<file>. Bad rows keep their reason."""
    row = "array<struct<namespace:string,type:string,content:string,tags:string,signal:string,why:string,source_ref:string>>"
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("stem"))
    rows = files.select("stem", F.inline(F.from_json("value", row)))
    lacking = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("namespace", "type", "content", "tags", "signal", "why"))), lambda x: x.isNotNull())
    reason = F.when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ","))).when(~F.col("type").isin(*fixed.TYPES), "type").when(~F.col("signal").isin(*fixed.SIGNAL_RANK), "signal").when(F.length("content") > fixed.CONTENT_CHARS, "size")
    return rows.withColumn("source_ref", F.coalesce("source_ref", F.concat(F.lit("session:harvest-"), "stem"))).withColumn("reject", reason)


def transcripts(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """Lines of transcript files below a folder, as (file, modified, line, type, is_meta, role, content as JSON text)."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    if since is not None:
        raw = raw.filter(F.col("modified") >= since)
    get = lambda p: F.get_json_object("value", p)
    return raw.select("file", "modified", get("$.type").alias("type"), (get("$.isMeta") == "true").alias("is_meta"), get("$.message.role").alias("role"), get("$.message.content").alias("content"))


def newest_first(lines: DataFrame) -> DataFrame:
    """The files of some transcript lines with their time, the newest first; ties by name."""
    return lines.groupBy("file").agg(F.max("modified").alias("modified")).orderBy(F.col("modified").desc(), "file")


def sniff(lines: DataFrame) -> DataFrame:
    """file, valid: a file is a transcript when any of its lines has a type."""
    return lines.groupBy("file").agg(F.coalesce(F.bool_or(F.coalesce("type", F.lit("")) != ""), F.lit(False)).alias("valid"))


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def snapshot(memory: DataFrame, path: str) -> dict[str, int]:
    """Writes a copy and counts it again; a copy whose rows or live rows differ is deleted and an error."""
    memory.write.mode("errorifexists").parquet(path)
    copy = memory.sparkSession.read.parquet(path)
    one, two = (d.agg(F.count("*").alias("total"), F.count_if(F.col("superseded_at").isNull()).alias("live")).first().asDict() for d in (memory, copy))
    if one != two:
        remove(memory.sparkSession, path)
        raise RuntimeError(f"snapshot disagrees: {one} and {two}")
    return two


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: the number of rows and a sum over hashes of whole rows, the same whatever their order."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def import_legacy(spark: SparkSession, source: str, target: str, version: int = VERSION, force: bool = False, keys: dict[str, str] | None = None) -> DataFrame:
    """Copies a table of records of any version to a new place and returns one row that proves it: the source's fingerprint before and
    after, total and live rows of the copy.

    A target that has rows is refused without force. The source is only read; if it changed meanwhile the copy is an error.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(target)
    if not force and there.getFileSystem(conf).exists(there) and not spark.read.parquet(target).isEmpty():
        raise FileExistsError(f"{target} has rows already")
    before = fingerprint(spark.read.parquet(source)).first()
    migrated(spark.read.parquet(source), version, keys).write.mode("overwrite").parquet(target)
    spark.catalog.refreshByPath(source)
    after = fingerprint(spark.read.parquet(source)).first()
    if before != after:
        raise RuntimeError("the source changed while it was copied")
    copy = spark.read.parquet(target).agg(F.count("*").alias("total"), F.count_if(F.col("superseded_at").isNull()).alias("live"))
    return copy.select(F.lit(before["digest"]).alias("before"), F.lit(after["digest"]).alias("after"), "total", "live")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: total and live rows of two tables and whether they agree."""
    side = lambda d, s: d.select(F.lit(s).alias("side"), F.col("superseded_at").isNull().alias("live"))
    count = lambda s, live_: F.count_if((F.col("side") == s) & (F.col("live") | F.lit(not live_)))
    both = side(a, "a").unionAll(side(b, "b")).agg(*(count(s, k).alias(f"{n}_{s}") for s in "ab" for n, k in (("total", False), ("live", True))))
    return both.withColumn("agrees", (F.col("total_a") == F.col("total_b")) & (F.col("live_a") == F.col("live_b")))


def applied(batch: DataFrame, memory: DataFrame, now: Column, allow_tombstones: bool = False, mode: str = "manual", source_ref: str | None = None) -> DataFrame:
    """The table after an ingest: added rows enter, duplicates are folded into their survivor, allowed tombstones take effect.

    The survivor of a content is the live row of the namespace with the smallest id, or the row that entered with it. It gets the
    largest confidence, the stronger signal (on a tie its own), all tags, and one use for each row folded in. Content that is
    known is never overwritten.
    """
    seen = outcomes(batch, memory, now, allow_tombstones, mode)
    rows = policy.capture(validated(batch, now), mode).withColumn("content", F.col("new_content")).withColumn("tags", F.col("new_tags")).drop("new_content", "new_tags", "outcome")
    rows = rows.join(seen, "row_id").withColumn("norm_", T.normalized(F.col("content"))).persist()
    fields = {f.name: f.dataType for f in MEMORY.fields}
    fill = {"retrieval_count": F.lit(0), "surfaced_count": F.lit(0), "valid_from": F.coalesce("valid_from", "ingestion_ts") if "valid_from" in batch.columns else F.col("ingestion_ts")}
    if source_ref is not None:
        fill["source_ref"] = F.coalesce("source_ref", F.lit(source_ref))
    make = lambda c: (fill[c] if c in fill else F.col(c) if c in rows.columns else F.lit(None)).cast(fields[c]).alias(c)
    base = memory.select(*(F.col(c).cast(k).alias(c) for c, k in fields.items())).unionByName(rows.filter("outcome = 'added'").select(*map(make, fields)))

    better = F.struct(signal_rank(F.col("signal")).alias("r"), -F.col("batch_no"), -F.col("line_no"))
    folds = rows.filter("outcome = 'deduped'").groupBy(F.col("namespace").alias("f_ns"), F.col("norm_").alias("f_norm")).agg(
        F.max("confidence").alias("f_conf"), F.max_by("signal", better).alias("f_signal"), F.flatten(F.collect_set(T.tag_list(F.col("tags")))).alias("f_tags"), F.count("*").alias("f_n"))
    tombs = rows.filter("outcome = 'tombstoned'").groupBy(F.col("id").alias("d_id")).agg(F.min("superseded_at" if "superseded_at" in batch.columns else F.lit(None).cast("timestamp")).alias("d_at"), F.first("supersede_reason" if "supersede_reason" in batch.columns else F.lit(None).cast("string")).alias("d_reason"))
    norm = T.normalized(F.col("content"))
    keepers = live(base).groupBy(F.col("namespace").alias("f_ns"), norm.alias("f_norm")).agg(F.min("id").alias("k_id"))
    into = folds.join(keepers, ["f_ns", "f_norm"]).drop("f_ns", "f_norm")
    out = base.join(into, base["id"] == into["k_id"], "left").join(tombs, F.col("id") == F.col("d_id"), "left")
    hit = F.col("f_n").isNotNull()
    tags = F.array_join(F.array_sort(F.array_union(T.tag_list(F.col("tags")), "f_tags")), ",")
    changed = {
        "confidence": F.when(hit, F.greatest(usable(), "f_conf")), "signal": F.when(hit & (signal_rank(F.col("f_signal")) > signal_rank(F.col("signal"))), F.col("f_signal")), "tags": F.when(hit & (tags != ""), tags),
        "retrieval_count": F.when(hit, F.col("retrieval_count") + F.col("f_n")), "superseded_at": F.coalesce("superseded_at", "d_at"), "supersede_reason": F.when(F.col("superseded_at").isNull() & F.col("d_id").isNotNull(), F.col("d_reason")),
    }
    return out.select(*(F.coalesce(changed[c], c).cast(k).alias(c) if c in changed else F.col(c) for c, k in fields.items()))


def summary(outcome: DataFrame) -> DataFrame:
    """One row with the seven counters of an ingest."""
    names = {"added": "added", "tombstoned": "tombstoned", "tombstone_refused": "tombstones_refused", "capture_refused": "capture_refused", "deduped": "deduped", "skipped": "skipped", "malformed": "malformed"}
    return outcome.agg(*(F.count_if(F.col("outcome") == k).alias(v) for k, v in names.items()))
