"""Failures, rejections, corrections and error patterns mined from transcripts and tool logs, and the queue of corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import fixed, policy

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,content:string,is_error:boolean>>"


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def blocks(content: Column) -> Column:
    """The typed blocks of a content that is a JSON array; null for plain text. A block's content stays JSON text."""
    return F.when(content.startswith("["), F.from_json(content, BLOCKS))


def result_text(content: Column) -> Column:
    """The text of a result: a plain string, or its text blocks joined by a blank."""
    inner = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(F.filter(inner, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t != ""), " ")
    return F.when(content.startswith("["), F.coalesce(joined, F.lit(""))).otherwise(content)


def is_rejection(text: Column) -> Column:
    return F.lower(text).contains(fixed.REJECTION)


def rejection_reason(text: Column) -> Column:
    """What follows the marker, non-empty lines joined by blanks; '' without one."""
    at = F.instr(F.lower(text), fixed.REASON)
    after = F.substring(text, at + len(fixed.REASON), F.length(text))
    lines = F.filter(F.transform(F.split(after, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(at > 0, F.array_join(lines, " ")).otherwise("")


def tool_results(message: DataFrame) -> DataFrame:
    """session_id, tool_use_id, tool_name, is_error, text, seq of each result, one a tool call: the latest row counts.

    Names come from the calls; '?' where the call is missing.
    """
    rows = message.filter(F.col("tool_use_id").isNotNull() & F.col("session_id").isNotNull())
    role = F.lower(F.trim("role"))
    first = F.get(blocks(F.col("content")), F.lit(0))
    calls = rows.filter(role == "assistant").groupBy("session_id", "tool_use_id").agg(F.min(first["name"]).alias("tool_name"))
    results = rows.filter(role == "user").select("session_id", "tool_use_id", "seq", "stored_ts", "message_id", F.coalesce("is_error", first["is_error"], F.lit(False)).alias("is_error"), result_text(first["content"]).alias("text"))
    last = results.groupBy("session_id", "tool_use_id").agg(F.max_by(F.struct("seq", "is_error", "text"), F.struct("stored_ts", "message_id")).alias("r")).select("session_id", "tool_use_id", "r.*")
    return last.join(calls, ["session_id", "tool_use_id"], "left").withColumn("tool_name", F.coalesce("tool_name", F.lit("?")))


def failures(message: DataFrame) -> DataFrame:
    """Failed results, with what kind of failure each is: rejection, or failure; and the reason of a rejection."""
    text = F.coalesce("text", F.lit(""))
    bad = F.col("is_error") | F.lower(F.ltrim(text)).startswith("error")
    kind = F.when(is_rejection(text), "rejection").otherwise("failure")
    return tool_results(message).filter(bad).select("session_id", "tool_use_id", "tool_name", "seq", kind.alias("kind"), rejection_reason(text).alias("reason"), F.substring(F.regexp_replace(text, r"[\r\n]+", " "), 1, 200).alias("text"))


def tool_failures(tool_usage: DataFrame) -> DataFrame:
    """Calls that changed something and failed."""
    changed = F.coalesce("read_only", F.lit(0)) == 0
    return tool_usage.filter(changed & ((F.lower("status") == "error") | (F.col("exit_code") != 0)))


def latest_per_session(rows: DataFrame, n: int, session: str, order: list[Column]) -> DataFrame:
    """The last n rows of each session in time order, with the session's number of rows."""
    w = Window.partitionBy(session)
    ranked = rows.withColumn("back", F.row_number().over(w.orderBy(*order))).filter(F.col("back") <= n)
    return ranked.join(rows.groupBy(session).agg(F.count("*").alias("of")), session)


def is_user_text(text: Column) -> Column:
    """Whether a text may be a user's own words."""
    return (F.trim(text) != "") & ~any_of(text, fixed.NOT_A_MESSAGE)


def user_messages(message: DataFrame) -> DataFrame:
    """Texts that users wrote: session_id, project_folder, message_id, sent_ts, text. Text blocks are joined by line breaks."""
    rows = message.filter((F.lower(F.trim("type")) == "user") & ~F.coalesce("is_meta", F.lit(False)) & F.col("tool_use_id").isNull())
    own = F.array_join(F.transform(F.filter(blocks(F.col("content")), lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return rows.select("session_id", "project_folder", "message_id", "sent_ts", F.coalesce(own, "content").alias("text")).filter(is_user_text(F.col("text")))


def classify_correction(text: Column) -> Column:
    """struct(kind, patterns, confidence, sentiment, decay_days) of a user's message; kind is null when it corrects nothing."""
    ci = lambda p: text.rlike("(?i)" + p)
    size = F.length(text)

    def result(kind: str, patterns: Column, confidence: Column, sentiment: str, decay: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), patterns.alias("patterns"), F.round(confidence, 2).alias("confidence"), F.lit(sentiment).alias("sentiment"), decay.cast("int").alias("decay_days"))

    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("patterns"), F.lit(0.0).alias("confidence"), F.lit("correction").alias("sentiment"), F.lit(90).alias("decay_days"))
    names = lambda rows: F.array_join(F.filter(F.array(*(F.when(ci(r[0]), F.lit(r[1])) for r in rows)), lambda x: x.isNotNull()), " ")
    has = lambda rows: reduce(lambda a, b: a | b, (ci(r[0]) for r in rows))
    weak_ok = size <= 150
    english = [(p, n, s) for p, n, s in fixed.CORRECTIONS]
    hits = F.filter(F.array(*(F.when(ci(p) & (F.lit(s) | weak_ok), F.struct(F.lit(n).alias("n"), F.lit(s).alias("s"))) for p, n, s in english)), lambda x: x.isNotNull())
    strong = has([r for r in english if r[2]]) | has(fixed.CJK)
    told, many = F.exists(hits, lambda h: h["n"] == "I-told-you"), F.size(hits)
    base = F.when(told | (many >= 3), 0.85).when(many == 2, 0.75).when(F.exists(hits, lambda h: h["s"]), 0.70).otherwise(0.55)
    decay = F.when(told | (many >= 3), 120).when(many == 2, 90).when(F.exists(hits, lambda h: h["s"]), 60).otherwise(45)
    sized = F.when(size < 80, F.least(base + 0.10, F.lit(0.90))).when(size > 300, F.greatest(base - 0.15, F.lit(0.50))).when(size > 150, F.greatest(base - 0.10, F.lit(0.55))).otherwise(base)
    cjk_sized = F.when(size < 80, 0.85).when(size > 300, 0.60).otherwise(0.75)
    short = F.when(text.rlike(fixed.CJK_CHARS), size <= 2).otherwise(size <= 4)
    out = F.when(text.isNull() | short, none).when(ci(fixed.EXPLICIT[0][0]), result("explicit", F.lit(fixed.EXPLICIT[0][1]), F.lit(fixed.EXPLICIT[0][2]), "correction", F.lit(fixed.EXPLICIT[0][3])))
    for p, n, c, d in fixed.GUARDRAILS:
        out = out.when(ci(p), result("guardrail", F.lit(n), F.lit(c), "correction", F.lit(d)))
    out = out.when(reduce(lambda a, b: a | b, (ci(p) for p in fixed.FALSE_POSITIVES)) & ~strong, none).when(reduce(lambda a, b: a | b, (ci(p) for p in fixed.POLITE)), none)
    for p, n, c, d in fixed.POSITIVE:
        out = out.when(ci(p), result("positive", F.lit(n), F.lit(c), "positive", F.lit(d)))
    out = out.when(has(fixed.CJK), result("auto", names(fixed.CJK), cjk_sized, "correction", F.lit(90)))
    return out.when(many > 0, result("auto", F.array_join(F.transform(hits, lambda h: h["n"]), " "), sized, "correction", decay)).otherwise(none)


def collapse_key(text: Column) -> Column:
    """Lower case, single blanks, without the marks . , ! ? ; : ' " ( ) [ ]."""
    return F.regexp_replace(F.trim(F.translate(F.lower(text), ".,!?;:'\"()[]", "")), r"\s+", " ")


def collapse(items: DataFrame, group: str, text: str, ts: str, seq: str) -> DataFrame:
    """One row for each group and collapse key: the latest (on ties the first seen), the number of rows, and the first place."""
    keyed = items.withColumn("key", collapse_key(F.col(text)))
    latest = F.max_by(F.struct(*items.columns), F.struct(F.col(ts), -F.col(seq)))
    return keyed.groupBy(group, "key").agg(latest.alias("item"), F.count("*").alias("occurrences"), F.min(seq).alias("first_seen")).select("key", "item.*", "occurrences", "first_seen")


def error_type(text: Column) -> Column:
    """The first matching error type; null for noise and for what is unknown."""
    t = F.coalesce(text, F.lit(""))
    out = F.when((t == "") | any_of(t, tuple("(?i)" + p for p in fixed.ERROR_NOISE)), None)
    for name, pattern, _ in fixed.ERRORS:
        out = out.when(t.rlike("(?i)" + pattern), name)
    return out


def guideline(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for name, _, g in fixed.ERRORS for x in (name, g))), kind)


def error_patterns(errors: DataFrame, group: str, order: list[str], text: str = "text", min_count: int = 2) -> DataFrame:
    """Errors by type and group with at least min_count rows: count, priority, guideline and the first three samples.

    The samples are the first by order; a group limit before the shuffle keeps three from each of its parts, so no list grows.
    """
    typed = errors.withColumn("error_type", error_type(F.col(text))).filter("error_type is not null")
    keys = ["error_type", group]
    counts = typed.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    first = typed.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth <= 3")
    samples = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.substring(text, 1, 200).alias("s")))), lambda x: x["s"]), " | ").alias("samples"))
    priority = F.when(F.col("n") >= 5, 0.90).when(F.col("n") >= 3, 0.85).otherwise(0.70)
    return counts.join(samples, keys).withColumn("priority", priority).withColumn("guideline", guideline(F.col("error_type")))


def queue_items(corrections: DataFrame, errors: DataFrame) -> DataFrame:
    """Corrections and error patterns as queue rows with a stable key, error rows at confidence .6 and 180 days."""
    c = corrections.select(F.sha2(F.concat_ws("|", F.lit("correction"), "project_folder", "key"), 256).alias("dedup_key"), F.lit("correction").alias("item_kind"), "project_folder", F.col("text").alias("message"), "confidence", "decay_days")
    e = errors.select(F.sha2(F.concat_ws("|", F.lit("error"), "project_folder", "error_type"), 256).alias("dedup_key"), F.lit("error").alias("item_kind"), "project_folder", F.col("guideline").alias("message"), F.lit(0.6).alias("confidence"), F.lit(180).alias("decay_days"))
    return c.unionByName(e)


def queue_new(items: DataFrame, queue: DataFrame) -> DataFrame:
    return items.join(queue.select("dedup_key"), "dedup_key", "left_anti").dropDuplicates(["dedup_key"])


def queue_capped(items: DataFrame, cap: int = fixed.QUEUE_ROWS) -> DataFrame:
    """The newest rows of each namespace; a missing time counts as the oldest. Ties go by item_id."""
    order = [F.col("captured_ts").desc_nulls_last(), F.col("item_id").asc()]
    return items.withColumn("place", F.row_number().over(Window.partitionBy("namespace").orderBy(*order))).filter(F.col("place") <= cap)


def is_stale(captured: Column, decay_days: Column, now: Column) -> Column:
    """Older than its decay, which must be a day or more; never stale without a time."""
    age = (F.unix_micros(now) - F.unix_micros(captured)) / 86_400_000_000.0
    return F.coalesce((decay_days >= 1) & (age > decay_days), F.lit(False))


def queue_clear(items: DataFrame, now: Column, ids: list[str] | None = None, everything: bool = False) -> DataFrame:
    """What remains after clearing by id, all, or what is stale and of little confidence."""
    if everything:
        return items.limit(0)
    if ids is not None:
        return items.filter(~F.col("item_id").isin(*ids))
    return items.filter(~(is_stale(F.col("captured_ts"), F.col("decay_days"), now) & F.coalesce(F.col("confidence") < 0.6, F.lit(False))))


def pattern_histogram(items: DataFrame) -> DataFrame:
    """Rows by pattern name."""
    return items.select(F.explode(F.split("patterns", r"\s+")).alias("pattern")).filter("pattern <> ''").groupBy("pattern").agg(F.count("*").alias("n"))


def unmatched_sample(items: DataFrame, n: int, text: str = "message", order: str = "item_id") -> DataFrame:
    """The first n items that match no pattern."""
    if n < 0:
        raise ValueError("a limit must not be negative")
    return items.filter(F.trim(F.coalesce("patterns", F.lit(""))) == "").orderBy(F.col(order)).limit(n).select(order, text)


def folder_candidates(path: Column) -> Column:
    """Names under which a project's transcripts may lie: separators as dashes behind a leading one; the same with the dashes of the
    last part as underscores; and for a path with a drive the form without leading dash and colon."""
    dashed = F.concat(F.lit("-"), F.regexp_replace(F.translate(path, "/\\", "--"), "^-", ""))
    base = F.regexp_extract(path, r"([^/\\]+)$", 1)
    swapped = F.when(base.contains("-") & dashed.endswith(base), F.concat(F.substring(dashed, F.lit(1), F.length(dashed) - F.length(base)), F.translate(base, "-", "_")))
    drive = F.when(dashed.contains(":"), F.translate(F.substring(dashed, F.lit(2), F.length(dashed)), ":", "-"))
    return F.array_distinct(F.filter(F.array(dashed, swapped, drive), lambda x: x.isNotNull()))


DETAILS = {"tool_name": "string", "error_message": "string", "error_type": "string", "retry_count": "int", "destructive": "int", "completed_at": "timestamp"}


def failures_from_db(tool_usage: DataFrame, session: str, limit: int = 50) -> DataFrame:
    """tool, error, error_type, retry_count, destructive and n of a session's latest failed calls; n counts all of them.

    Columns that the table lacks come out empty, with '?' for the tool.
    """
    rows = tool_usage
    for c, kind in DETAILS.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    failed = tool_failures(rows.filter(F.col("session_id") == session))
    counted = failed.withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    order = [F.col("completed_at").desc_nulls_last(), F.col("tool_name").asc_nulls_last(), F.col("error_message").asc_nulls_last()]
    empty = lambda c: F.coalesce(c, F.lit(""))
    shown = F.substring(F.regexp_replace(empty("error_message"), r"[\r\n]+", " "), 1, 200)
    return counted.orderBy(*order).limit(limit).select(F.coalesce("tool_name", F.lit("?")).alias("tool"), shown.alias("error"), empty("error_type").alias("error_type"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"), (F.coalesce("destructive", F.lit(0)) != 0).alias("destructive"), "n")


def session_failures(session: str, message: DataFrame | None = None, tool_usage: DataFrame | None = None) -> DataFrame:
    """tool, error, kind and reason of a session's failed calls, the latest first: from its transcript where there is one, else from
    the log of tool calls, which knows no rejections. Neither is an error."""
    if message is not None:
        rows = failures(message.filter(F.col("session_id") == session))
        return rows.orderBy(F.col("seq").desc_nulls_last(), "tool_use_id").select(F.col("tool_name").alias("tool"), F.col("text").alias("error"), "kind", "reason")
    if tool_usage is None:
        raise ValueError("neither a transcript nor a log of tool calls")
    return failures_from_db(tool_usage, session).select("tool", "error", F.lit("failure").alias("kind"), F.lit("").alias("reason"))


def mined(message: DataFrame, min_count: int = 2, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corrections, error patterns and rejections of all transcripts, secrets in their texts redacted.

    Corrections are collapsed by project and normalized text; with a limit the first of them come out, by first occurrence.
    """
    said = user_messages(message).withColumn("c", classify_correction(F.col("text"))).filter("c.kind is not null")
    hidden = lambda c: policy.redacted(F.col(c))[0].alias(c)
    slim = said.select("project_folder", "text", "sent_ts", "message_id", F.col("c.kind").alias("kind"), F.col("c.confidence").alias("confidence"), F.col("c.decay_days").alias("decay_days"))
    corrections = collapse(slim, "project_folder", "text", "sent_ts", "message_id").withColumn("secret_warning", policy.has_secret(F.col("text"))).withColumn("text", hidden("text"))
    if limit is not None:
        if limit < 0:
            raise ValueError("a limit must not be negative")
        corrections = corrections.orderBy("first_seen", "project_folder", "key").limit(limit)
    folders = message.groupBy("session_id").agg(F.min("project_folder").alias("project_folder"))
    failed = failures(message).join(folders, "session_id")
    errors = error_patterns(failed.filter("kind = 'failure'"), "project_folder", ["session_id", "seq", "tool_use_id"], min_count=min_count).withColumn("samples", hidden("samples"))
    rejections = failed.filter("kind = 'rejection'").select("project_folder", "session_id", "tool_name", hidden("reason"))
    return corrections, errors, rejections
