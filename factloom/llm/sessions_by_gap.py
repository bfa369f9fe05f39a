"""Sessions of rows that carry no session, by channel and inactivity gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours of a channel that one window holds.
HOURS = 24


def speaker(role: Column, kind: Column, tool_use_id: Column) -> Column:
    """user, assistant or system: the role where it is known, else the row's type, else null. Case and blanks don't matter."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    known = lambda c: F.when(clean(c).isin("user", "assistant", "system"), clean(c))
    return F.coalesce(known(role), F.when(clean(role).isin("tool", "function") & tool_use_id.isNotNull(), "user"), known(kind))


def with_previous(rows: DataFrame, channel: str, ts: str, *keep: str) -> DataFrame:
    """Adds `before`, the time of the channel's row before, and `kept_before` for each column of keep.

    Windows span HOURS of a channel; the last row of a span is carried to the next one by a window over spans, so a channel
    may hold a third of all rows.
    """
    span = F.floor(F.unix_micros(ts) / (HOURS * 3_600_000_000))
    cols = F.struct(F.col(ts).alias("ts"), *(F.col(c) for c in keep))
    timed = rows.withColumn("span", span).repartition(channel, "span")
    w = Window.partitionBy(channel, "span").orderBy(ts, "message_id")
    inner = timed.withColumn("prev", F.lag(cols).over(w)).withColumn("nth", F.row_number().over(w))
    last = timed.groupBy(channel, "span").agg(F.max_by(cols, F.struct(ts, "message_id")).alias("last"))
    carried = last.withColumn("carry", F.lag("last").over(Window.partitionBy(channel).orderBy("span"))).select(channel, "span", "carry")
    both = inner.join(carried, [channel, "span"]).withColumn("prev", F.when(F.col("nth") == 1, F.col("carry")).otherwise(F.col("prev")))
    return both.withColumn("before", F.col("prev.ts")).select(*rows.columns, "span", "before", *(F.col(f"prev.{c}").alias(f"{c}_before") for c in keep))


def calibrated_gap(rows: DataFrame, channel: str, ts: str, session: str) -> float:
    """The gap in seconds that best tells rows of one session from rows of two, over all neighbouring rows of all channels.

    Both kinds of gap are counted in bins of a quarter of a power of two; the edge with the fewest rows on the wrong side wins.
    The counts that reach the driver are at most a few hundred, whatever the table. Without any gap it is infinite.
    """
    near = with_previous(rows, channel, ts, session).filter("before is not null")
    gap = (F.unix_micros(ts) - F.unix_micros("before")) / 1e6
    bins = near.select(F.floor(F.log2(F.greatest(gap, F.lit(1e-6))) * 4).alias("bin"), (F.col(session) == F.col(f"{session}_before")).alias("same")).groupBy("bin", "same").count().collect()
    inside, between = ({r["bin"]: r["count"] for r in bins if r["same"] is want} for want in (True, False))
    best, wrong = float("inf"), sum(between.values())
    for edge in sorted({*inside, *between}):
        cost = sum(n for b, n in inside.items() if b >= edge) + sum(n for b, n in between.items() if b < edge)
        if cost < wrong:
            best, wrong = 2.0 ** (edge / 4), cost
    return best


def considered(message: DataFrame, channel: str = "project_folder", ts: str = "sent_ts", labelled: str = "session_id") -> DataFrame:
    """The rows that can be in a session: channel, at, role, message_id and known, the session they are known to be of."""
    rows = message.filter(~F.coalesce("is_meta", F.lit(False))).select(
        F.col(channel).alias("channel"), F.coalesce(ts, "stored_ts").alias("at"), "message_id", speaker(F.col("role"), F.col("type"), F.col("tool_use_id")).alias("role"), F.col(labelled).alias("known"), F.xxhash64("content", "tool_use_id").alias("what"),
    ).filter(F.col("channel").isNotNull() & F.col("at").isNotNull() & F.col("role").isin("user", "assistant"))
    return rows.groupBy("channel", "at", "role", "what").agg(F.min("message_id").alias("message_id"), F.min_by("known", "message_id").alias("known")).drop("what")


def scores(message: DataFrame, gap: float | None = None) -> DataFrame:
    """One row: how the sessions by gap agree with the known ones, over pairs of rows: pairs of one session found, pairs of one known
    session that has a row of either speaker, pairs that are both, and so precision and recall; and the known sessions that come out whole.

    Rows that don't come out are alone. Pairs are counted by the sizes of sessions, never formed.
    """
    rows = considered(message).persist()
    answered = rows.groupBy("known").agg(F.count_distinct("role").alias("roles")).filter("known is not null and roles = 2").select("known")
    rows = rows.join(answered.hint("merge"), "known")
    placed = rows.select("message_id", "known").join(gap_sessions(message, gap).select("message_id", "channel", "session_start").hint("merge"), "message_id", "left")
    pairs = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).cast("long")
    out = F.col("session_start").isNotNull()
    cell = placed.groupBy("known", "channel", "session_start").agg(F.count("*").alias("n")).persist()
    by_found = cell.filter(out).groupBy("channel", "session_start").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    by_known = cell.groupBy("known").agg(F.sum("n").alias("n"))
    # A known session is whole when it and a found one are the same rows.
    same = cell.filter(out).join(by_found.withColumnRenamed("n", "nf"), ["channel", "session_start"]).join(by_known.withColumnRenamed("n", "nk"), "known").filter("n = nf and n = nk")
    parts = [by_found.agg(pairs(F.col("n")).alias("x")), by_known.agg(pairs(F.col("n")).alias("x")), cell.filter(out).agg(pairs(F.col("n")).alias("x")), by_known.agg(F.count("*").alias("x")), same.agg(F.count("*").alias("x"))]
    names = ["pairs_found", "pairs_known", "pairs_both", "sessions_known", "sessions_whole"]
    long = parts[0].select(F.lit(names[0]).alias("k"), "x")
    for name, p in zip(names[1:], parts[1:]):
        long = long.unionAll(p.select(F.lit(name).alias("k"), "x"))
    one = long.agg(*(F.max(F.when(F.col("k") == n, F.col("x"))).alias(n) for n in names))
    share = lambda of: F.round(F.col("pairs_both") / F.greatest(F.col(of), F.lit(1)), 4)
    return one.withColumn("precision", share("pairs_found")).withColumn("recall", share("pairs_known"))


def gap_sessions(message: DataFrame, gap: float | None = None, channel: str = "project_folder", ts: str = "sent_ts", labelled: str = "session_id") -> DataFrame:
    """channel, session_start, turn_no, message_id and role of the sessions of each channel that have replies.

    Rows are put in order of time (stored_ts where sent_ts is missing; rows without either are left out), a gap longer than
    `gap` seconds begins a session, and a gap of None is calibrated on the rows whose session is known. Roles are read or
    inferred by `speaker`; rows without a role, system rows, and meta rows are left out, as are later deliveries of a row with
    equal channel, time, role and content. A session comes out when the user is answered: a row of the assistant follows one of
    the user's. Rows without a channel belong to no session.
    """
    rows = considered(message, channel, ts, labelled).persist()
    if gap is None:
        gap = calibrated_gap(rows, "channel", "at", "known")
    placed = with_previous(rows, "channel", "at")
    starts = F.col("before").isNull() | ((F.unix_micros("at") - F.unix_micros("before")) / 1e6 >= gap)
    w = Window.partitionBy("channel", "span").orderBy("at", "message_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = placed.withColumn("start", F.last(F.when(starts, F.col("at")), ignorenulls=True).over(w))
    # A session that began in an earlier span: the last start before, carried over the spans.
    spans = marked.groupBy("channel", "span").agg(F.max("start").alias("own"))
    carry = spans.withColumn("carry", F.max("own").over(Window.partitionBy("channel").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).select("channel", "span", "carry")
    whole = marked.join(carry, ["channel", "span"]).withColumn("session_start", F.coalesce("start", "carry")).select("channel", "span", "session_start", "at", "message_id", "role").persist()
    # Numbers by span of a session, then over its spans.
    inner = whole.withColumn("nth", F.row_number().over(Window.partitionBy("channel", "session_start", "span").orderBy("at", "message_id")))
    sizes = whole.groupBy("channel", "session_start", "span").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("channel", "session_start").orderBy("span")) - F.col("n")).drop("n")
    key = F.struct("at", "message_id")
    replied = whole.groupBy("channel", "session_start").agg(F.min(F.when(F.col("role") == "user", key)).alias("asked"), F.max(F.when(F.col("role") == "assistant", key)).alias("answered")).filter("asked < answered").select("channel", "session_start")
    out = inner.join(base, ["channel", "session_start", "span"]).join(replied, ["channel", "session_start"])
    return out.select("channel", "session_start", (F.col("nth") + F.col("base")).cast("int").alias("turn_no"), "message_id", "role")
