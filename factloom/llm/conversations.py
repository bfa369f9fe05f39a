"""Conversations rebuilt from message rows.

Rows are put in order inside their channel, cut where a gap shows that something is missing, given a speaker, and the sessions
that are broken, empty or without replies are dropped. Everything about a session is decided by aggregates and by windows over
blocks of its rows, so one session may be as long as a third of the table.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Rows of a session that one window holds.
BLOCK = 4096


@F.pandas_udf(BooleanType())
def _array_has_text(content: pd.Series) -> pd.Series:
    """For contents that may be a JSON array: whether its blocks of type text hold any; null for what is no JSON array."""

    def one(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            blocks = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if not isinstance(blocks, list):
            return None
        return any(isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"].strip() for b in blocks)

    return pd.Series([one(x) for x in content], dtype="object")


def latest_rows(message: DataFrame) -> DataFrame:
    """Of rows with equal session_id and seq the one with the latest stored_ts, then the largest message_id, in slim form."""
    blank = r"(?U)^[\s\x1c-\x1f]*$"
    role = F.lower(F.regexp_replace("role", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    maybe = F.when(F.col("tool_use_id").isNull() & F.col("content").rlike(r"(?U)^\s*\["), F.col("content"))
    slim = message.filter(F.col("session_id").isNotNull()).select(
        "session_id", "seq", "stored_ts", "message_id", role.alias("role"), "tool_use_id", F.coalesce("is_meta", F.lit(False)).alias("is_meta"),
        F.coalesce(_array_has_text(maybe), ~F.col("content").rlike(blank), F.lit(False)).alias("has_text"),
    )
    best = slim.groupBy("session_id", "seq").agg(F.max(F.struct("stored_ts", "message_id", "role", "tool_use_id", "is_meta", "has_text")).alias("m"))
    kept = best.select("session_id", "seq", "m.message_id", "m.role", "m.tool_use_id", "m.is_meta", "m.has_text")
    left_out = (F.col("role").eqNullSafe("system")) | F.col("is_meta") | (F.col("tool_use_id").isNull() & ~F.col("has_text"))
    return kept.withColumn("turn", ~left_out)


def conversations(message: DataFrame) -> DataFrame:
    """session_id, turn_no, message_id and role of every row of the sessions that are whole.

    A session is whole when its seq runs 1, 2, 3, ... (a larger step is the gap that marks a lost row), all roles are known,
    every tool call has its one result behind it, and of the rows with text the first is the user's, the last the assistant's
    and no two of the user's follow each other. Rows without a session_id belong to no session; an empty table gives no rows.
    """
    rows = latest_rows(message).withColumn("blk", F.floor((F.col("seq") - 1) / BLOCK)).repartition("session_id", "blk").persist()
    text = F.col("turn") & F.col("tool_use_id").isNull()
    known = F.coalesce(F.col("role").isin("user", "assistant", "system"), F.lit(False))

    # By session: gaps, roles, first and last speaker. Null seqs and unknown roles count as breaks.
    head = rows.groupBy("session_id").agg(
        F.count("*").alias("n"), F.count("seq").alias("n_seq"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.bool_and(known).alias("roles"),
        F.min_by(F.when(text, F.col("role")), F.when(text, F.col("seq"))).alias("first"), F.max_by(F.when(text, F.col("role")), F.when(text, F.col("seq"))).alias("last"),
    )
    whole = head.filter("n = n_seq and lo = 1 and hi = n and roles and first = 'user' and last = 'assistant'").select("session_id")

    # By tool_use_id: one call, one result, in this order.
    call, result = F.col("role") == "assistant", F.col("role") == "user"
    tools = rows.filter(F.col("turn") & F.col("tool_use_id").isNotNull()).groupBy("session_id", "tool_use_id").agg(
        F.count_if(call).alias("calls"), F.count_if(result).alias("results"), F.max(F.when(call, F.col("seq"))).alias("c"), F.min(F.when(result, F.col("seq"))).alias("r"))
    broken_tools = tools.filter(~F.coalesce((F.col("calls") == 1) & (F.col("results") == 1) & (F.col("r") > F.col("c")), F.lit(False))).select("session_id")

    # By block, then over the blocks of a session: numbers, and users that follow each other.
    w = Window.partitionBy("session_id", "blk").orderBy("seq")
    inner = rows.filter("turn").withColumn("nth", F.row_number().over(w)).withColumn(
        "before", F.last(F.when(text, F.col("role")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = inner.groupBy("session_id", "blk").agg(
        F.count("*").alias("turns"), F.min_by(F.when(text, F.col("role")), F.when(text, F.col("seq"))).alias("b_first"), F.max_by(F.when(text, F.col("role")), F.when(text, F.col("seq"))).alias("b_last"),
        F.coalesce(F.bool_or(text & (F.col("role") == "user") & (F.col("before") == "user")), F.lit(False)).alias("two"),
    )
    prior = Window.partitionBy("session_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("base", F.coalesce(F.sum("turns").over(prior), F.lit(0))).withColumn("p_last", F.last("b_last", ignorenulls=True).over(prior))
    broken_turns = carried.filter("two or (b_first = 'user' and p_last = 'user')").select("session_id")

    good = whole.join(broken_tools, "session_id", "left_anti").join(broken_turns, "session_id", "left_anti")
    return (
        inner.join(carried.select("session_id", "blk", "base"), ["session_id", "blk"]).join(good, "session_id")
        .select("session_id", (F.col("nth") + F.col("base")).cast("int").alias("turn_no"), "message_id", "role")
    )
