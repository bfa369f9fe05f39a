"""Per-session counters, one-shot nudges and the correction queue on Structured Streaming, with their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.functions import fixed
from factloom.operators.mining import classify_correction, is_user_text, queue_capped

NUDGES = "session_id string, nudge string, at_call long"
STATE = "calls long, successes long, fired boolean, committed boolean, failed boolean"
#: Idle time after which a session's state is dropped.
TTL_MS = 7 * 86_400_000


def nudges(events: DataFrame, every: int = 10, modulo: bool = False, ttl_ms: int = TTL_MS) -> DataFrame:
    """Nudges of each session of a stream of (session_id, tool_name, failed, is_commit, ts).

    convention: once, at the `every`th call, or with modulo at every such success. commit: once, at the first commit. failure:
    once, at the first failure. Within a micro-batch events count in order of ts. State is a few numbers a session and is
    dropped after the time to live.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls, good, fired, committed, failed = state.get if state.exists else (0, 0, False, False, False)
        out = []
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for bad, commit in zip(pdf["failed"], pdf["is_commit"]):
            calls += 1
            good += not bad
            if modulo and not bad and good % every == 0:
                out.append(("convention", calls))
            if not modulo and not fired and calls >= every:
                fired = True
                out.append(("convention", calls))
            if commit and not committed:
                committed = True
                out.append(("commit", calls))
            if bad and not failed:
                failed = True
                out.append(("failure", calls))
        state.update((calls, good, fired, committed, failed))
        state.setTimeoutDuration(ttl_ms)
        if out:
            yield pd.DataFrame({"session_id": key[0], "nudge": [x[0] for x in out], "at_call": [x[1] for x in out]})

    return events.groupBy("session_id").applyInPandasWithState(step, NUDGES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def nudges_batch(events: DataFrame, order: list[Column], every: int = 10) -> DataFrame:
    """What `nudges` (once, not modulo) gives over a whole table, by windows."""
    w = Window.partitionBy("session_id").orderBy(*order)
    n = events.withColumn("at_call", F.row_number().over(w).cast("long"))
    one = lambda name, cond: n.filter(cond).groupBy("session_id").agg(F.min("at_call").alias("at_call")).select("session_id", F.lit(name).alias("nudge"), "at_call")
    return one("convention", F.col("at_call") >= every).unionAll(one("commit", F.col("is_commit"))).unionAll(one("failure", F.col("failed")))


def every_nth_batch(events: DataFrame, order: list[Column], every: int = 10) -> DataFrame:
    """session_id and at_call of every `every`th success of each session: what `nudges` gives with modulo over a whole table."""
    w = Window.partitionBy("session_id").orderBy(*order)
    good = F.sum((~F.col("failed")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = events.withColumn("at_call", F.row_number().over(w).cast("long")).withColumn("good", good)
    return n.filter(~F.col("failed") & (F.col("good") % every == 0)).select("session_id", "at_call")


def first_failures(events: DataFrame, lessons: DataFrame, ttl: str = "7 days") -> DataFrame:
    """The first failure of each session of a stream that no lesson covers: deduplicated by session, then an anti join. A session's state
    goes when the stream's time is past its failure by the time to live."""
    rows = events.withWatermark("ts", ttl) if events.isStreaming else events
    first = rows.filter("failed").dropDuplicatesWithinWatermark(["session_id"]) if events.isStreaming else rows.filter("failed").dropDuplicates(["session_id"])
    return first.join(lessons.select("session_id"), "session_id", "left_anti")


def delivery(armed: DataFrame) -> DataFrame:
    """Of each session's armed nudges the one to deliver: failure, then convention, then the generic one."""
    rank = F.when(F.col("nudge") == "failure", 1).when(F.col("nudge") == "convention", 2).otherwise(3)
    return armed.groupBy("session_id").agg(F.min_by("nudge", F.struct(rank, "nudge")).alias("nudge"))


def not_looping(events: DataFrame, flag: str = "stop_hook_active") -> DataFrame:
    """Stop events that weren't themselves caused by a stop hook: the others get no answer, so none can go round in a loop."""
    return events.filter(~F.coalesce(F.col(flag), F.lit(False)))


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Calls and failures by tool and event-time window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "tool_name").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"))


def queue_sink(path: str, cap: int = fixed.QUEUE_ROWS):  # noqa: ANN201
    """A foreachBatch function that classifies user messages, adds the corrections to the queue and keeps each namespace's newest.

    Each micro-batch writes a new version of the queue beside the old one; the version is its number, so a repeated batch
    overwrites its own result.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = batch.filter(is_user_text(F.col("text"))).withColumn("c", classify_correction(F.col("text"))).filter("c.kind is not null")
        new = found.select(F.col("message_id").cast("string").alias("item_id"), "namespace", F.col("text").alias("message"), "c.confidence", "c.decay_days", F.col("ts").alias("captured_ts"))
        if number > 0:
            new = spark.read.parquet(f"{path}/v={number - 1}").drop("place").unionByName(new)
        queue_capped(new.dropDuplicates(["item_id"]), cap).drop("place").write.mode("overwrite").parquet(f"{path}/v={number}")

    return run
