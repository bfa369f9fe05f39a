"""Context rendered under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions import text as T
from factloom.operators.records import live, usable, uses


def pack_rows(memory: DataFrame, namespace: str, limit: int, floor: float = fixed.PACK_CONFIDENCE) -> DataFrame:
    """The rows of a pack in order: confidence, uses, newest; ties by id."""
    if limit < 0:
        raise ValueError("a limit must not be negative")
    rows = live(memory).filter((F.col("namespace") == namespace) & (usable() >= floor)).withColumn("uses", uses())
    order = [F.col("confidence").desc(), F.col("uses").desc(), F.col("ingestion_ts").desc_nulls_last(), F.col("id")]
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def bullet(row_type: Column, content: Column) -> Column:
    return F.concat(F.lit("- ["), row_type, F.lit("] "), T.one_line(content), F.lit("\n"))


def skip_and_continue(lines: Column, start: Column, budget: int) -> Column:
    """struct(text, bytes, kept, skipped): each line that still fits is taken, one that doesn't is counted and passed over."""
    zero = F.struct(F.lit("").alias("text"), start.cast("long").alias("bytes"), F.lit(0).alias("kept"), F.lit(0).alias("skipped"))

    def step(acc: Column, line: Column) -> Column:
        size = acc["bytes"] + F.octet_length(line)
        fits = size <= budget
        return F.struct(
            F.when(fits, F.concat(acc["text"], line)).otherwise(acc["text"]).alias("text"), F.when(fits, size).otherwise(acc["bytes"]).alias("bytes"),
            (acc["kept"] + fits.cast("int")).alias("kept"), (acc["skipped"] + (~fits).cast("int")).alias("skipped"),
        )

    return F.aggregate(lines, zero, step)


def render_pack(memory: DataFrame, namespace: str, limit: int = fixed.PACK_PROJECT, budget: int = fixed.PACK_BYTES, heading: str = "## Memory\n\n", floor: float = fixed.PACK_CONFIDENCE) -> DataFrame:
    """One row: the rendered section, its bytes, and how many rows were kept and left out. The heading counts."""
    rows = pack_rows(memory, namespace, limit, floor)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", bullet(F.col("type"), F.col("content")).alias("line")))), lambda x: x["line"])
    folded = rows.agg(skip_and_continue(lines, F.lit(len(heading.encode())), budget).alias("r"))
    footer = F.when(F.col("r.skipped") > 0, F.concat(F.lit("\n("), F.col("r.skipped"), F.lit(" omitted)\n"))).otherwise("")
    return folded.select(F.concat(F.lit(heading), "r.text", footer).alias("pack"), F.col("r.bytes").alias("bytes"), F.col("r.kept").alias("kept"), F.col("r.skipped").alias("skipped"))


def context_rows(rows: DataFrame, order: list[Column], group: str, budget: int, per_row: int = 300) -> DataFrame:
    """Rows in order until the first that would overflow its group's budget of characters, each cut to per_row."""
    # A line takes a character or more, so no more rows than the budget can be shown: the rest goes before any text is sorted.
    near = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__nth") <= budget).drop("__nth")
    shown = near.withColumn("shown", F.substring(T.one_line(F.col("content")), 1, per_row))
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shown.withColumn("upto", F.sum(F.length("shown") + 1).over(w)).filter(F.col("upto") <= budget)


def budget_of(text: Column, default: int = 9000, most: int = 1_000_000) -> Column:
    """A budget setting as a number: the default for what isn't a positive number, at most a million."""
    n = text.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (n <= 0), F.lit(default)).otherwise(F.least(F.floor(n), F.lit(most))).cast("int")


def fit_json(text: Column, budget: int) -> Column:
    """The longest prefix whose JSON string takes at most `budget` bytes, by a search that halves in 21 steps."""
    def width(n: Column) -> Column:
        return F.octet_length(F.to_json(F.struct(F.substring(text, F.lit(1), n).alias("t")))) - 6

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        fits = width(mid) <= budget
        return F.struct(F.when(fits, mid).otherwise(acc["lo"]).alias("lo"), F.when(fits, acc["hi"]).otherwise(mid - 1).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(21)), F.struct(F.lit(0).alias("lo"), F.least(F.length(text), F.lit(budget)).alias("hi")), step, lambda a: a["lo"])
    return F.substring(text, F.lit(1), found)
