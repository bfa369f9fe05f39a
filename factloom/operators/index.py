"""A stored inverted index: postings clustered by term in a folder, read by ranges of terms, and the sums that BM25 needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS = "term string, id string, tf int, dl int, lead string"
#: Parts into which the postings of one lead are split, so that a term that every row has isn't gathered in one task.
SPLIT = 16


def postings(rows: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
    """term, id, tf and dl, the number of tokens of the row: one row for each term of each row."""
    each = rows.select(F.col(id_col).alias("id"), tokens.alias("toks")).select("id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    return each.groupBy("term", "id", "dl").agg(F.count("*").cast("int").alias("tf")).select("term", "id", "tf", "dl")


def write(rows: DataFrame, tokens: Column, path: str, id_col: str = "id", append: bool = False) -> None:
    """Stores the postings of rows by the first two characters of the term, sorted by term, and one row of sums.

    With append the rows are further ones: their postings and sums lie beside those that are there. Rows are never taken out, because
    the statistics hold tombstones too.
    """
    mode = "append" if append else "overwrite"
    lead = F.substring("term", 1, 2)
    table = postings(rows, tokens, id_col).withColumn("lead", lead)
    table.repartition("lead", F.pmod(F.xxhash64("id"), F.lit(SPLIT))).sortWithinPartitions("lead", "term", "id").write.mode(mode).partitionBy("lead").parquet(f"{path}/postings")
    rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("long").alias("tokens")).coalesce(1).write.mode(mode).parquet(f"{path}/sums")


def after(term: str) -> str:
    """The first string behind all that begin with a term."""
    return term[:-1] + chr(ord(term[-1]) + 1)


def lookup(spark: SparkSession, path: str, terms: list[str]) -> tuple[DataFrame, tuple[int, float]]:
    """id, dl and tf0, tf1, ... of the rows that have a token with one of the terms as prefix; number and mean length of all rows.

    The terms' folders are picked by name and their row groups by the order of terms: nothing else is read.
    """
    table = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    at = F.lit(False)
    for t in terms:
        folder = F.col("lead") == t[:2] if len(t) > 1 else (F.col("lead") >= t) & (F.col("lead") < after(t))
        at = at | (folder & (F.col("term") >= t) & (F.col("term") < after(t)))
    tf = [F.sum(F.when(F.col("term").startswith(t), F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    hits = table.filter(at).groupBy("id").agg(F.max("dl").alias("dl"), *tf)
    sums = spark.read.schema("n long, tokens long").parquet(f"{path}/sums").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    return hits, (sums["n"], sums["tokens"] / sums["n"] if sums["n"] else 1.0)
