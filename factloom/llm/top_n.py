"""The best N rows of every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, order: list[Column], n: int = 5, salts: int = 32, rank_name: str = "rank_no") -> DataFrame:
    """The first n rows of each group in the given order, with their rank from 1.

    Every group is hashed over its rows into `salts` subgroups. Each subgroup keeps its n best (Spark cuts them once more before
    the shuffle, with a group limit), then the survivors, at most n * salts rows of a group, are ranked together. No task sorts a
    whole hot group, and the result doesn't depend on the salts because any row among the best n of its group is among the best n
    of its subgroup. `order` must be total for a repeatable result; rows equal in it and in every column are interchangeable.
    Null groups form a group. A clashing column rank_name is replaced.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    salt, rank, df = "__salt", "__rank", df.drop(rank_name)
    kept = (
        df.withColumn(salt, F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(salts)))
        .withColumn(rank, F.row_number().over(Window.partitionBy(group, salt).orderBy(*order))).filter(F.col(rank) <= n).drop(salt, rank)
    )
    return kept.withColumn(rank_name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank_name) <= n)


def usable(confidence: str = "confidence") -> Column:
    """A confidence in 0..1; null for one that is null, NaN or outside."""
    c = F.col(confidence)
    return F.when(~F.isnan(c) & c.between(0.0, 1.0), c)


def top_records(memory: DataFrame, n: int = 5, salts: int = 32) -> DataFrame:
    """namespace, rank_no, id of the n live records of each namespace by confidence, then last_retrieved, then id.

    Missing confidences and times come last, as does a null id.
    """
    rows = memory.filter(F.col("superseded_at").isNull()).select("namespace", "id", usable().alias("score"), "last_retrieved")
    order = [F.col("score").desc_nulls_last(), F.col("last_retrieved").desc_nulls_last(), F.col("id").asc_nulls_last()]
    return top_n(rows, "namespace", order, n, salts).select("namespace", "rank_no", "id")
