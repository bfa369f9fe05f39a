"""The queries of this subpackage; `oracle_sql` has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import mixing, packing
from factloom.llm.conversations import conversations
from factloom.llm.format_copies import format_copies
from factloom.llm.history_dedup import stored_cases
from factloom.llm.mixing import mix
from factloom.llm.near_duplicates import matrix_report, near_duplicate_groups, near_duplicate_pairs
from factloom.llm.oracle import oracle_sql
from factloom.llm.paragraph_bands import paragraph_clusters
from factloom.llm.packing import containers, unused_space
from factloom.llm.sessions_by_gap import gap_sessions, scores
from factloom.llm.shared_spans import shared_spans
from factloom.llm.top_n import top_records


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "memory").filter(F.col("superseded_at").isNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(_live(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_live(spark, sf_dir))


def p1_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_report(_live(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_records(_t(spark, sf_dir, "memory"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies(_live(spark, sf_dir))[1]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_cases(_live(spark, sf_dir), _t(spark, sf_dir, "memory_batch"))


def p4_last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of the last batch, checked in a call of its own against a store to which all batches before were appended."""
    return stored_cases(_live(spark, sf_dir), _t(spark, sf_dir, "memory_batch"), last_apart=True)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "container_kind"))


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unused_space(p6_containers(spark, sf_dir))


def p6_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.promises(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "container_kind"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_target"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_target"))[1]


def p7_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.promises(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_target"))


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies(_live(spark, sf_dir))[0]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(_t(spark, sf_dir, "message")).select("session_id", "turn_no", "message_id")


def p5_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_sessions(_t(spark, sf_dir, "message"))


def p5_gap_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sessions by time alone are the known ones: pair precision and recall of 0.9 or more."""
    one = scores(_t(spark, sf_dir, "message"))
    return one.select((F.col("precision") >= 0.9).alias("precise"), (F.col("recall") >= 0.9).alias("complete"))


def p5_gap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(_t(spark, sf_dir, "message"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(_t(spark, sf_dir, "documents"))


def p8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_clusters(_t(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_groups, p1_matrix, p2_found, p3_found, p3_kept, p4_found, p4_last_batch, p5_found, p5_gap_sessions, p5_gap_scores, p5_gap_agreement, p6_containers, p6_unused, p6_promises, p7_mix, p7_shares, p7_promises, p8_found, p8_paragraphs]
    return {f.__name__: f for f in found}


__all__ = ["oracle_sql", "queries"]
