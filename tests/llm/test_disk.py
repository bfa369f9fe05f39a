"""Disk: shuffle files go as soon as what was read from them is stored, and the widest rows travel once."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm import near_duplicates as N
from factloom.llm import words
from factloom.llm.history_dedup import FingerprintStore


def left(spark, since: int) -> list[int]:
    """The shuffles made since a number was drawn that still have files."""
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    return [i for i in range(since + 1, spark.sparkContext._jsc.sc().newShuffleId()) if tracker.containsShuffle(i) and tracker.getNumAvailableOutputs(i)]


def number(spark) -> int:
    return spark.sparkContext._jsc.sc().newShuffleId()


def test_cut_leaves_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, since = sorted(df.collect()), number(spark)
    out = words.cut(df)
    assert left(spark, since) == []
    assert sorted(out.collect()) == before


def test_released_frames_are_made_again(spark):
    since, df = number(spark), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = sorted(df.collect())
    assert left(spark, since)
    words.release(spark, since)
    assert left(spark, since) == [] and sorted(df.collect()) == before


def test_matrix_rows_travel_once(spark, data):
    since = number(spark)
    live = spark.read.parquet(f"{data}/memory.parquet").filter("superseded_at is null")
    records, groups = N._prepared(live, "id", "namespace", "content", 20_000)
    assert left(spark, since) == []
    assert records.columns == ["id", "ca", "cb", "sa", "sb"] and records.count() == live.filter("id is not null and content rlike '[a-zA-Z0-9]'").count()
    met = N._met(groups, 7, 10)
    assert met.count() and met.collect()
    assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()


def test_store_leaves_no_shuffle_files(spark, data, tmp_path):
    since = number(spark)
    live = spark.read.parquet(f"{data}/memory.parquet").filter("superseded_at is null")
    store = FingerprintStore(spark, str(tmp_path / "store"))
    store.create(live)
    assert left(spark, since) == []
    # The blocks come from the stored fingerprints.
    assert store._table("blocks", "key long, ca long").select("ca").distinct().count() == store._table("prints", "ca long").distinct().count()
