"""Checks of a store's state as data: check, status (pass, warn, fail or skip) and what was measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed


def status_counts(checks: DataFrame) -> DataFrame:
    """One row: how many checks passed, warned, failed and were skipped."""
    return checks.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail", "skip")))


def operational_health(meta: DataFrame, now: Column, due_days: dict[str, float] | None = None) -> DataFrame:
    """check, status, days_ago of each kind of maintenance: a warning when it never ran, when its time can't be read, or when it is
    overdue by more than twice its cadence. meta: key, value, one row a key, the value an ISO time."""
    due_days = due_days or {"backup": fixed.BACKUP_DAYS, "consolidation": fixed.CADENCE_DAYS}
    rows = [meta.agg(F.max(F.when(F.col("key") == f"last_{name}", F.col("value"))).alias("value")).select(F.lit(f"operational-health-{name}").alias("check"), F.lit(float(days)).alias("due"), "value") for name, days in due_days.items()]
    all_ = reduce(DataFrame.unionAll, rows)
    days = (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp("value"))) / 86_400_000_000.0
    status = F.when(days.isNull() | (days > 2 * F.col("due")), "warn").otherwise("pass")
    return all_.select("check", status.alias("status"), F.round(days, 1).alias("days_ago"))


def pending_migration(memory: DataFrame, present: list[str]) -> DataFrame:
    """check, status, stranded: namespaces that still carry an old key whose checkout is present and would be re-keyed next."""
    found = memory.filter(F.col("namespace").isin(present)).agg(F.count_distinct("namespace").alias("stranded"))
    return found.select(F.lit("ns-migration").alias("check"), F.when(F.col("stranded") > 0, "warn").otherwise("pass").alias("status"), "stranded")


def text_sizes(texts: DataFrame, name: str, text: str, lines: int = fixed.TIER0_LINES, size: int = fixed.TIER0_BYTES) -> DataFrame:
    """name, n_lines, n_bytes and status of texts that are injected into every session: a warning above either limit."""
    body = F.coalesce(F.col(text), F.lit(""))
    breaks = F.regexp_count(body, F.lit("\n"))
    n = breaks + F.when((body != "") & ~body.endswith("\n"), 1).otherwise(0)
    sized = texts.select(F.col(name).alias("name"), n.alias("n_lines"), F.octet_length(body).alias("n_bytes"))
    return sized.withColumn("status", F.when((F.col("n_lines") > lines) | (F.col("n_bytes") > size), "warn").otherwise("pass"))


def tier0_size(spark: SparkSession, paths: list[str]) -> DataFrame:
    """text_sizes of the files that exist; one row with status skip when none does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not there:
        return spark.range(1).select(F.lit(None).cast("string").alias("name"), F.lit(0).alias("n_lines"), F.lit(0).alias("n_bytes"), F.lit("skip").alias("status"))
    return text_sizes(spark.read.text(there, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")), "path", "value")


def retention_setting(settings: DataFrame, key: str = "cleanupPeriodDays", default: int = 30) -> DataFrame:
    """check, status, days and configured: after how many days transcripts are deleted. settings: place, value (JSON text), the later
    place wins where it has a positive whole number; anything else counts as unset. It never warns: the setting is the host's policy."""
    value = f"try_variant_get(try_parse_json(value), '$.{key}', 'variant')"
    days = F.when(F.expr(f"schema_of_variant({value}) = 'BIGINT'"), F.expr(f"try_variant_get({value}, '$', 'bigint')"))
    best = settings.select("place", days.alias("days")).filter("days > 0").agg(F.max_by("days", "place").alias("days"))
    return best.select(F.lit("session-retention").alias("check"), F.lit("pass").alias("status"), F.coalesce("days", F.lit(default)).cast("int").alias("days"), F.col("days").isNotNull().alias("configured"))
