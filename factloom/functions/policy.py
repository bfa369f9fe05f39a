"""Secrets, injected instructions and what capture does about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions.text import tag_list


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def has_secret(*texts: Column) -> Column:
    return reduce(lambda a, b: a | b, (_text(t).rlike(p) for t in texts for p in fixed.SECRETS))


def redacted(text: Column) -> tuple[Column, Column]:
    """The text with each pattern replaced in turn, and how many replacements that took. Later patterns see earlier results."""
    t, n = _text(text), F.lit(0)
    for p in fixed.SECRETS:
        n = n + F.regexp_count(t, F.lit(p))
        t = F.regexp_replace(t, p, fixed.SECRET_MARK)
    return t, n


def has_injection(*texts: Column) -> Column:
    joined = F.concat_ws(" ", *(F.when(_text(t) != "", t) for t in texts))
    return reduce(lambda a, b: a | b, (joined.rlike(p) for p in fixed.INJECTIONS))


def with_tag(tags: Column, tag: str) -> Column:
    return F.array_join(F.array_sort(F.array_union(tag_list(tags), F.array(F.lit(tag)))), ",")


def capture(rows: DataFrame, mode: str = "manual") -> DataFrame:
    """Adds outcome, and content and tags as they would be stored.

    auto refuses a secret in source_ref, or one that can't be replaced, and redacts content and tags; manual and reviewed only warn. Text that tries to give
    instructions is tagged in every mode. outcome: refused, redacted, warned or clean.
    """
    auto = F.lit(mode == "auto")
    secret = has_secret(F.col("content"), F.col("source_ref"), F.col("tags"))
    content, n_content = redacted(F.col("content"))
    tags, n_tags = redacted(F.col("tags"))
    outcome = F.when(auto & (has_secret(F.col("source_ref")) | (secret & (n_content + n_tags == 0))), "refused").when(auto & secret, "redacted").when(secret, "warned").otherwise("clean")
    out = rows.withColumn("outcome", outcome)
    hit = F.col("outcome") == "redacted"
    out = out.withColumn("new_content", F.when(hit, content).otherwise(F.col("content"))).withColumn("new_tags", F.when(hit, with_tag(tags, "auto-redacted")).otherwise(F.col("tags")))
    risky = has_injection(F.col("new_content"), F.col("source_ref"), F.col("new_tags"))
    return out.withColumn("new_tags", F.when(risky, with_tag(F.col("new_tags"), "prompt-injection-risk")).otherwise(F.col("new_tags")))
