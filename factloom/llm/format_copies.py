"""Records that differ in formatting only, collapsed to one each with the number of copies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import halves, signed, words


def value_words(value: object) -> str:
    """The words of a JSON value: of a string its own, of anything else those of its JSON text."""
    return " ".join(words(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)))


def canonical(content: str | None) -> str:
    """The canonical form of a content: sorted name and value pairs for a JSON object, the words in order for all else.

    Words can't hold the control characters that separate the parts. Null and empty contents have the same form, that of no word.
    """
    text = content or ""
    if text.lstrip().startswith("{"):
        try:
            obj = json.loads(text)
        except (ValueError, RecursionError):
            obj = None
        if isinstance(obj, dict):
            return "\2" + "\3".join(sorted({f"{' '.join(words(k))}\4{value_words(v)}" for k, v in obj.items()}))
    return "\1" + " ".join(words(text))


def tag_set(tags: str | None) -> str:
    return "\3".join(sorted({x for t in (tags or "").split(",") if (x := t.strip().lower())}))


def keyed(df: DataFrame, id_col: str, group_col: str, text_col: str, tags_col: str) -> DataFrame:
    """id and the canonical key of each row: 128 bits of hash and an independent 64-bit check."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column("id"), []
            for ns, text, tags in zip(*(b.column(k).to_pylist() for k in ("ns", "text", "tags"))):
                data = "\5".join(["" if ns is None else "\6" + ns, canonical(text), tag_set(tags)]).encode("utf-8", "surrogatepass")
                out.append((*halves(data), signed(xxhash.xxh64_intdigest(data, seed=len(data)))))
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols)], names=["id", "ka", "kb", "chk"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("ns"), F.col(text_col).alias("text"), F.col(tags_col).alias("tags"))
    return rows.filter("id is not null").mapInArrow(make, "id string, ka long, kb long, chk long")


def format_copies(df: DataFrame, id_col: str = "id", group_col: str = "namespace", text_col: str = "content", tags_col: str = "tags") -> tuple[DataFrame, DataFrame]:
    """The records that remain (keep_id, copies) and the membership (keep_id, copy_id) of the others.

    Characters, case, whitespace, punctuation and field order are made canonical, the result is hashed to 128 bits, and the
    counts are added up map-side first. Rows whose hashes agree while the independent checks differ would be a collision; the
    check is part of the key, so they stay apart. keep_id is the smallest id by plain comparison. Rows without an id are left
    out; a null group is a group; null tags are no tags; rows that repeat an id count as copies.
    """
    keys = keyed(df, id_col, group_col, text_col, tags_col).persist()
    kept = keys.groupBy("ka", "kb", "chk").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    several = kept.filter("copies > 1").select("ka", "kb", "chk", "keep_id")
    # The group of a third of all rows is one row of `several`; its members are split by adaptive skew handling.
    members = keys.join(several.hint("merge"), ["ka", "kb", "chk"]).filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
    return kept.select("keep_id", "copies"), members
