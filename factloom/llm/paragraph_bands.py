"""Paragraphs that are alike as a whole, by MinHash banding, and what could be removed of them.

1. Texts are cut into paragraphs (runs of characters without a line break), these into shingles of five words. Paragraphs with the
   same set of shingles fall into one class, so copies are compared once.
2. Every class sends one row a band. Bands are tuned: of those with a recall of at least `recall` at the threshold the one with the
   fewest false candidates.
3. Classes that meet in a band are compared by exact Jaccard similarity of their shingles. A bucket that holds more classes than
   HOT_BUCKET isn't paired out: its classes go to the exact set-similarity join of near_duplicates instead, which bounds before it compares.
4. Similar classes are joined to components. Of each the first paragraph stays, the others could be removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.near_duplicates import class_pairs, columns_of, groups_of, members_of
from factloom.llm.words import KEPT, WordHasher, exact, halves, packed, signed, words

PARAGRAPH = re.compile(r"[^\r\n]+")
SHINGLE = 5
#: Hash functions that the bands share out at most.
MOST_HASHES = 128
#: Classes of a bucket that are still paired out.
HOT_BUCKET = 256
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def tuned(threshold: float, recall: float = 0.99) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands that still find a pair at the threshold with the given probability."""
    best = (MOST_HASHES, 1)
    for r in range(1, 17):
        for b in range(1, MOST_HASHES // r + 1):
            if 1 - (1 - threshold**r) ** b >= recall:
                best = (b, r)
                break
    return best


def shingles(text: str, hasher: WordHasher) -> np.ndarray:
    """Hashes of the distinct runs of five words, sorted; a shorter paragraph with words is one shingle."""
    h = hasher(words(text))
    if not len(h):
        return h
    out = np.zeros(max(1, len(h) - SHINGLE + 1), dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ h[k : k + len(out)]) * M2
        out ^= out >> np.uint64(29)
    return np.unique(out * M1)


CLASSES = "doc_id {0}, no int, s int, e int, ca long, cb long, g long, n int, r int, b1 long, b2 long, toks binary, keys array<long>, fresh boolean"


def _classes(bands: int, rows: int, kind: str):  # noqa: ANN202
    at = np.array([0])
    odd = (M1 + np.arange(bands * rows, dtype=np.uint64) * np.uint64(2) * M3) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        names = [x.split()[0] for x in CLASSES.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for no, m in enumerate(PARAGRAPH.finditer(text)):
                    h = shingles(m.group(), hasher)
                    if not len(h):
                        continue
                    ca, cb = halves(h.tobytes())
                    if len(seen) > 500_000:
                        seen.clear()
                    fresh = (ca, cb) not in seen
                    seen.add((ca, cb))
                    row = (doc, no, m.start(), m.end(), ca, cb)
                    if not fresh:
                        out.append((*row, None, None, None, None, None, None, None, False))
                        continue
                    low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
                    for i in range(0, len(h), 4096):  # memory doesn't grow with a paragraph
                        low = np.minimum(low, ((h[i : i + 4096] * odd[:, None]) ^ odd[:, None] >> np.uint64(7)).min(axis=1))
                    keys = [signed(xxhash.xxh3_64_intdigest(low[k * rows : (k + 1) * rows].tobytes(), seed=k)) for k in range(bands)]
                    g = signed(int(groups_of(h[:4096], at)[0]))
                    out.append((*row, g, len(h), len(h), *(signed(int(x[0])) for x in columns_of(h, at)), packed(h, at, np.array([len(h)]))[0], keys, True))
            cols = list(zip(*out)) if out else [[]] * len(names)
            types = [batch.schema.field("doc_id").type, *[pa.int32()] * 3, *[pa.int64()] * 3, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def _alike(num: int, den: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("tx").to_pylist(), b.column("ty").to_pylist()):
                s, t = ({z[i : i + KEPT] for i in range(0, len(z), KEPT)} for z in (x, y))
                both = len(s & t)
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("xa", "xb", "ya", "yb")], names=["xa", "xb", "ya", "yb"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_paragraphs(classes: DataFrame, threshold: float, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs of classes (xa, xb), (ya, yb) with a Jaccard similarity of at least the threshold that share a band, each once."""
    num, den = exact(threshold)
    one = classes.groupBy("ca", "cb").agg(F.first(F.struct("g", "n", "r", "b1", "b2", "toks", "keys"), ignorenulls=True).alias("m")).select("ca", "cb", "m.*").persist()
    rows = one.select(F.explode("keys").alias("key"), "ca", "cb", "n")
    many = rows.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    met = rows.join(many.hint("merge"), "key").persist()  # a class that is alone in all its bands goes no further
    x, y = (met.filter(F.col("many") <= hot_bucket).select("key", F.col("ca").alias(f"{s}a"), F.col("cb").alias(f"{s}b"), F.col("n").alias(f"{s}n")) for s in "xy")
    order = (F.col("xa") < F.col("ya")) | ((F.col("xa") == F.col("ya")) & (F.col("xb") < F.col("yb")))
    sized = (den * F.col("xn") >= num * F.col("yn")) & (den * F.col("yn") >= num * F.col("xn"))
    pairs = x.join(y.hint("merge"), "key").filter(order & sized).select("xa", "xb", "ya", "yb").distinct()
    t = lambda s: one.select(F.col("ca").alias(f"{s}a"), F.col("cb").alias(f"{s}b"), F.col("toks").alias(f"t{s}"))
    ready = pairs.join(t("x").hint("merge"), ["xa", "xb"]).join(t("y").hint("merge"), ["ya", "yb"])
    found = ready.select("xa", "xb", "ya", "yb", "tx", "ty").mapInArrow(_alike(num, den), "xa long, xb long, ya long, yb long")
    hot = met.filter(F.col("many") > hot_bucket).select("ca", "cb").distinct().persist()
    if hot.isEmpty():
        return found
    crowd = one.join(hot.hint("merge"), ["ca", "cb"], "left_semi").withColumn("fresh", F.lit(True))
    return found.unionAll(class_pairs(members_of(crowd).persist(), threshold)).distinct()


def paragraph_clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.99, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row for each paragraph with words: its document, number and place, its cluster, the number of other texts it is similar to,
    the paragraphs of the cluster, and whether it could be removed because an earlier one stands for it.

    cluster_id is the first paragraph of the cluster, by document, then number. Pairs at the threshold are found with the
    given probability, more similar ones more surely; no pair below the threshold is. Null and empty texts have no paragraphs, rows
    without an id are left out, and rows that repeat a document count as further copies. A paragraph of fewer than five words
    is one shingle, so only its copies are similar to it.
    """
    bands, rows = tuned(threshold, recall)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    all_ = docs.mapInArrow(_classes(bands, rows, kind), CLASSES.format(kind)).persist()
    node = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    links = similar_paragraphs(all_.filter("fresh"), threshold, hot_bucket).select(node("xa", "xb").alias("x"), node("ya", "yb").alias("y")).persist()
    degree = links.select("x").unionAll(links.select("y")).groupBy("x").agg(F.count("*").alias("links")).withColumnRenamed("x", "node")
    labels = components(links, "x", "y").join(degree, "node").select("node", "label", "links")
    placed = all_.select("doc_id", "no", "s", "e", node("ca", "cb").alias("node")).join(labels.hint("merge"), "node", "left")
    placed = placed.select("doc_id", "no", "s", "e", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    first = placed.groupBy("label").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count("*").alias("paragraphs"))
    out = placed.join(first.hint("merge"), "label")
    cluster = F.concat_ws("/", F.col("first.doc_id").cast("string"), F.col("first.no").cast("string"))
    return out.select("doc_id", F.col("no").alias("paragraph_no"), F.col("s").alias("span_start"), F.col("e").alias("span_end"), cluster.alias("cluster_id"), "links", "paragraphs", (F.col("first") != F.struct("doc_id", "no")).alias("removed"))
