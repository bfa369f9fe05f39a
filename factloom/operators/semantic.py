"""Records that are alike by their vectors: a threshold self join, and duplicates of new rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions import text as T
from factloom.operators.records import live
from factloom.operators.search import dot

#: Random planes at most.
MOST_PLANES = 1024


def tuned(threshold: float, recall: float) -> tuple[int, int]:
    """Bands and planes of a band: the most planes with which two vectors at the threshold still agree in some band, with the given probability."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    best = (MOST_PLANES, 1)
    for r in range(1, 33):
        b = math.ceil(math.log(1 - recall) / math.log(1 - same**r)) if same < 1 else 1
        if b * r > MOST_PLANES:
            break
        best = (b, r)
    return best


def bands(vectors: DataFrame, threshold: float, recall: float, seed: int = 5) -> DataFrame:
    """Adds keys, one for each band: the sides of the band's random planes on which a vector lies. Null and empty vectors have none."""
    b, r = tuned(threshold, recall)
    kept = vectors.filter(F.col("v").isNotNull() & (F.size("v") > 0))
    schema = f"{kept._jdf.schema().toDDL()}, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = np.uint64(1) << np.arange(r, dtype=np.uint64)
        for batch in batches:
            out = [None] * len(batch)
            for i, v in enumerate(batch.column("v").to_pylist()):
                x = np.array(v, dtype=np.float64)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((b * r, len(x)))
                side = (planes[len(x)] @ x > 0).reshape(b, r).astype(np.uint64)
                out[i] = ((side * weight).sum(axis=1) * np.uint64(b) + np.arange(b, dtype=np.uint64)).astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return kept.mapInArrow(run, schema)


def cosine_pairs(vectors: DataFrame, threshold: float = fixed.CLUSTER_COSINE, group: str = "namespace", id_col: str = "id", vector_col: str = "embedding", recall: float = 0.99) -> DataFrame:
    """group, a, b, sim: pairs of unit vectors of one group whose cosine reaches the threshold, a before b, each once.

    Vectors meet where they lie on the same sides of a band of random planes, as many bands as find a pair at the threshold with
    the given probability and closer pairs more surely; pairs are then verified by their exact product. Equal vectors should be
    passed once. Null groups and vectors are left out.
    """
    rows = vectors.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(vector_col).alias("v")).filter("g is not null and i is not null")
    keyed = bands(rows, threshold, recall)
    each = keyed.select("g", "i", F.explode("keys").alias("key"))
    x, y = (each.select(F.col("g").alias(f"{s}g"), F.col("i").alias(f"{s}i"), F.col("key").alias(f"{s}k")) for s in "xy")
    met = x.join(y.hint("merge"), (F.col("xg") == F.col("yg")) & (F.col("xk") == F.col("yk")) & (F.col("xi") < F.col("yi"))).select("xi", "yi").distinct()
    a, b = (rows.select(F.col("i").alias(f"{s}i"), F.col("v").alias(f"{s}v"), F.col("g").alias(f"{s}g")) for s in "xy")
    both = met.join(a, "xi").join(b.drop("yg"), "yi").withColumn("sim", dot(F.col("xv"), F.col("yv")))
    return both.filter(F.col("sim") >= threshold).select(F.col("xg").alias(group), F.col("xi").alias("a"), F.col("yi").alias("b"), "sim")


def detect_duplicates(batch: DataFrame, memory: DataFrame, vectors: DataFrame | None = None, threshold: float = fixed.DEDUP_COSINE, recall: float = 0.99) -> DataFrame:
    """row_id, dup_of, sim and how of the rows of a batch that a live record of their namespace stands for.

    semantic: the nearest of the records whose vectors reach the threshold; where there is none, exact: the smallest id with the
    same normalized content, sim 1. batch: row_id, namespace, content and, for the semantic part, embedding; vectors: id, embedding.
    Ties go by id.
    """
    m = live(memory)
    norm = T.normalized(F.col("content"))
    have = m.groupBy("namespace", norm.alias("norm")).agg(F.min("id").alias("dup_of"))
    exact = batch.select("row_id", "namespace", norm.alias("norm")).join(have, ["namespace", "norm"]).select("row_id", "dup_of", F.lit(1.0).alias("sim"), F.lit("exact").alias("how"))
    if vectors is None:
        return exact
    old = m.select("id", "namespace").join(vectors, "id").select("id", F.col("namespace").alias("g"), F.col("embedding").alias("v"))
    new = batch.select(F.col("row_id"), F.col("namespace").alias("g"), F.col("embedding").alias("v")).filter("g is not null")
    # Equal vectors of a namespace are one target, its smallest id.
    one = old.filter("g is not null and v is not null").groupBy("g", F.xxhash64("v").alias("h")).agg(F.min("id").alias("id"))
    target = bands(old.join(one.select("id"), "id", "left_semi"), threshold, recall)
    x = bands(new, threshold, recall).select("row_id", "g", F.col("v").alias("xv"), F.explode("keys").alias("key"))
    y = target.select("id", "g", F.explode("keys").alias("key"))
    met = x.select("row_id", "g", "key").join(y.hint("merge"), ["g", "key"]).select("row_id", "id").distinct()
    sims = met.join(new.select("row_id", F.col("v").alias("xv")), "row_id").join(target.select("id", F.col("v").alias("yv")), "id").withColumn("sim", dot(F.col("xv"), F.col("yv"))).filter(F.col("sim") >= threshold)
    best = sims.groupBy("row_id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "id")).alias("b")).select("row_id", F.col("b.id").alias("dup_of"), (-F.col("b.s")).alias("sim"), F.lit("semantic").alias("how"))
    return best.unionAll(exact.join(best.select("row_id"), "row_id", "left_anti"))
