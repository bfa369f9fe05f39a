"""Words, hashes and fixed-size corpus statistics shared by the set-similarity operators.

A *word* is a maximal run of characters of the Unicode categories L and N, lower-cased after it was cut out. Null texts have
no words. Words are hashed with 64-bit XXH3, sequences and sets of words with the 128-bit one.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import checkpoint_dir

WORD = regex.compile(r"[\p{L}\p{N}]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")

#: Slots of the word-frequency sketch. Its size is fixed, whatever the corpus: 2**18 counts, 2 MB.
SKETCH_BITS = 18
#: A word that the sketch counts in more texts than this is common: records don't meet over one common word, only over two.
COMMON = 20_000


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for a null."""
    if not text:
        return []
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return [w.lower() for w in WORD.findall(text)]


class WordHasher:
    """Maps words to 64-bit hashes, remembering those seen; the memory is emptied when it holds `limit` words."""

    def __init__(self, limit: int = 400_000) -> None:
        self.limit, self.known = limit, {}

    def extend(self, out: list[int], found: Iterable[str]) -> None:
        """Adds the hashes of some words to a list."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)

    def __call__(self, found: Iterable[str]) -> np.ndarray:
        out: list[int] = []
        self.extend(out, found)
        return np.array(out, dtype=np.uint64)


class WordSets:
    """The sets of words of some texts, those without words left out, one behind the other in flat arrays.

    rows and seqs are the numbers and the word sequences of the texts; n and start the sizes and places of their sets, plain the
    hashes of the words, h the same within the text's namespace, owner the number of the set of each word.
    """

    def __init__(self, namespaces: list[str | None], texts: list[str | None], hasher: WordHasher) -> None:
        self.rows, self.seqs, flat, sizes, scopes = [], [], [], [], []
        known: dict[str | None, int] = {}
        for i, (ns, text) in enumerate(zip(namespaces, texts)):
            found = words(text)
            if not found:
                continue
            if (scope := known.get(ns)) is None:
                scope = known[ns] = scope_of(ns)
            before = len(flat)
            hasher.extend(flat, set(found))
            self.rows.append(i)
            self.seqs.append(found)
            sizes.append(len(flat) - before)
            scopes.append(scope)
        self.plain, self.n = np.array(flat, dtype=np.uint64), np.array(sizes, dtype=np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.owner = np.repeat(np.arange(len(sizes)), self.n)
        self.h = scoped(self.plain, np.array(scopes, dtype=np.uint64)[self.owner]) if sizes else self.plain

    def classes(self) -> list[tuple[int, int]]:
        """The 128-bit hash of each set."""
        data, of = self.h[np.lexsort((self.h, self.owner))].tobytes(), 8 * self.start
        return [halves(data[a : a + 8 * n]) for a, n in zip(of.tolist(), self.n.tolist())]

    def by_rarity(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of each set with the rarest words first, and the counts of these."""
        d = counts[slots(self.plain)]
        order = np.lexsort((self.h, d, self.owner))
        return self.h[order], d[order]


def scope_of(namespace: object) -> int:
    return xxhash.xxh3_64_intdigest(b"\0" if namespace is None else b"\1" + str(namespace).encode("utf-8", "surrogatepass"))


def scoped(hashes: np.ndarray, scope: np.ndarray) -> np.ndarray:
    """Word hashes that differ between namespaces."""
    h = (hashes ^ scope) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Bytes that are kept of a word's hash when sets are compared.
KEPT = 5


def packed(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The kept bytes of the hashes of each set."""
    data = h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()
    return [data[a : a + k] for a, k in zip((KEPT * start).tolist(), (KEPT * n).tolist())]


def mark(spark: SparkSession) -> int:
    """A number that lies between those of the shuffles made before and after."""
    return spark.sparkContext._jsc.sc().newShuffleId()


def release(spark: SparkSession, since: int) -> None:
    """Deletes the files of all shuffles made after mark() gave `since`: what was read from them is stored elsewhere by then.

    Waiting for garbage to be collected isn't enough: Python lets go of frames on the JVM in a thread of its own, behind the call
    that collects. The shuffles stay known, without outputs, so Spark makes them again where a stored block is lost or another
    thread of the session still reads them.
    """
    sc, env = spark.sparkContext, spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    for i in range(since + 1, mark(spark)):
        if env.mapOutputTracker().containsShuffle(i):
            env.mapOutputTracker().unregisterAllMapAndMergeOutput(i)
            if sc._jsc.sc().isLocal():
                env.shuffleManager().unregisterShuffle(i)
            else:
                env.blockManager().master().removeShuffle(i, True)
    gc.collect()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder; they are kept while that is done, because writing takes a second pass."""
    checkpoint_dir(df.sparkSession)
    since, held = mark(df.sparkSession), df.persist()
    out = held.checkpoint()
    held.unpersist()
    release(df.sparkSession, since)
    return out


def signed(x: int) -> int:
    """A 64-bit unsigned number as the signed one of the same bits."""
    return x - (1 << 64) if x >= 1 << 63 else x


def halves(data: bytes) -> tuple[int, int]:
    """The 128-bit hash of some bytes as two signed 64-bit numbers."""
    d = xxhash.xxh3_128_intdigest(data)
    return signed(d >> 64), signed(d & 0xFFFFFFFFFFFFFFFF)


def exact(threshold: float) -> tuple[int, int]:
    """A threshold such as 0.7 as numerator and denominator, so that it can be tested in whole numbers."""
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def slots(hashes: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def sketch(rows: DataFrame, of: Callable[[], Callable[[pd.DataFrame], list[np.ndarray]]], size: int) -> np.ndarray:
    """Adds up, over all rows, how often each slot in 0..size-1 occurs (a one-row count-min sketch).

    `of()` makes, once a task, the function that turns a batch of rows into arrays of slots. Each task adds up its own rows
    and emits one packed array in 16 pieces; the pieces are summed in two levels. What reaches the driver is one array of
    `size` counts however large the corpus is. The counts never fall short of the true ones, and the callers use them only to
    order words and to size buckets, so collisions cost speed and never change a result.
    """
    piece = -(-size // 16)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn, total = of(), np.zeros(piece * 16, dtype=np.int64)
        for pdf in batches:
            if found := [x for x in fn(pdf) if len(x)]:
                total += np.bincount(np.concatenate(found), minlength=piece * 16)
        if total.any():
            yield pd.DataFrame({"piece": range(16), "counts": [total[i : i + piece].astype(np.int64).tobytes() for i in range(0, piece * 16, piece)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(piece, dtype=np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(b, dtype=np.int64)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "counts": [total.tobytes()]})

    schema = "piece int, counts binary"
    partial = rows.mapInPandas(count, schema).withColumn("part", F.spark_partition_id() % 64)
    some = partial.groupBy("piece", "part").applyInPandas(lambda pdf: add(pdf), schema)
    out = np.zeros(piece * 16, dtype=np.int64)
    for r in some.groupBy("piece").applyInPandas(add, schema).collect():
        out[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["counts"], dtype=np.int64)
    return out[:size]


def membership(rows: DataFrame, column: str, bits: int = 23) -> np.ndarray:
    """A bit map of fixed size, 1 MB, in which the slot of every value of a 64-bit column is set.

    It keeps rows that can't matter out of a shuffle. A value that was seen is always in it; one that wasn't is with a chance that
    grows with the data, up to a map that holds back nothing, so it never changes a result.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            seen[slots(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits)] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["m"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for m in pdf["m"]:
            out |= np.frombuffer(m, dtype=np.uint8)
        return pd.DataFrame({"m": [out.tobytes()]})

    parts = rows.select(F.col(column).cast("long")).mapInArrow(mark, "m binary").withColumn("part", F.spark_partition_id() % 16)
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in parts.groupBy("part").applyInPandas(lambda pdf: join(pdf), "m binary").collect():
        out |= np.frombuffer(r["m"], dtype=np.uint8)
    return out


def kept_by(rows: DataFrame, column: str, seen: np.ndarray, bits: int = 23) -> DataFrame:
    """The rows whose value of the column may be in the map."""
    shared = rows.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            at = slots(b.column(column).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits)
            yield b.filter(pa.array(flags[at]))

    return rows.mapInArrow(run, rows.schema)
