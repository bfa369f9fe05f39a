"""New batches checked against all that was accepted before, by bit-difference fingerprints in rotated block tables.

Every record has a 112-bit fingerprint in which each of its distinct words flips one bit, so two fingerprints differ in at most as
many bits as their records differ in words: a pair whose bits differ more than the threshold allows can't be similar. Records are
found by *blocks*: the words of a record from the rarest on, rotated so that each of the first ones leads one row of the block
table, as many as must hold one word of every similar record (common words lead in twos). `FingerprintStore` keeps both tables in
a folder, the blocks by ranges of their key and the fingerprints by ranges of their class. A batch reads the ranges of its own
blocks, matches are held against the bit-difference bound, then their words are read and compared, and what is accepted is
appended. The history is fingerprinted once, when the store is made.

Blocks are words and not ranges of bits because records at the threshold of 0.7 may differ in 35 % of their words; blocks of bits
that are small enough to survive that match nearly everything (figures in the README). Sets are compared by the first 40 bits of
their words' hashes, taken within the namespace: two words of a pair of records of 50 words agree by chance once in 10**9 pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.words import COMMON, KEPT, SKETCH_BITS, WordHasher, WordSets, cut, exact, kept_by, mark, membership, packed, release, sketch, slots
from factloom.session import checkpoint_dir

FINGERPRINT = "ca long, cb long, n int, r int, f1 long, f2 long, toks binary, fresh boolean"
#: The stored table of them.
PRINTS = "ca long, cb long, n int, r int, f1 long, f2 long, toks binary, batch int, part int"
#: The largest set size that the lower 16 bits of f2 tell exactly.
MOST = 0xFFFF


def bits_of(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash flips one of 112 bits: 64 in the first half, 48 in the upper part of the second, whose lower part is the size."""
    at = (h >> np.uint64(20)) % np.uint64(112)
    bit = np.uint64(1) << np.where(at < 64, at, at - np.uint64(48))
    f1, f2 = (np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), start) for half in (at < 64, at >= 64))
    return f1, f2 | np.minimum(n, MOST).astype(np.uint64)


def word_order(rows: DataFrame) -> np.ndarray:
    """The counts by which words are ordered, rarest first."""

    def of():  # noqa: ANN202
        hasher = WordHasher()
        return lambda pdf: [slots(WordSets([None] * len(pdf), pdf["text"].tolist(), hasher).plain)]

    return sketch(rows.select("text"), of, 1 << SKETCH_BITS)


def fingerprints(rows: DataFrame, counts: np.ndarray, common: int = COMMON) -> DataFrame:
    """Adds to rows with ns and text, which they lose, the class of the word set, its size, fingerprint and words, rarest first.

    Rows without words have null in all of these. `fresh` marks the first row of a class in its task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max(initial=0) < 2**31 else counts)
    kept = [c for c in rows.columns if c not in ("ns", "text")]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), FINGERPRINT])
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in FINGERPRINT.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, hasher, seen = shared.value, WordHasher(), set()
        for b in batches:
            sets, made = WordSets(b.column("ns").to_pylist(), b.column("text").to_pylist(), hasher), [[]] * len(names)
            if sets.rows:
                h, d = sets.by_rarity(df)
                if len(seen) > 300_000:
                    seen.clear()
                classes, fresh = sets.classes(), []
                for c in classes:
                    fresh.append(c not in seen)
                    seen.add(c)
                rare = np.add.reduceat((d <= common).astype(np.int32), sets.start)
                f1, f2 = (x.view(np.int64) for x in bits_of(h, sets.start, sets.n))
                made = [*zip(*classes), sets.n, rare, f1, f2, packed(h, sets.start, sets.n), fresh]
            at = np.full(len(b), -1)
            at[sets.rows] = np.arange(len(sets.rows))
            at = pa.array(at, mask=at < 0)  # rows without words have null
            cols = [pa.array(list(c) if isinstance(c, tuple) else c, t).take(at) for c, t in zip(made, types)]
            cols[-1] = pc.fill_null(cols[-1], False)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], names=[*kept, *names])

    return rows.mapInArrow(make, schema)


def blocks(prints: DataFrame, num: int, den: int) -> DataFrame:
    """The block table: a row for each leading word of each class, or for two where words are common.

    The rarest word that two similar records share is among the leading words of both. If it isn't common it is a block by
    itself. If it is, all shared words are, and the second rarest is among the leading words and the one behind them: the two
    together are a block. Records so small that one shared word can do have common words as blocks too.
    """
    word = f"substring(toks, {{}} * {KEPT} + 1, {KEPT})".format
    least = f"cast(ceil({num} * n / {den}) as int)"
    lead, end = f"(n - {least} + 1)", f"least(n, n - {least} + 2)"
    alone = f"transform(filter(sequence(0, {lead} - 1), i -> i < r or {least} < 2), i -> xxhash64({word('i')}))"
    pairs = f"flatten(transform(sequence(r, {end} - 1), i -> transform(filter(sequence(r, {end} - 1), j -> j > i), j -> xxhash64({word('i')}, {word('j')}))))"
    return prints.filter("fresh").select(F.explode(F.expr(f"if(r < {lead}, concat({alone}, {pairs}), {alone})")).alias("key"), "ca", "f1", "f2")


def _verify(num: int, den: int):  # noqa: ANN202
    """Keeps the pairs whose words reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("tx").to_pylist(), b.column("ty").to_pylist()):
                s = {x[i : i + KEPT] for i in range(0, len(x), KEPT)}
                both = sum(y[i : i + KEPT] in s for i in range(0, len(y), KEPT))
                keep.append(den * both >= num * ((len(x) + len(y)) // KEPT - both))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("xa", "xb", "ya", "yb")], names=["xa", "xb", "ya", "yb"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_classes(new: DataFrame, num: int, den: int, old_blocks: DataFrame, old_words: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs of a class of `new` (xa, xb) and a stored one (ya, yb) that are similar, by block, bit difference and words.

    old_words gives, for a frame of the classes that were met (ya), their words as (ya, yb, ty).
    """
    # The table carries half of a class's hash; classes that share it are told apart when their words are compared.
    x = blocks(new, num, den).select(F.col("key"), F.col("ca").alias("xa"), F.col("f1").alias("x1"), F.col("f2").alias("x2"))
    y = old_blocks.select(F.col("key").alias("k"), F.col("ca").alias("ya"), F.col("f1").alias("y1"), F.col("f2").alias("y2"))
    xn, yn = F.col("x2").bitwiseAND(F.lit(MOST)), F.col("y2").bitwiseAND(F.lit(MOST))
    bits = F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))) + F.bit_count(F.shiftrightunsigned(F.col("x2").bitwiseXOR(F.col("y2")), 16))
    near = (den * xn >= num * yn) & (den * yn >= num * xn) & (bits * (num + den) <= (den - num) * (xn + yn))
    huge = (xn == MOST) | (yn == MOST)
    met = x.join(y.hint("merge"), (F.col("key") == F.col("k")) & (near | huge) & (F.col("xa") != F.col("ya"))).select("xa", "ya").distinct().persist()
    tx = new.filter("fresh").select(F.col("ca").alias("xa"), F.col("cb").alias("xb"), F.col("toks").alias("tx"))
    ready = met.join(tx, "xa").join(old_words(met).hint("merge"), "ya")
    out = cut(ready.select("xa", "xb", "ya", "yb", "tx", "ty").mapInArrow(_verify(num, den), "xa long, xb long, ya long, yb long").distinct())
    met.unpersist()
    return out


def origin(ref: str, ts: str) -> F.Column:
    """Source and time of a row together; null when either is missing or the source is blank."""
    return F.when(F.col(ref).rlike(r"(?U)[^\s\x1c-\x1f]") & F.col(ts).isNotNull(), F.struct(F.col(ref).alias("r"), F.col(ts).alias("t")))


def decide(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """row_id of the rows that an earlier accepted row makes a case. rows: row_id, ord, ca, cb, ref; edges: both ways.

    A row that is the first of all undecided rows it could depend on is accepted, and the rows that depend on it are cases;
    both leave, until none is undecided. The rounds follow the longest chain of rows that depend on each other, not the rows.
    """
    links = edges.select("xa", "xb", "ya", "yb").persist()
    open_, cases, no = rows, None, 0
    while True:
        mine = open_.groupBy("ca", "cb").agg(F.min("ord").alias("lead"))
        around = links.join(mine, (F.col("ya") == F.col("ca")) & (F.col("yb") == F.col("cb"))).select(F.col("xa").alias("ca"), F.col("xb").alias("cb"), "lead")
        lead = mine.unionAll(around).groupBy("ca", "cb").agg(F.min("lead").alias("lead"))
        by_ref = open_.filter("ref is not null").groupBy("ref").agg(F.min("ord").alias("ref_lead"))
        first = (F.coalesce(F.col("ord") == F.col("lead"), F.lit(True))) & (F.coalesce(F.col("ord") == F.col("ref_lead"), F.lit(True)))
        marked = cut(open_.join(lead, ["ca", "cb"], "left").join(by_ref, "ref", "left").select("row_id", "ord", "ca", "cb", "ref", first.alias("ok")))
        done = marked.filter("ok")
        # An accepted row was the first around it, so all that is undecided there comes later.
        hit = done.filter("ca is not null").select("ca", "cb").distinct()
        reached = links.join(hit, (F.col("ya") == F.col("ca")) & (F.col("yb") == F.col("cb"))).select(F.col("xa").alias("ca"), F.col("xb").alias("cb")).unionAll(hit).distinct().withColumn("c", F.lit(True))
        refs = done.filter("ref is not null").select("ref").distinct().withColumn("s", F.lit(True))
        rest = cut(marked.filter("not ok").join(reached, ["ca", "cb"], "left").join(refs, "ref", "left").select("row_id", "ord", "ca", "cb", "ref", (F.col("c").isNotNull() | F.col("s").isNotNull()).alias("case")))
        found = rest.filter("case").select("row_id")
        cases = found if cases is None else cases.unionAll(found)
        open_, no = rest.filter("not case").drop("case"), no + 1
        if open_.isEmpty():
            links.unpersist()
            return cases


def batch_rows(batch: DataFrame) -> DataFrame:
    order = F.struct("batch_no", "line_no", "row_id")
    return batch.filter(F.col("row_id").isNotNull()).select("row_id", order.alias("ord"), origin("source_ref", "ingestion_ts").alias("ref"), F.col("namespace").alias("ns"), F.col("content").alias("text"))


def history_rows(memory: DataFrame) -> DataFrame:
    return memory.select(origin("source_ref", "ingestion_ts").alias("ref"), F.col("namespace").alias("ns"), F.col("content").alias("text"))


#: Rows of a block table that one range of keys holds, and the most ranges there are.
RANGE_ROWS, MOST_BITS = 1 << 20, 12
#: Tasks that write one range.
SPREAD = 64


def ranged(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Adds `part`, the range of the column's values a row lies in: its upper bits."""
    return rows.withColumn("part", F.shiftrightunsigned(F.col(column), 64 - bits).cast("int") if bits else F.lit(0))


class FingerprintStore:
    """Fingerprints and rotated block tables kept in a folder: made once from the history, then looked up and appended to.

    prints (class, fingerprint, words) lie by ranges of the class, blocks by ranges of their key, so many that a range has about
    RANGE_ROWS rows when the store is made; refs are the sources with their times. A batch reads only the ranges that its blocks,
    and then the classes they meet, fall into: for a small batch some files, whatever the length of the history. Each check writes
    files of its own under its number, so a check that is run again replaces what it wrote and a lost executor costs a repeated task.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.7, common: int = COMMON) -> None:
        self.spark, self.path, self.common = spark, path.rstrip("/"), common
        self.num, self.den = exact(threshold)

    def create(self, memory: DataFrame) -> None:
        """Fixes the order of words, which every later batch shares, and stores the history: one pass for the order, one for the prints."""
        rows, since = history_rows(memory), mark(self.spark)
        counts = word_order(rows)
        prints = fingerprints(rows, counts, self.common).persist()
        size = prints.filter("fresh").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.col("n") / 3, F.lit(1.0))), F.lit(0.0)).alias("blocks")).first()
        bits = [min(MOST_BITS, max(0, (int(n) // RANGE_ROWS).bit_length())) for n in (size["n"], size["blocks"])]
        order = pd.DataFrame({"counts": [counts.astype(np.int64).tobytes()], "print_bits": [bits[0]], "block_bits": [bits[1]]})
        self.spark.createDataFrame(order).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/order")
        self._append(prints, prints, 0, *bits)
        release(self.spark, since)

    def _append(self, prints: DataFrame, held: DataFrame, number: int, print_bits: int, block_bits: int) -> None:
        """Writes each table by its ranges, a range by several tasks, and lets go of the shuffle files of one before the next.

        `held`, which is what prints are read from, is let go as soon as they are stored; the blocks are made from the stored ones.
        """
        def put(name: str, rows: DataFrame, column: str, bits: int) -> None:
            spread = ranged(rows, column, bits).repartition("part", F.pmod(F.xxhash64(column), F.lit(SPREAD))).sortWithinPartitions("part", column)
            since = mark(self.spark)
            spread.write.option("parquet.enable.dictionary", "false").mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}/batch={number}")
            release(self.spark, since)

        since = mark(self.spark)
        prints.filter("ref is not null").select("ref").distinct().write.mode("overwrite").parquet(f"{self.path}/refs/batch={number}")
        put("prints", prints.filter("fresh").select("ca", "cb", "n", "r", "f1", "f2", "toks"), "ca", print_bits)
        held.unpersist(blocking=True)
        release(self.spark, since)
        stored = self._table("prints", PRINTS).filter(F.col("batch") == number)
        put("blocks", blocks(stored.withColumn("fresh", F.lit(True)), self.num, self.den), "key", block_bits)

    def _table(self, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return found if parts is None else found.filter(F.col("part").isin(parts))

    def _parts(self, rows: DataFrame, column: str, bits: int) -> list[int]:
        """The ranges that a column's values fall into, at most 2**MOST_BITS numbers."""
        return [r["part"] for r in ranged(rows.select(column), column, bits).select("part").distinct().collect()]

    def check(self, batch: DataFrame, number: int = 1) -> DataFrame:
        """row_id of the cases among some rows, taken by (batch_no, line_no, row_id); all other rows are appended under `number`, from 1.

        A row is a case when it is similar to one accepted before, in the store or in these rows, or has its source and time.
        """
        checkpoint_dir(self.spark)
        order = self.spark.read.parquet(f"{self.path}/order").first()
        bits = order["print_bits"], order["block_bits"]
        rows = fingerprints(batch_rows(batch), np.frombuffer(order["counts"], dtype=np.int64), self.common).persist()
        # The shuffle files of a step go with it.
        since = mark(self.spark)
        marked = self._against_history(rows, number, *bits)
        release(self.spark, since)
        cases = self._among_themselves(rows, marked)
        release(self.spark, since)
        # Of the rows that are no cases one of each class is stored: a second one would be a case.
        self._append(rows.join(cases.hint("merge"), "row_id", "left_anti").withColumn("fresh", F.col("n").isNotNull()), rows, number, *bits)
        return cases

    def _against_history(self, rows: DataFrame, number: int, print_bits: int, block_bits: int) -> DataFrame:
        """row_id, ord, class, ref and whether what is stored makes the row a case."""
        new = rows.filter("n is not null")
        mine, classes = blocks(new, self.num, self.den).select("key").persist(), new.select("ca", "cb").distinct().persist()
        stored = "key long, ca long, f1 long, f2 long, batch int, part int"
        old = self._table("blocks", stored, self._parts(mine, "key", block_bits)).filter(F.col("batch") < number)
        near = kept_by(old.select("key", "ca", "f1", "f2"), "key", membership(mine, "key"))

        def stored_words(met: DataFrame) -> DataFrame:
            prints = self._table("prints", PRINTS, self._parts(met.select(F.col("ya").alias("ca")), "ca", print_bits)).filter(F.col("batch") < number)
            return kept_by(prints.select("ca", "cb", "toks"), "ca", membership(met, "ya")).select(F.col("ca").alias("ya"), F.col("cb").alias("yb"), F.col("toks").alias("ty")).distinct()

        against = similar_classes(new, self.num, self.den, near, stored_words).select(F.col("xa").alias("ca"), F.col("xb").alias("cb"))
        same = self._table("prints", PRINTS, self._parts(classes, "ca", print_bits)).filter(F.col("batch") < number).select("ca", "cb")
        known = against.unionAll(classes.join(kept_by(same, "ca", membership(classes, "ca")).hint("merge"), ["ca", "cb"], "left_semi")).distinct().withColumn("k", F.lit(True))
        refs = self._table("refs", "ref struct<r:string,t:timestamp>, batch int").filter(F.col("batch") < number)
        wanted = rows.filter("ref is not null").select(F.xxhash64("ref").alias("h"), "ref")
        had = kept_by(refs.select(F.xxhash64("ref").alias("h"), "ref"), "h", membership(wanted, "h")).select("ref").distinct().withColumn("s", F.lit(True))
        marked = rows.select("row_id", "ord", "ca", "cb", "ref").join(known, ["ca", "cb"], "left").join(had.hint("merge"), "ref", "left")
        out = cut(marked.select("row_id", "ord", "ca", "cb", "ref", (F.col("k").isNotNull() | F.col("s").isNotNull()).alias("case")))
        mine.unpersist()
        classes.unpersist()
        return out

    def _among_themselves(self, rows: DataFrame, marked: DataFrame) -> DataFrame:
        """row_id of all cases. Rows meet over their own blocks; cases of the history can't make others cases."""
        open_ = marked.filter("not case").drop("case")
        new = rows.filter("fresh").join(open_.select("ca", "cb").distinct(), ["ca", "cb"], "left_semi")
        own = lambda met: new.select(F.col("ca").alias("ya"), F.col("cb").alias("yb"), F.col("toks").alias("ty"))  # noqa: E731, ARG005
        edges = similar_classes(new, self.num, self.den, blocks(new, self.num, self.den), own)
        return cut(marked.filter("case").select("row_id").unionAll(decide(open_, edges)))

    def drop(self) -> None:
        """Deletes the folder."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_cases(memory: DataFrame, batch: DataFrame, threshold: float = 0.7, common: int = COMMON, last_apart: bool = False) -> DataFrame:
    """row_id of the rows of batch that are there already, in memory or among the rows accepted before them.

    A FingerprintStore is made from memory in the folder spark.checkpoint.dir names and the waiting rows are checked against it, all in
    one call, or with last_apart the last batch in a call of its own, of which alone the cases come out. Rows are taken by
    (batch_no, line_no, row_id), nulls first. A row without words (null, empty or punctuation only) is similar to nothing and is
    judged by source and time alone. A null namespace is a namespace. Rows without a row_id are left out.
    """
    spark = batch.sparkSession
    checkpoint_dir(spark)
    store = FingerprintStore(spark, f"{spark.sparkContext.getCheckpointDir()}/fingerprints-{uuid.uuid4().hex}", threshold, common)
    store.create(memory)
    if last_apart:
        last = batch.agg(F.max("batch_no")).first()[0]
        is_last = F.col("batch_no").eqNullSafe(F.lit(last))
        store.check(batch.filter(~is_last), 1)
        cases = store.check(batch.filter(is_last), 2)
    else:
        cases = store.check(batch)
    store.drop()
    return cases
