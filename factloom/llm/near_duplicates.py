"""Near-duplicate records with small edits, by a token-group matrix.

Two records of one group are *similar* when the number of distinct words in both, divided by the number in either, reaches the
threshold.

1. Records with the same set of words fall into one class, so copies are compared once.
2. Classes are partitioned into groups of similar sets: six min-hashes agree, and a group that the count sketch shows to be large
   is split by a hash of the class. Of each group the matrix keeps its token union, hashed to 128 columns, with the smallest and
   largest set size. A group of one has its set as its union.
3. A set, as a query, meets a group only through a word: each sends its rarest words (a prefix that must hold one word of every
   similar set), common ones in pairs so that no key gathers a large part of a namespace. Where they meet, the columns bound how
   many of the query's words any set of the group can have, and only groups whose bound reaches the threshold are opened.
4. In the opened groups, and inside each group, the sets themselves are compared.

No step compares all pairs of a namespace, and what is broadcast is a sketch of fixed size. A namespace with a third of all
rows is spread by word, a group of copies by its map-side reduction to one row a task. Every bound is exact; sets are compared
by the first 40 bits of their words' hashes, taken within the namespace: two words of a pair of records of 50 words agree by
chance once in 10**9 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.words import COMMON, KEPT, SKETCH_BITS, WordHasher, WordSets, cut, exact, halves, kept_by, mark, membership, packed, release, sketch, slots
from factloom.session import checkpoint_dir

#: From so many sets on a group's union stands for several sets.
UNION_OF = 2
#: A group is split when the sketch counts more rows in it than this.
GROUP_ROWS = 48
#: Min-hashes that must agree for two sets to share a group. With fewer the unions grow so wide that the bound opens nearly every
#: group that is met (figures in the README).
ODD = np.array([0x9E3779B97F4A7C15 + 2 * k * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF for k in range(6)], dtype=np.uint64)


def groups_of(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The group of each set of some flat arrays: its min-hashes, hashed together."""
    low = np.minimum.reduceat(h * ODD[:, None], start, axis=1).T.tobytes()
    size = 8 * len(ODD)
    return np.array([xxhash.xxh3_64_intdigest(low[i : i + size]) for i in range(0, len(low), size)], dtype=np.uint64)


def group_slots(g: np.ndarray) -> np.ndarray:
    """The slots of the sketch that count groups; the words' slots come first."""
    return (1 << SKETCH_BITS) + slots(g)


def columns_of(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 columns of the matrix that each set fills, in two halves."""
    bit, upper = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(1) == 1
    return tuple(np.bitwise_or.reduceat(np.where(upper == half, bit, np.uint64(0)), start) for half in (False, True))


def _statistics(rows: DataFrame) -> np.ndarray:
    def of():  # noqa: ANN202
        hasher = WordHasher()

        def fn(pdf: pd.DataFrame) -> list[np.ndarray]:
            sets = WordSets(pdf["ns"].tolist(), pdf["text"].tolist(), hasher)
            return [slots(sets.plain), group_slots(groups_of(sets.h, sets.start))] if sets.rows else []

        return fn

    return sketch(rows, of, 2 << SKETCH_BITS)


FEATURES = "id string, g long, ca long, cb long, sa long, sb long, n int, r int, b1 long, b2 long, toks binary, fresh boolean"


def features(rows: DataFrame, counts: np.ndarray, common: int) -> DataFrame:
    """One row per record that has words: its class (ca, cb), its sequence (sa, sb), its group g, and its set, rarest word first, of
    which the first r are not common. Only rows that are the first of their class in a task, `fresh`, have the words themselves."""
    shared = rows.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max(initial=0) < 2**31 else counts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, hasher, seen = shared.value, WordHasher(), set()
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            sets = WordSets(batch.column("ns").to_pylist(), batch.column("text").to_pylist(), hasher)
            if not sets.rows:
                continue
            h, d = sets.by_rarity(df)
            g, classes, fresh = groups_of(h, sets.start), sets.classes(), []
            many = df[group_slots(g)]
            for i in np.flatnonzero(many > GROUP_ROWS):
                g[i] = xxhash.xxh3_64_intdigest(f"{g[i]} {classes[i][1] % (int(many[i]) // (GROUP_ROWS // 2))}".encode())
            if len(seen) > 300_000:
                seen.clear()
            for c in classes:
                fresh.append(c not in seen)
                seen.add(c)
            ca, cb = zip(*classes)
            sa, sb = zip(*(halves(" ".join(x).encode("utf-8", "surrogatepass")) for x in sets.seqs))
            rare = np.add.reduceat((d <= common).astype(np.int32), sets.start)
            b1, b2 = (x.view(np.int64) for x in columns_of(h, sets.start))
            cols = [batch.column("id").take(pa.array(sets.rows)), g.view(np.int64), ca, cb, sa, sb, sets.n.astype(np.int32), rare.astype(np.int32), b1, b2, [t if f else None for t, f in zip(packed(h, sets.start, sets.n), fresh)], fresh]
            types = [pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return rows.mapInArrow(make, FEATURES)


class _Sets:
    """The members of a batch of groups as flat arrays: bounds of the groups, then of each set its columns, size and place among
    the words."""

    def __init__(self, lists: pa.ListArray) -> None:
        self.bounds = lists.offsets.to_numpy()
        first, last = int(self.bounds[0]), int(self.bounds[-1])
        self.bounds = self.bounds - first
        members = lists.values.slice(first, last - first).flatten()
        cols = dict(zip((f.name for f in lists.type.value_type), members))
        self.ca, self.cb, self.b1, self.b2 = (cols[c].to_numpy(zero_copy_only=False) for c in ("ca", "cb", "b1", "b2"))
        packed_ = b"".join(cols["toks"].to_pylist())
        weights = np.uint64(1) << (np.uint64(8) * np.arange(KEPT - 1, -1, -1, dtype=np.uint64))
        self.words = (np.frombuffer(packed_, dtype=np.uint8).reshape(-1, KEPT) * weights).sum(axis=1, dtype=np.uint64)
        self.n, self.r = (cols[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "r"))
        self.start = np.cumsum(self.n) - self.n
        self.group = np.repeat(np.arange(len(lists)), np.diff(self.bounds))


    def keys(self, at: np.ndarray, lead: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The set of each key, the keys over which the sets `at` meet others, when a prefix of `lead` words must hold one, and
        the place of each: shorter prefixes have the keys whose place is less than their length.

        The rarest word that two similar sets share lies in both prefixes. If it isn't common it is a key by itself. If it is,
        all shared words are, and the second rarest lies in both prefixes longer by one: the two together are a key. Sets so
        small that one shared word can do send common words by themselves as well.
        """
        n, r, start = self.n[at], self.r[at], self.start[at]
        alone = np.where(-(-num * n // den) < 2, lead, np.minimum(r, lead))
        owner, key, place = [np.repeat(at, alone)], [self.words[_ranges(start, alone)] * M1], [_ranges(np.zeros_like(alone), alone)]
        many = np.where(r < lead, np.minimum(n, lead + 1) - r, 0)
        for f in np.unique(many[many > 1]):
            of = np.flatnonzero(many == f)
            i, j = np.triu_indices(f, 1)
            first = (start[of] + r[of])[:, None]
            both = self.words[first + i] * M2 + self.words[first + j]
            key.append(((both ^ (both >> np.uint64(31))) * M1).ravel())
            owner.append(np.repeat(at[of], len(i)))
            place.append((r[of][:, None] + j - 1).ravel())
        return np.concatenate(owner), np.concatenate(key), np.concatenate(place)


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., one behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


#: What a row of the matrix is, in the lower bits of its size: a set of a group of several, the union of such a group, or a group of
#: one; whether it is a query, and whether a target.
MEMBER, UNION, ALONE, TARGET, QUERY = 1, 2, 3, 4, 8


def _matrix(num: int, den: int):  # noqa: ANN202
    """The rows by which sets and groups meet: key, group, columns, and size, which holds the smallest and the largest set and
    what the row is.

    Every set is a query and sends the keys of its prefix. A group of several sets is one target that sends its token union and the
    keys of all its sets; a group of one is a target for queries of its size or more, with the shorter prefix that this allows. The
    keys of that are among those it sends as a query, so that they travel once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            g, sets = batch.column("g").to_numpy(zero_copy_only=False), _Sets(batch.column("members"))
            many = np.diff(sets.bounds)[sets.group] >= UNION_OF
            full = sets.n - -(-num * sets.n // den) + 1
            short = sets.n - -(-2 * num * sets.n // (num + den)) + 1
            owner, key, place = sets.keys(np.arange(len(sets.n)), full, num, den)
            size = (sets.n << 34) + (sets.n << 4) + np.where(many, MEMBER, ALONE) + QUERY
            cols = [[key], *([c[owner]] for c in (g[sets.group], sets.b1, sets.b2)), [size[owner] + np.where(~many[owner] & (place < short[owner]), TARGET, 0)]]
            for k in np.unique(sets.group[many]):
                own = np.arange(sets.bounds[k], sets.bounds[k + 1])
                keys, n = np.unique(sets.keys(own, full[own], num, den)[1]), sets.n[own]
                union = np.bitwise_or.reduce(sets.b1[own]), np.bitwise_or.reduce(sets.b2[own])
                for c, v in zip(cols, (keys, *(np.full(len(keys), x) for x in (g[k], *union, (n.min() << 34) + (n.max() << 4) + UNION + TARGET)))):
                    c.append(v)
            out = [np.concatenate(c) for c in cols]
            out[0] = out[0].view(np.int64)
            for i in range(0, len(out[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in out], names=["key", "g", "b1", "b2", "size"])

    return run


#: How much finer than the session's the partitions are in which sets and groups meet: theirs are the most rows.
FINER = 4
#: Pairs of sets that are compared at once.
AT_ONCE = 50_000


def _similar(num: int, den: int):  # noqa: ANN202
    """Compares the sets of the members of opened groups; pairs of classes that are similar come out, the smaller class first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = y = _Sets(batch.column("members"))
            if "others" in batch.schema.names:
                y = _Sets(batch.column("others"))
            # Each set of the left meets all sets of the right; inside one group those behind it.
            last = y.bounds[x.group + 1]
            first = y.bounds[x.group] if y is not x else np.arange(len(x.n)) + 1
            i, j = np.repeat(np.arange(len(x.n)), last - first), _ranges(first, last - first)
            near = den * np.minimum(x.n[i], y.n[j]) >= num * np.maximum(x.n[i], y.n[j])
            i, j = i[near], j[near]
            for k in range(0, len(i), AT_ONCE):
                a, b = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
                no = np.concatenate([np.repeat(np.arange(len(a)), x.n[a]), np.repeat(np.arange(len(b)), y.n[b])]).astype(np.uint64)
                found = np.concatenate([x.words[_ranges(x.start[a], x.n[a])], y.words[_ranges(y.start[b], y.n[b])]]) | (no << np.uint64(8 * KEPT))
                found.sort()
                both = np.bincount((found[:-1][found[1:] == found[:-1]] >> np.uint64(8 * KEPT)).astype(np.int64), minlength=len(a))
                hit = den * both >= num * (x.n[a] + y.n[b] - both)
                a, b = a[hit], b[hit]
                cols = x.ca[a], x.cb[a], y.ca[b], y.cb[b]
                swap = (cols[0] > cols[2]) | ((cols[0] == cols[2]) & (cols[1] > cols[3]))
                out = [np.where(swap, cols[(c + 2) % 4], cols[c]) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["xa", "xb", "ya", "yb"])

    return run


def members_of(feats: DataFrame) -> DataFrame:
    """The groups with their members, one row each."""
    # A fixed number of partitions, so that the joins by g below find the stored groups where they are.
    parts = int(feats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        feats.filter("fresh").select("g", "ca", "cb", "n", "r", "b1", "b2", "toks").repartition(parts, "g")
        .groupBy("g", "ca", "cb").agg(F.first(F.struct("n", "r", "b1", "b2", "toks")).alias("m"))
        .groupBy("g").agg(F.collect_list(F.struct("ca", "cb", "m.n", "m.r", "m.b1", "m.b2", "m.toks")).alias("members"))
    )


def _met(groups: DataFrame, num: int, den: int) -> DataFrame:
    """g, h and opened: where a query of one group meets another group over a key, and whether the bound then opens it."""
    # Not null, or each side would filter the nulls its own conditions rule out, and the two wouldn't be one shuffle.
    matrix = ", ".join(f"{c} long not null" for c in ("key", "g", "b1", "b2", "size"))
    kind = lambda s: F.col(f"{s}.size").bitwiseAND(F.lit(3))
    lo, hi = (lambda s: F.shiftright(f"{s}.size", 34)), (lambda s: F.shiftright(f"{s}.size", 4).bitwiseAND(F.lit((1 << 30) - 1)))
    lost = lambda s, o: sum(F.bit_count(F.col(f"{s}.{c}").bitwiseAND(F.bitwise_not(f"{o}.{c}"))) for c in ("b1", "b2"))
    # Between two sets the larger one is the query, by group on a tie; between a set and a large group, or two large groups, once.
    order = (hi("a") > hi("b")) | ((hi("a") == hi("b")) & (F.col("a.g") < F.col("b.g")))
    once = F.when(kind("b") == UNION, (kind("a") == ALONE) | (F.col("a.g") < F.col("b.g"))).otherwise((kind("a") == ALONE) & order)
    sizes = (den * hi("a") >= num * lo("b")) & (den * hi("b") >= num * lo("a"))
    # Of a query's words those in columns that the target lacks aren't in any of its sets; between two sets it holds both ways.
    bound = (den * (hi("a") - lost("a", "b")) >= num * hi("a")) & ((kind("b") == UNION) | ((den * (hi("a") - lost("a", "b")) >= num * (hi("a") + lost("b", "a"))) & (den * (hi("b") - lost("b", "a")) >= num * (hi("b") + lost("a", "b")))))
    finer = FINER * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = groups.mapInArrow(_matrix(num, den), matrix).repartition(finer, "key")
    # One expression over both sides, and not a filter of each, so that both read the same shuffle.
    roles = F.col("a.size").bitwiseAND(F.lit(QUERY)).bitwiseOR(F.col("b.size").bitwiseAND(F.lit(TARGET))) == QUERY + TARGET
    met = rows.alias("a").join(rows.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & roles & once)
    return met.select(F.least("a.g", "b.g").alias("g"), F.greatest("a.g", "b.g").alias("h"), (sizes & bound).alias("opened"), (kind("b") == UNION).alias("union"))


def class_pairs(groups: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes (xa, xb), (ya, yb) whose similarity reaches the threshold, each once."""
    num, den = exact(threshold)
    # The rows by which sets and groups meet are the most by far; their shuffle files go before the members travel.
    opened = cut(_met(groups, num, den).filter("opened").select("g", "h").distinct())
    # Only the groups that were opened travel further.
    since = mark(groups.sparkSession)
    used = opened.select(F.explode(F.array("g", "h")).alias("g")).distinct()
    some = groups.join(used.hint("merge"), "g", "left_semi").select("g", "members").persist()
    some.count()
    release(groups.sparkSession, since)
    ready = opened.join(some, "g").select("h", "members").join(some.select(F.col("g").alias("h"), F.col("members").alias("others")), "h").select("members", "others")
    schema = "xa long, xb long, ya long, yb long"
    across = ready.mapInArrow(_similar(num, den), schema)
    inside = groups.filter(F.size("members") > 1).select("members").mapInArrow(_similar(num, den), schema)
    return across.unionAll(inside)


def _prepared(df: DataFrame, id_col: str, group_col: str, text_col: str, common: int) -> tuple[DataFrame, DataFrame]:
    """The records with their classes and sequences (id, ca, cb, sa, sb) and the groups. Both are stored here, and what they were
    made from, with all words once more, is let go. The groups lie in the checkpoint folder: a shuffle of what is only persisted
    is made twice where two sides of a join read it."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    since = mark(spark)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).alias("ns"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    feats = features(rows, _statistics(rows.select("ns", "text")), common).persist()
    records = feats.select("id", "ca", "cb", "sa", "sb").persist()
    records.count()
    groups = members_of(feats).checkpoint()
    feats.unpersist(blocking=True)
    release(spark, since)
    return records, groups


def matrix_report(df: DataFrame, id_col: str = "id", group_col: str = "namespace", text_col: str = "content", threshold: float = 0.7, common: int = COMMON) -> DataFrame:
    """figure and n, what the matrix does: classes, groups, classes in groups of several; pairs of groups that met over a word, those
    that the bound opened and held back, those opened over a union of several sets; similar pairs of classes inside groups and across."""
    groups, (num, den) = _prepared(df, id_col, group_col, text_col, common)[1], exact(threshold)
    met = _met(groups, num, den).groupBy("g", "h").agg(F.bool_or("opened").alias("opened"), F.bool_or(F.col("opened") & F.col("union")).alias("union"))
    size = F.size("members")
    one = groups.agg(F.sum(size).alias("classes"), F.count("*").alias("groups"), F.sum(F.when(size > 1, size)).alias("classes_in_groups_of_several"))
    two = met.agg(F.count("*").alias("groups_met"), F.count_if("opened").alias("groups_opened"), F.count_if(~F.col("opened")).alias("groups_held_back"), F.count_if("union").alias("groups_opened_by_union"))
    inside = groups.filter(size > 1).select("members").mapInArrow(_similar(num, den), "xa long, xb long, ya long, yb long").agg(F.count("*").alias("similar_inside"))
    all_ = class_pairs(groups, threshold).agg(F.count("*").alias("similar"))
    out = None
    for f in (one, two, inside, all_):
        long = f.select(F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for c in f.columns))).alias("x")).select("x.*")
        out = long if out is None else out.unionAll(long)
    return out


def near_duplicate_groups(df: DataFrame, id_col: str = "id", group_col: str = "namespace", text_col: str = "content", threshold: float = 0.7, common: int = COMMON) -> DataFrame:
    """id, group_id and links of every row with words: rows that are linked by similarities, over any number of steps, share the
    group_id, the smallest id among them; links counts the other sets of words that a row's own is similar to.

    Copies aren't expanded into pairs: components are built on classes. The conventions are those of near_duplicate_pairs.
    """
    records, groups = _prepared(df, id_col, group_col, text_col, common)
    node = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    links = class_pairs(groups, threshold).select(node("xa", "xb").alias("x"), node("ya", "yb").alias("y")).persist()
    degree = links.select("x").unionAll(links.select("y")).groupBy("x").agg(F.count("*").alias("links")).withColumnRenamed("x", "node")
    labels = components(links, "x", "y").join(degree, "node").select("node", "label", "links")
    rows = records.select("id", node("ca", "cb").alias("node")).join(labels.hint("merge"), "node", "left").select("id", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    first = rows.groupBy("label").agg(F.min("id").alias("group_id"))
    return rows.join(first.hint("merge"), "label").select("id", "group_id", "links")


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", group_col: str = "namespace", text_col: str = "content", threshold: float = 0.7, common: int = COMMON) -> DataFrame:
    """Every pair of rows with equal group and a similarity of at least the threshold whose sequences of words differ: id_a < id_b.

    Rows without an id, and rows without any word (null, empty, only punctuation), are in no pair; a null group is a group.
    Rows with equal ids are paired with others as often as they occur, never with each other. Other columns play no role.
    """
    records, groups = _prepared(df, id_col, group_col, text_col, common)
    pairs = class_pairs(groups, threshold).persist()
    # Classes of several sequences, by aggregates that are combined map-side; then only rows of classes that are in a pair travel.
    seq = F.struct("sa", "sb")
    mixed = records.groupBy("ca", "cb").agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).filter("lo <> hi").select("ca", "cb").persist()
    used = pairs.select("xa").unionAll(pairs.select("ya")).unionAll(mixed.select("ca"))
    member = kept_by(records.select("ca", "cb", "sa", "sb", "id"), "ca", membership(used, "xa"))
    x, y = (member.select(F.col("ca").alias(f"{s}a"), F.col("cb").alias(f"{s}b"), F.col("id").alias(f"{s}_id")) for s in "xy")
    across = pairs.join(x.hint("merge"), ["xa", "xb"]).select("ya", "yb", "x_id").join(y.hint("merge"), ["ya", "yb"]).select("x_id", "y_id")
    # Inside a class of several sequences: pairs of sequences first, then their rows.
    rows_of = member.join(mixed, ["ca", "cb"], "left_semi").select("ca", "cb", seq.alias("s"), "id")
    seqs = rows_of.select("ca", "cb", "s").distinct()
    several = seqs.alias("p").join(seqs.alias("q"), ["ca", "cb"]).filter("p.s < q.s").select("ca", "cb", F.col("p.s").alias("ps"), F.col("q.s").alias("qs"))
    inside = (
        several.join(rows_of.select("ca", "cb", F.col("s").alias("ps"), F.col("id").alias("x_id")), ["ca", "cb", "ps"])
        .join(rows_of.select("ca", "cb", F.col("s").alias("qs"), F.col("id").alias("y_id")), ["ca", "cb", "qs"]).select("x_id", "y_id")
    )
    return across.unionAll(inside).filter("x_id <> y_id").select(F.least("x_id", "y_id").alias("id_a"), F.greatest("x_id", "y_id").alias("id_b"))
