"""Long exact spans shared between documents.

A character is shared when it lies in a run of `length` consecutive characters that also stands, exactly, in another text. The
result is exact, and no pair of documents is ever formed:

1. Of every run of `length` characters the smallest hash of its k-grams marks an *anchor* (winnowing). The choice depends on the
   run alone, so equal runs in two texts have equal anchors at equal places.
2. Anchors that stand in two texts or more are found by one shuffle of (hash, text) rows. Anchors that a task itself finds in
   two of its texts go on at once, and only two of their rows are compared with the other tasks: a passage quoted in a third of
   all documents sends two rows a batch.
3. The shared anchors return to their texts, which send for each the characters that a run around it can reach. Behind a
   second shuffle by anchor, every run around equal anchors is compared by the hash of its whole content. An anchor with very
   many rows is not gathered: its runs are compared one by one, by an aggregate that is combined map-side.
4. The runs that stand in two texts are united to maximal spans. Whole copies of a text are one text until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.words import signed

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Characters that are hashed at once, and rows of context that are compared at once.
CHUNK, ROWS = 1 << 20, 4096
#: Rows of one anchor that are still compared in one task, 20 MB of text.
HOT_ROWS = 100_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * M1
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k along the last axis, by doubling; as many as there are codes, those past the end are of no use."""
    size, at, cur, out = 1, 0, _mixed(codes.astype(np.uint64) + np.uint64(1)), None
    while True:
        if k & size:
            if out is None:
                out = cur.copy()
            else:
                out *= M3
                out[..., : out.shape[-1] - at] += cur[..., at:]
            at += size
        if at == k:
            return _mixed(out)
        nxt = cur * M2
        nxt[..., : nxt.shape[-1] - size] += cur[..., size:]
        nxt ^= nxt >> np.uint64(29)
        cur, size = nxt, size * 2


def _sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + w] for every i, cut at the end."""
    x, size = x.copy(), 1
    while size * 2 <= w:
        x[:-size] = op(x[:-size], x[size:].copy())
        size *= 2
    if rest := w - size:
        x[:-rest] = op(x[:-rest], x[rest:].copy())
    return x


def anchors(texts: list[str], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together, in order: the number of the text, the place and the hash of each anchor.

    Texts longer than CHUNK are cut into pieces that overlap by one character less than a run, so each run lies whole in one
    piece and memory doesn't grow with a text.
    """
    out, held, chars = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            held.append((i, at, text[at : at + CHUNK + length - 1]))
            chars += len(held[-1][2])
            if chars >= 2 * CHUNK:
                out.append(_anchors_of(held, length, k))
                held, chars = [], 0
    if held:
        out.append(_anchors_of(held, length, k))
    no, at, h = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    if any(len(t) > CHUNK for t in texts):  # an anchor in an overlap comes twice
        both = np.unique(np.rec.fromarrays([no, at], names="no,at"), return_index=True)[1]
        no, at, h = no[both], at[both], h[both]
    return no, at, h


def _anchors_of(pieces: list[tuple[int, int, str]], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for _, _, t in pieces])
    codes = np.frombuffer("".join(t for _, _, t in pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = gram_hashes(codes, k) | np.uint64(1)
    w, ends = length - k + 1, np.cumsum(sizes)
    low = _sliding(h, w, np.minimum)
    for end, n in zip(ends, sizes):  # runs may not reach into the next text
        low[max(end - n, end - length + 1) : end] = 0
    # A place is an anchor when the largest of the minima of the runs that hold it is its own hash.
    back = np.concatenate([np.zeros(w - 1, dtype=np.uint64), low])
    at = np.flatnonzero(_sliding(back, w, np.maximum)[: len(h)] == h)
    piece = np.searchsorted(ends, at, side="right")
    return np.array([i for i, _, _ in pieces])[piece], at - (ends - sizes)[piece] + np.array([o for _, o, _ in pieces])[piece], h[at]


def text_id(text: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


def _chunks(batches: Iterator[pa.RecordBatch], *cols: str) -> Iterator[list[tuple]]:
    held, chars = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in cols)):
            held.append(row)
            chars += len(row[0])
            if chars >= CHUNK:
                yield held
                held, chars = [], 0
    if held:
        yield held


def _anchor_rows(length: int, k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in _chunks(batches, "text"):
            fresh: dict[int, str] = {}
            for (text,) in rows:
                if (t := text_id(text)) not in seen:
                    fresh[t] = text
            if len(seen) > 500_000:
                seen.clear()
            seen |= fresh.keys()
            if not fresh:
                continue
            no, _, h = anchors(list(fresh.values()), length, k)
            ids = np.fromiter(fresh, dtype=np.int64)
            pairs = np.unique(np.rec.fromarrays([h, no], names="h,no"))  # an anchor counts once a text
            h, no = pairs["h"], pairs["no"]
            first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            start = np.flatnonzero(first)
            count = np.diff(np.append(start, len(h)))
            several = np.repeat(count > 1, count)
            asks = first | np.concatenate([[False], first[:-1]])[: len(h)]  # the first two rows of each hash
            asks = ~several | asks
            # Rows that ask travel by hash; rows already known to be shared travel by text. The first two do both.
            hs = np.concatenate([h[asks], h[several]]).view(np.int64)
            ts = np.concatenate([ids[no[asks]], ids[no[several]]])
            known = np.concatenate([np.zeros(asks.sum(), bool), np.ones(several.sum(), bool)])
            for i in range(0, len(hs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (hs, ts, known)], names=["h", "t", "known"])

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (known, h, t): those that are known, and those of hashes with two texts. Holds one row at most."""
    held_h = held_t = None
    held_shared = False
    for b in batches:
        h, t, known = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "t", "known"))
        out_h, out_t = [h[known]], [t[known]]
        h, t = h[~known], t[~known]
        if len(h):
            if held_h is not None:
                h, t = np.concatenate([[held_h], h]), np.concatenate([[held_t], t])
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            end = np.append(start[1:], len(h)) - 1
            shared = t[start] != t[end]
            if held_h is not None and held_shared:
                shared[0] = True
            mask = np.repeat(shared, end - start + 1)
            if held_h is not None and held_shared:
                mask[0] = False  # it has come out already
            out_h.append(h[mask])
            out_t.append(t[mask])
            held_h, held_t, held_shared = h[-1], t[-1], bool(shared[-1])
        hs, ts = np.concatenate(out_h), np.concatenate(out_t)
        if len(hs):
            yield pa.RecordBatch.from_arrays([pa.array(hs), pa.array(ts)], names=["h", "t"])


def _contexts(length: int, k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - k
        for rows in _chunks(batches, "text", "t", "hs"):
            no, at, h = anchors([r[0] for r in rows], length, k)
            h = h.view(np.int64)
            wanted = [np.unique(np.array(r[2], dtype=np.int64)) for r in rows]
            lo = np.searchsorted(no, np.arange(len(rows) + 1))
            out: list[tuple] = []
            for i, (text, t, _) in enumerate(rows):
                hh, pp = h[lo[i] : lo[i + 1]], at[lo[i] : lo[i + 1]]
                keep = np.isin(hh, wanted[i])
                for x, p in zip(hh[keep].tolist(), pp[keep].tolist()):
                    out.append((x, t, p, text[max(0, p - reach) : p + length]))
            for i in range(0, len(out), 10_000):
                cols = zip(*out[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["h", "t", "p", "ctx"])

    return run


def _spans_of(rows: list[tuple], length: int, k: int) -> pa.RecordBatch:
    """The spans of complete groups of anchors: for each row the hull of its runs that another text has too."""
    reach, width = length - k, 2 * length - k
    codes = np.zeros((len(rows), width), dtype=np.uint32)
    t = np.array([r[1] for r in rows], dtype=np.int64)
    p = np.array([r[2] for r in rows], dtype=np.int64)
    lo, hi = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for i, (_, _, at, ctx) in enumerate(rows):
        lo[i] = reach - min(at, reach)
        hi[i] = lo[i] + len(ctx)
        codes[i, lo[i] : hi[i]] = np.frombuffer(ctx.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hashes = gram_hashes(codes, length)[:, : reach + 1]
    s = np.arange(reach + 1)
    row, off = np.nonzero((s >= lo[:, None]) & (s + length <= hi[:, None]))
    flat, ft = hashes[row, off], t[row]
    order = np.argsort(flat, kind="stable")
    sorted_h, sorted_t = flat[order], ft[order]
    if not len(order):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["t", "s", "e"])
    start = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
    differ = np.minimum.reduceat(sorted_t, start) != np.maximum.reduceat(sorted_t, start)
    mine = np.zeros(len(order), bool)
    mine[order] = np.repeat(differ, np.diff(np.append(start, len(order))))
    first, last = np.full(len(rows), 1 << 40), np.full(len(rows), -1)
    np.minimum.at(first, row[mine], off[mine])
    np.maximum.at(last, row[mine], off[mine])
    hit = last >= 0
    base = p[hit] - reach
    return pa.RecordBatch.from_arrays([pa.array(t[hit]), pa.array(base + first[hit]), pa.array(base + last[hit] + length)], names=["t", "s", "e"])


def _runs(length: int, k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("h", "t", "p", "ctx"))))
            held += rows
            if len(held) >= ROWS:
                cut = len(held)  # the last group may go on in the next batch
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield _spans_of(held[:cut], length, k)
                    held = held[cut:]
        if held:
            yield _spans_of(held, length, k)

    return run


def _windows(length: int, k: int):  # noqa: ANN202
    """Every run around an anchor as a row of its own: the hash of its content, the text, the anchor's place, and where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, width = length - k, 2 * length - k
        for b in batches:
            for i in range(0, len(b), ROWS):
                rows = b.slice(i, ROWS)
                p, texts = rows.column("p").to_numpy(zero_copy_only=False), rows.column("ctx").to_pylist()
                codes = np.zeros((len(texts), width), dtype=np.uint32)
                lo = reach - np.minimum(p, reach)
                for r, ctx in enumerate(texts):
                    codes[r, lo[r] : lo[r] + len(ctx)] = np.frombuffer(ctx.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                hi = lo + np.array([len(x) for x in texts])
                s = np.arange(reach + 1)
                row, off = np.nonzero((s >= lo[:, None]) & (s + length <= hi[:, None]))
                w = gram_hashes(codes, length)[row, off].view(np.int64)
                t = rows.column("t").to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(t), pa.array((p[row] - reach + off).astype(np.int64))], names=["w", "t", "s"])

    return run


def _hot_runs(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """The same runs for anchors with very many rows: compared by content, combined map-side, with no group in one task."""
    rows = contexts.mapInArrow(_windows(length, k), "w long, t long, s long")
    twice = rows.groupBy("w").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("w")
    return rows.join(twice.hint("merge"), "w", "left_semi").select("t", "s", (F.col("s") + length).alias("e"))


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 120, k: int = 40, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, span_start, span_end of the maximal runs of characters that stand verbatim in another document.

    Texts that are null, or shorter than `length`, share nothing. Rows that repeat a doc_id with the same text count once; with
    another text they count as another document. Rows without an id are left out. Positions count characters, not bytes.
    """
    if not 0 < k <= length:
        raise ValueError("k must lie in 1..length")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull() & (F.char_length("text") >= length))
    asked = docs.select("text").mapInArrow(_anchor_rows(length, k), "h long, t long, known boolean")
    shared = asked.repartition(F.expr("if(known, t, h)")).sortWithinPartitions("h", "t").mapInArrow(_shared_rows, "h long, t long")
    shared = shared.persist()
    per_text = shared.groupBy("t").agg(F.collect_set("h").alias("hs"))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = [text_id(x) for x in texts]
            fresh = []
            for t in ids:
                fresh.append(t not in seen)
                seen.add(t)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x if f else None for x, f in zip(texts, fresh)], pa.string())], names=["doc_id", "t", "n", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.mapInArrow(identify, f"doc_id {kind}, t long, n long, text string")
    texts = named.filter(F.col("text").isNotNull()).select("t", "text")
    contexts = texts.join(per_text.hint("merge"), "t").select("text", "t", "hs").mapInArrow(_contexts(length, k), "h long, t long, p int, ctx string")
    grouped = lambda rows: rows.repartition("h").sortWithinPartitions("h").mapInArrow(_runs(length, k), "t long, s long, e long")
    hot = shared.groupBy("h").agg(F.count("*").alias("rows")).filter(F.col("rows") > hot_rows).select("h").persist()
    if hot.isEmpty():
        runs = grouped(contexts)
    else:
        runs = grouped(contexts.join(hot, "h", "left_anti").select("h", "t", "p", "ctx")).unionAll(_hot_runs(contexts.join(hot, "h", "left_semi"), length, k))
    # Gaps and islands: a run starts a new span when it begins behind all that began before it.
    w = Window.partitionBy("t").orderBy("s", "e")
    ahead = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.distinct().withColumn("new", F.when(F.col("s") <= ahead, 0).otherwise(1)).withColumn("no", F.sum("new").over(w))
    spans = islands.groupBy("t", "no").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    rows = named.select("doc_id", "t", "n").groupBy("doc_id", "t").agg(F.first("n").alias("n"))
    copies = rows.groupBy("t").agg(F.count("*").alias("many")).filter("many > 1").select("t")
    whole = rows.join(copies.hint("merge"), "t", "left_semi").select("doc_id", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    parts = rows.join(copies.hint("merge"), "t", "left_anti").join(spans.hint("merge"), "t").select("doc_id", "s", "e")
    return whole.unionAll(parts).select("doc_id", F.col("s").cast("int").alias("span_start"), F.col("e").cast("int").alias("span_end"))
