"""The found queries against literal versions of their definitions, on a whole small scale and on rows made to be awkward."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm import queries as Q
from factloom.llm.conversations import conversations
from factloom.llm.format_copies import format_copies
from factloom.llm.history_dedup import FingerprintStore, stored_cases
from factloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from factloom.llm.shared_spans import shared_spans
from factloom.llm.top_n import top_n, top_records
from tests.llm import brute


def rows(df):
    return sorted((tuple(r) if len(r) > 1 else r[0] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(data):
    return {n: pd.read_parquet(f"{data}/{n}.parquet") for n in ("memory", "memory_batch", "message", "documents")}


@pytest.mark.parametrize("name, want", [
    ("p1_found", lambda t: brute.p1(t["memory"])), ("p2_found", lambda t: brute.p2(t["memory"])), ("p3_found", lambda t: brute.p3(t["memory"])),
    ("p4_found", lambda t: brute.p4(t["memory"], t["memory_batch"])), ("p5_found", lambda t: brute.p5(t["message"])), ("p8_found", lambda t: brute.p8(t["documents"])),
])
def test_found(spark, data, tables, name, want):
    assert rows(Q.queries()[name](spark, data)) == sorted(want(tables), key=str)


VOCABULARY = [f"w{i}" for i in range(60)]


def texts(n, seed):
    r = random.Random(seed)
    base = [r.sample(VOCABULARY, r.randint(1, 12)) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice(VOCABULARY)
        if r.random() < 0.3:
            r.shuffle(t)
        out.append(r.choice([" ", ", ", "-"]).join(t).upper() if r.random() < 0.3 else " ".join(t))
    return out + [None, "", "...", "ÄÖ ß été", "été ÄÖ ß", "İx y z a b c d e f g", "x " * 5000, "x y " * 3000]


MEMORY = "id string, namespace string, content string, tags string, source_ref string, ingestion_ts timestamp, confidence double, last_retrieved timestamp, superseded_at timestamp"


def memory(n=240, seed=1):
    r = random.Random(seed)
    ts = [pd.Timestamp("2025-01-01", tz="UTC") + pd.Timedelta(days=i) for i in range(5)] + [None]
    return pd.DataFrame([
        (f"{i:04d}", r.choice(["a", "b", "b", "b"]), t, r.choice([None, "", "x, Y", "y,x,,", "z"]), r.choice([None, "", "  ", "s1", "s2", f"u{i}"]), r.choice(ts), r.choice([None, float("nan"), 0.5, 0.5, 0.9, 1.5, -1.0]), r.choice(ts), None)
        for i, t in enumerate(texts(n, seed))
    ], columns=["id", "namespace", "content", "tags", "source_ref", "ingestion_ts", "confidence", "last_retrieved", "superseded_at"])


def frame(spark, pdf, schema):
    clean = [[None if x is None or x is pd.NaT else (x.to_pydatetime() if isinstance(x, pd.Timestamp) else x) for x in r] for r in pdf.astype(object).values.tolist()]
    return spark.createDataFrame(clean, schema)


@pytest.mark.parametrize("seed, common", [(1, 20_000), (2, 20_000), (1, 0), (2, 20), (3, 40)])
def test_near_duplicates_made(spark, seed, common):
    m = memory(seed=seed)
    assert rows(near_duplicate_pairs(frame(spark, m, MEMORY), common=common)) == sorted(brute.p1(m))


def test_near_duplicates_hot_copies(spark):
    """A third of all rows are one text; families of many similar sets fill a group beyond its limit."""
    base = VOCABULARY[:30]
    content = [" ".join(base)] * 100 + [" ".join(base + [f"v{i}"]) for i in range(100)] + [f"only {i} here" for i in range(100)]
    m = pd.DataFrame({"id": [f"{i:03d}" for i in range(300)], "namespace": "n", "content": content, "superseded_at": None})
    got = near_duplicate_pairs(spark.createDataFrame(m[["id", "namespace", "content"]]))
    assert rows(got) == sorted(brute.p1(m))


def union(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {i: top(i) for i in ids}


def test_groups_made(spark):
    m = memory(seed=6)
    sets = {i: (ns, frozenset(brute.seq(c))) for i, ns, c in m[["id", "namespace", "content"]].itertuples(index=False)}
    sets = {i: s for i, s in sets.items() if s[1]}
    like = [(i, j) for i, x in sets.items() for j, y in sets.items() if i < j and x[0] == y[0] and brute.similarity(x[1], y[1]) >= 0.7]
    want = union(sets, like)
    others = {i: {sets[k] for p in like if i in p for k in p} - {sets[i]} for i in sets}
    got = near_duplicate_groups(frame(spark, m, MEMORY)).collect()
    assert {r["id"]: (r["group_id"], r["links"]) for r in got} == {i: (want[i], len(others[i])) for i in sets} and len(got) == len(sets)


def test_components_of_a_chain(spark):
    from factloom.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == union({x for p in links for x in p}, links)


def test_null_group_and_ids(spark):
    df = spark.createDataFrame([("1", None, "a b c d"), ("2", None, "b a c d"), (None, None, "a b c d e"), ("3", "x", "d c b a"), ("1", None, "d c b a")], "id string, namespace string, content string")
    assert rows(near_duplicate_pairs(df)) == [("1", "2"), ("1", "2")]


def test_top_made(spark):
    m = memory()
    assert rows(top_records(frame(spark, m, MEMORY))) == sorted(brute.p2(m), key=str)


def test_top_salts_and_clash(spark):
    df = spark.createDataFrame([("g", i % 3, i) for i in range(500)] + [(None, 1, 7)], "k string, v int, rank_no int").withColumnRenamed("rank_no", "i").withColumn("rank_no", F.lit(99))
    one = [rows(top_n(df, "k", [F.desc("v"), F.asc("i")], 7, s)) for s in (1, 4, 64)]
    assert one[0] == one[1] == one[2] and len(one[0]) == 8
    assert rows(top_n(df.limit(0), "k", [F.desc("v")], 3)) == []
    with pytest.raises(ValueError):
        top_n(df, "k", [F.desc("v")], 0)


def test_format_copies_made(spark):
    m = memory()
    extra = ['{"a": "X y", "b": 1}', '{"b":1,"a":"x  Y!"}', '{"b":1,"a":"x  Y!"', '{"a": {"k": [1, 2]}, "b": null}', '{"b": null, "a": {"k":[1,2]}}', "[1]", '{"a": "X y", "b": 1}']
    for i, x in enumerate(extra):
        m.loc[len(m)] = [f"9{i:03d}", "a", x, "T, t", None, None, None, None, None]
    kept, copies = format_copies(frame(spark, m, MEMORY))
    want = brute.p3(m)
    assert rows(copies) == sorted(want)
    assert sum(r["copies"] for r in kept.collect()) == len(m) and kept.count() == len(m) - len(want)


BATCH = "row_id long, batch_no int, line_no int, namespace string, content string, source_ref string, ingestion_ts timestamp"


def batch(m, seed):
    b = m.sample(frac=1, random_state=seed).reset_index(drop=True)
    b["row_id"], b["batch_no"] = range(len(b)), [i * 3 // len(b) for i in range(len(b))]
    b["line_no"] = b.groupby("batch_no").cumcount() + 1
    return b[["row_id", "batch_no", "line_no", "namespace", "content", "source_ref", "ingestion_ts"]]


@pytest.mark.parametrize("seed, common", [(3, 20_000), (4, 20_000), (3, 0), (4, 30)])
def test_stored_cases_made(spark, seed, common):
    m, b = memory(80, seed), batch(memory(240, seed + 10), seed)
    assert rows(stored_cases(frame(spark, m, MEMORY), frame(spark, b, BATCH), common=common)) == sorted(brute.p4(m, b), key=str)


def test_store_batch_by_batch(spark, tmp_path):
    m, b = memory(80, 5), batch(memory(200, 15), 5)
    store = FingerprintStore(spark, str(tmp_path / "store"))
    store.create(frame(spark, m, MEMORY))
    got = []
    for no in sorted(b["batch_no"].unique()):
        part = frame(spark, b[b.batch_no == no], BATCH)
        got += rows(store.check(part, no + 1))
        assert rows(store.check(part, no + 1)) == [x for x in got if x in set(b[b.batch_no == no]["row_id"])]  # a check that is run again
    assert sorted(got) == sorted(brute.p4(m, b))
    store.drop()
    assert not (tmp_path / "store").exists()


def test_a_batch_reads_its_own_ranges(spark, tmp_path, monkeypatch):
    """What a small batch reads of the block table doesn't grow with the history."""
    from factloom.llm import history_dedup as H

    monkeypatch.setattr(H, "RANGE_ROWS", 64)
    read = []
    whole = H.FingerprintStore._table
    monkeypatch.setattr(H.FingerprintStore, "_table", lambda self, name, schema, parts=None: read.append((name, len(parts or []))) or whole(self, name, schema, parts))
    for n in (300, 2400):
        m = pd.DataFrame([(f"{i:05d}", "n", " ".join(f"t{i * 7 + k}" for k in range(9)), None, None, None, None, None, None) for i in range(n)], columns=memory(4).columns)
        b = pd.DataFrame([(1, 1, 1, "n", " ".join(f"t{7 + k}" for k in range(9)), None, None), (2, 1, 2, "n", "quite new words here", None, None)], columns=["row_id", "batch_no", "line_no", "namespace", "content", "source_ref", "ingestion_ts"])
        store = FingerprintStore(spark, str(tmp_path / f"s{n}"))
        store.create(frame(spark, m, MEMORY))
        assert rows(store.check(frame(spark, b, BATCH))) == [1]
    found = [n for name, n in read if name == "blocks"]
    assert max(found) <= 12 and len(list((tmp_path / "s2400" / "blocks" / "batch=0").glob("part=*"))) > 60


def test_chain_of_rows(spark):
    """Each row is like the next one only: every second one is accepted."""
    w = [f"c{i}" for i in range(40)]
    b = pd.DataFrame([(i, 1, i, "n", " ".join(w[i : i + 12]), None, None) for i in range(20)], columns=["row_id", "batch_no", "line_no", "namespace", "content", "source_ref", "ingestion_ts"])
    m = memory(4, 1).iloc[:0]
    assert rows(stored_cases(frame(spark, m, MEMORY), frame(spark, b, BATCH))) == sorted(brute.p4(m, b), key=str)


MESSAGE = "session_id string, seq int, message_id long, role string, content string, tool_use_id string, is_meta boolean, stored_ts timestamp"


def test_conversations_made(spark):
    r = random.Random(7)
    ts = [datetime(2025, 1, 1, i, tzinfo=timezone.utc) for i in range(3)] + [None]
    out, no = [], 0
    for s in range(150):
        turns = ["user", "assistant"] * r.randint(1, 4)
        for q, role in enumerate(turns, 1):
            no += 1
            say = r.choice(["hi", '[{"type":"text","text":"yes"}]', "[x] plain", "ok"])
            if r.random() < 0.06:
                say = r.choice([None, "", " \n", "[]", '[{"type":"text"}]', '[{"type":"text","text":" "}]', "[1, 2]"])
            role = r.choice([role] * 15 + [role.upper(), f" {role}\n", "system", "tool", None])
            out.append((f"s{s}", None if r.random() < 0.005 else q + int(r.random() < 0.01), no, role, say, None, r.choice([None] * 9 + [True, False]), r.choice(ts)))
            if r.random() < 0.1:
                out.append((*out[-1][:2], no + 10_000, out[-1][3], r.choice([say, "other"]), None, None, r.choice(ts)))
    for s, order in enumerate(([1, 2, 3, 4], [1, 3, 2, 4], [1, 2, 4, 3])):
        kinds = {1: ("user", "q", None), 2: ("assistant", "[]", "t"), 3: ("user", "[]", "t"), 4: ("assistant", "a", None)}
        out += [(f"t{s}", q, 50_000 + 10 * s + q, *kinds[k], None, ts[0]) for q, k in enumerate(order, 1)]
    out.append((None, 1, 99_999, "user", "x", None, None, ts[0]))
    m = pd.DataFrame(out, columns=["session_id", "seq", "message_id", "role", "content", "tool_use_id", "is_meta", "stored_ts"]).astype(object).where(lambda d: d.notna(), None)
    want = brute.p5(m)
    assert len(want) > 50
    assert rows(conversations(spark.createDataFrame(out, MESSAGE)).select("session_id", "turn_no", "message_id")) == sorted(want, key=str)


def test_conversation_longer_than_a_block(spark, monkeypatch):
    from factloom.llm import conversations as C

    monkeypatch.setattr(C, "BLOCK", 7)
    out = [("s", i, i, "user" if i % 2 else "assistant", "x", None, None, None) for i in range(1, 101)]
    bad = [("t", i, 200 + i, "user" if i % 2 or i == 14 else "assistant", "x", None, None, None) for i in range(1, 31)]  # 14 and 15 meet across blocks
    got = rows(C.conversations(spark.createDataFrame(out + bad, MESSAGE)).select("session_id", "turn_no", "message_id"))
    assert [x[:2] for x in sorted(got, key=lambda x: x[1])] == [("s", i) for i in range(1, 101)]


@pytest.mark.parametrize("seed, hot", [(1, 10**6), (2, 10**6), (3, 5), (4, 0)])
def test_spans_made(spark, seed, hot):
    r = random.Random(seed)
    parts = ["".join(r.choices("abcdefgh é漢", k=r.randint(20, 90))) for _ in range(30)]
    docs = [(i, "".join(r.choices(parts, k=r.randint(0, 8)))) for i in range(60)] + [(100, None), (101, "a" * 300), (102, "a" * 500), (103, "x" * 120), (104, "x" * 120), (105, "x" * 119)]
    docs += [(200 + i, docs[5][1] + "tail") for i in range(30)]
    want = brute.p8(pd.DataFrame(docs, columns=["doc_id", "text"]), 60)
    got = shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), length=60, k=25, hot_rows=hot)
    assert rows(got) == sorted(want, key=str)


def test_empty_tables(spark):
    m, b = frame(spark, memory(4).iloc[:0], MEMORY), spark.createDataFrame([], BATCH)
    assert rows(near_duplicate_pairs(m)) == rows(top_records(m)) == rows(format_copies(m)[1]) == rows(stored_cases(m, b)) == []
    assert rows(conversations(spark.createDataFrame([], MESSAGE))) == rows(shared_spans(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_long_texts_are_cut_without_loss(monkeypatch):
    from factloom.llm import shared_spans as P

    r = random.Random(9)
    texts = ["".join(r.choices("abcd", k=n)) for n in (5000, 3, 0, 60, 777, 2000)] + ["z" * 900]
    want = [x.tolist() for x in P.anchors(texts, 60, 25)]
    monkeypatch.setattr(P, "CHUNK", 128)
    assert [x.tolist() for x in P.anchors(texts, 60, 25)] == want


def test_clashing_columns(spark):
    """Extra columns named like those that the operators make change nothing."""
    def more(df):
        for c in ("g", "ca", "cb", "h", "t", "n", "s", "e", "w", "ns", "text", "ord", "ref", "key", "toks", "item", "kind", "size", "blk", "turn", "keep_id", "row", "fresh", "salt", "rank", "range", "u", "no"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    m, b = frame(spark, memory(60, 8), MEMORY), frame(spark, batch(memory(40, 9), 9), BATCH)
    assert rows(near_duplicate_pairs(more(m))) == rows(near_duplicate_pairs(m))
    assert rows(top_records(more(m))) == rows(top_records(m))
    assert rows(format_copies(more(m))[1]) == rows(format_copies(m)[1])
    assert rows(stored_cases(more(m), more(b))) == rows(stored_cases(m, b))
    d = spark.createDataFrame([(1, "ab" * 100), (2, "ab" * 90)], "doc_id long, text string")
    assert rows(shared_spans(more(d.withColumnRenamed("text", "body")), text_col="body")) == rows(shared_spans(d)) != []
    c = spark.createDataFrame([("s", 1, 1, "user", "q", None, None, None), ("s", 2, 2, "assistant", "a", None, None, None)], MESSAGE)
    assert rows(conversations(more(c))) == rows(conversations(c)) != []
