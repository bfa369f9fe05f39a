from __future__ import annotations

import random
from collections import defaultdict

import pytest

from factloom.llm.paragraph_bands import paragraph_clusters, tuned
from tests.llm.brute import seq

VOCABULARY = [f"w{i}" for i in range(400)]


def made(seed):
    r = random.Random(seed)
    base = [r.sample(VOCABULARY, r.randint(8, 60)) for _ in range(25)]
    out = []
    for i in range(120):
        paras = []
        for _ in range(r.randint(0, 4)):
            t = list(r.choice(base))
            if r.random() < 0.6:
                t.insert(r.randrange(len(t)), r.choice(VOCABULARY))
            paras.append(r.choice([" ", ", "]).join(t))
        out.append((i, r.choice(["\n", "\n\n", "\r\n"]).join([*paras, "ok", "..."])))
    return out + [(500, None), (501, ""), (None, "a b c d e f"), (502, " ".join(VOCABULARY * 40)), (502, "ok")]


def shingles(text):
    w = seq(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_tuned():
    for t in (0.5, 0.8, 0.95):
        b, r = tuned(t, 0.99)
        assert 1 - (1 - t**r) ** b >= 0.99 and b * r <= 128


@pytest.mark.parametrize("seed, recall, hot", [(1, 0.99, 256), (2, 0.99, 256), (3, 0.9999, 1)])
def test_clusters_against_all_pairs(spark, seed, recall, hot):
    """Nearly all similar pairs are linked, nothing else is, and copies are one; with hot buckets sent the exact way, all are."""
    docs = made(seed)
    rows = paragraph_clusters(spark.createDataFrame(docs, "doc_id long, text string"), recall=recall, hot_bucket=hot).collect()
    text = defaultdict(list)
    for d, t in docs:
        text[d].append(t or "")
    sets = []
    for r in rows:
        found = {shingles(t[r["span_start"] : r["span_end"]]) for t in text[r["doc_id"]] if shingles(t[r["span_start"] : r["span_end"]])}
        sets.append(next(iter(found)) if len(found) == 1 else None)
    links = defaultdict(set)
    good = [(s, r) for s, r in zip(sets, rows) if s is not None]
    distinct = {s for s, _ in good}
    for a in distinct:
        links[a] = {b for b in distinct if a != b and len(a & b) >= 0.8 * len(a | b)}
    got, want = sum(r["links"] for _, r in good), sum(len(links[s]) for s, _ in good)
    assert want > 100 and (got == want if hot == 1 else 0.95 * want <= got <= want)
    cluster = defaultdict(set)
    for s, r in good:
        cluster[r["cluster_id"]].add(s)
    for members in cluster.values():
        assert len(members) == 1 or all(links[s] & members for s in members)
    kept = [r for r in rows if not r["removed"]]
    assert len({r["cluster_id"] for r in rows}) == len({r["cluster_id"] for r in kept}) and all(r["doc_id"] is not None for r in rows)


def test_empty_and_clashing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(made(4), "doc_id long, text string")
    assert paragraph_clusters(df.limit(0)).count() == 0
    more = df.withColumns({c: F.lit(1) for c in ("no", "s", "e", "ca", "g", "keys", "key", "n", "links", "label")})
    key = lambda d: sorted((r["doc_id"], r["paragraph_no"], r["cluster_id"], r["links"]) for r in d.collect())
    assert key(paragraph_clusters(more)) == key(paragraph_clusters(df)) != []
