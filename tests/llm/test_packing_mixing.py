from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from factloom.llm import queries as Q
from factloom.llm.mixing import Node, budgets, leaves_under, mix, share_out
from factloom.llm.packing import COST_SHARE, best_fit, containers, docs_limit, pack, unused_space
from factloom.llm.tokens import DEFAULT_TOKENIZER, encoder

KINDS = [("small", 50), ("large", 700)]


def items(spark, n=3000, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, None if i == 7 else r.choice([0, 1, r.randint(1, 50), r.randint(1, 200), 50, 51, 100])) for i in range(n)] + [(5, 3), (5, 3)], "doc_id long, n_tokens int")


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_item_is_placed_once(spark, rule):
    got = pack(items(spark), KINDS, rule=rule, shard_items=500).collect()
    want = Counter((k, r["doc_id"], r["n_tokens"] or 0) for k, _ in KINDS for r in items(spark).collect())
    pieces, used = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["container_kind"], r["doc_id"]].append((r["piece_start"], r["piece_tokens"]))
        used[r["container_kind"], r["container_id"]].append((r["piece_tokens"], r["used_tokens"], r["unused_tokens"]))
    total = Counter()
    for (k, d, n), c in want.items():
        total[k, d] += n * c
    assert {k: sum(p[1] for p in v) for k, v in pieces.items()} == dict(total)
    for (kind, _), v in used.items():
        cap = dict(KINDS)[kind]
        assert {x[1] for x in v} == {sum(x[0] for x in v)} and {x[1] + x[2] for x in v} == {cap} and len(v) <= docs_limit(cap)
    for (kind, d), v in pieces.items():
        if d != 5:
            cap, n = dict(KINDS)[kind], sum(p[1] for p in v)
            assert len(v) == (1 if n <= cap else -(-n // cap))
            assert sorted(v) == [(s, min(cap, n - s)) for s in range(0, max(n, 1), cap)]


def test_little_is_wasted():
    r = random.Random(3)
    sizes = [r.randint(1, 400) for _ in range(5000)]
    bins = best_fit(sizes, 512, 64, 512 * 512)
    assert (max(bins) + 1) * 512 / sum(sizes) < 1.01


def slow_fit(sizes, capacity, max_docs, max_cost, rule):
    """Best fit by trying every container."""
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        best = None
        for b, (t, d, c) in enumerate(bins):
            if t >= n and d >= 1 and c >= n * n:
                s = -(n * t / capacity**2 + 0.05 * d / max_docs**2 + 0.05 * n * n * c / max_cost**2) if rule == "dot" else ((t - n) / capacity) ** 2 + (0.05 * (d - 1) / max_docs) ** 2 + (0.05 * (c - n * n) / max_cost) ** 2
                if best is None or (round(s, 12), b) < best:
                    best = (round(s, 12), b)
        if best is None:
            bins.append([capacity, max_docs, max(max_cost, n * n)])
        b = len(bins) - 1 if best is None else best[1]
        bins[b] = [bins[b][0] - n, bins[b][1] - 1, bins[b][2] - n * n]
        out[i] = b
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("seed, limit, share", [(1, 10**6, 1.0), (2, 4, 1.0), (3, 10**6, 0.5), (4, 5, 0.6)])
def test_choice_is_that_of_a_full_search(rule, seed, limit, share):
    r = random.Random(seed)
    sizes = [r.choice([0, r.randint(1, 100), r.randint(1, 30), 33]) for _ in range(400)]
    assert best_fit(sizes, 100, limit, int(share * 10_000), rule=rule) == slow_fit(sizes, 100, limit, int(share * 10_000), rule)


def test_each_limit_binds():
    """Each of the three capacities alone changes the packing, and all hold together."""
    r = random.Random(4)
    sizes = [r.randint(0, 100) for _ in range(2000)]
    free = best_fit(sizes, 100, 10**6, 10**8)
    docs, cost = best_fit(sizes, 100, 3, 10**8), best_fit(sizes, 100, 10**6, int(COST_SHARE * 10_000))
    assert max(Counter(free).values()) > 3 and docs != free and cost != free
    held = defaultdict(list)
    for s, b in zip(sizes, best_fit(sizes, 100, 5, 4000)):
        held[b].append(s)
    assert all(sum(v) <= 100 and len(v) <= 5 and (sum(x * x for x in v) <= 4000 or sum(x > 0 for x in v) == 1) for v in held.values())


def test_equal_items_are_quick():
    assert max(best_fit([30] * 200_000, 100, 64, 10_000)) + 1 == -(-200_000 // 3)


def test_shards_are_packed_again(spark):
    """Many small shards lose little more than one."""
    it = items(spark, 4000, 5).cache()
    one, many = ({r["container_kind"]: r["containers"] for r in unused_space(pack(it, KINDS, shard_items=n)).collect()} for n in (10**6, 100))
    assert all(many[k] <= 1.03 * one[k] + 1 for k in one)


def test_texts(spark, data):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (4, "word " * 3000), (5, "<|endoftext|>")], "doc_id long, text string")
    kinds = spark.createDataFrame([("a", 10), ("b", 1000), (None, 5), ("c", 0)], "container_kind string, capacity_tokens int")
    got = containers(docs, kinds).collect()
    size = encoder(DEFAULT_TOKENIZER)
    assert sum(r["piece_tokens"] for r in got if r["doc_id"] == 4 and r["container_kind"] == "a") == size("word " * 3000)
    assert {(r["container_kind"], r["doc_id"]) for r in got} == {(k, d) for k in "ab" for d in range(1, 6)}
    assert pack(items(spark).limit(0), KINDS).count() == 0
    shares = {r["container_kind"]: r["unused_share"] for r in Q.queries()["p6_unused"](spark, data).collect()}
    assert shares["recall_context"] < 0.02
    assert unused_space(containers(docs, kinds)).count() == 2


def test_shortage_goes_to_siblings_first():
    root = Node(1.0, children={"a": Node(0.5, children={"x": Node(0.5, 10, 1), "y": Node(0.5, 100, 1)}), "b": Node(0.5, 1000, 1)})
    share_out(root, 100)
    a = root.children["a"]
    assert (a.children["x"].budget, a.children["y"].budget, root.children["b"].budget) == (10, 40, 50)
    share_out(root, 400)
    assert (a.budget, root.children["b"].budget) == (110, 290)


def test_budgets_follow_the_tree():
    """A short leaf is made up for inside its language, then its domain; without shortage each source has its target."""
    leaves = [("a", "en", "x", 100), ("a", "en", "y", 100), ("a", "de", "x", 100), ("b", "en", "y", 100)]
    by = {p: n.budget for p, n in leaves_under(budgets(leaves, {"x": (0.4, 2), "y": (0.6, 2)}, 200))}
    assert {p: round(v, 6) for p, v in by.items()} == {("a", "en", "x"): 40, ("a", "en", "y"): 60, ("a", "de", "x"): 40, ("b", "en", "y"): 60}
    by = {p: n.budget for p, n in leaves_under(budgets([("a", "en", "x", 10), ("a", "en", "y", 500), ("b", "en", "y", 500)], {"x": (0.5, 1), "y": (0.5, 2)}, 200))}
    assert {p: round(v, 6) for p, v in by.items()} == {("a", "en", "x"): 10, ("a", "en", "y"): 140, ("b", "en", "y"): 50}
    assert budgets([], {}, 5).budget == 0


def made(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["en", "de", None]), r.choice(["A", " a\n", "b", "c", None, "", "z"]), "tok " * r.randint(0, 60)) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"), spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 4), ("c", 0.2, 2), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")


def test_shares_are_met(spark):
    docs, target = made(spark)
    chosen, shares = mix(docs, target)
    chosen = chosen.cache()
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == {"a", "b", "c", "none"} and got["none"]["tokens"] == 0
    assert all(abs(r["actual_share"] - r["planned_share"]) < 0.002 and r["most_repeats"] <= r["max_repeats"] for r in got.values())
    # A source can't give half of all tokens: the others take over what it lacks.
    assert got["a"]["planned_share"] < 0.55 and sum(r["planned_share"] for r in got.values()) == pytest.approx(1)
    rows = chosen.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"a", "b", "c"}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs, target)[0].collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, mix(docs, target, seed=1)[0].collect()))


def test_shares_are_the_targets_where_there_is_room(spark):
    docs, target = made(spark)
    got = {r["source"]: r for r in mix(docs, target, total_tokens=20_000)[1].collect()}
    for s, w in (("a", 0.5), ("b", 0.2), ("c", 0.2)):
        assert abs(got[s]["actual_share"] - w / 0.9) < 0.005
    assert abs(sum(r["tokens"] for r in got.values()) - 20_000) < 200


def test_total_beyond_the_room(spark):
    docs, target = made(spark)
    got = {r["source"]: r for r in mix(docs, target, total_tokens=10**9)[1].collect()}
    assert all(got[s]["most_repeats"] == got[s]["max_repeats"] for s in "abc")
    assert mix(docs.limit(0), target)[0].count() == 0


def test_mix_of_the_test_data(spark, data):
    assert Q.queries()["p7_mix"](spark, data).count() > 0
    shares = Q.queries()["p7_shares"](spark, data).collect()
    assert len(shares) == 14 and abs(sum(r["actual_share"] for r in shares) - 1) < 1e-9


def test_clashing_columns(spark):
    docs, target = made(spark)
    more = docs.withColumns({c: docs["doc_id"] for c in ("item", "size", "kind", "capacity", "shard", "u", "range", "epochs", "rest", "n_tokens")})
    assert sorted(map(tuple, mix(more, target)[0].collect())) == sorted(map(tuple, mix(docs, target)[0].collect()))
    sized = items(spark, 200)
    assert sorted(map(tuple, pack(sized.withColumns({c: sized["doc_id"] for c in ("item", "size", "kind", "capacity", "shard", "container_kind")}), KINDS).collect())) == sorted(map(tuple, pack(sized, KINDS).collect()))
