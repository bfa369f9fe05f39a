"""Exact and near duplicates of records, the merge of their metadata, and the folding of clusters into keepers."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions import text as T
from factloom.operators.components import components
from factloom.operators.records import best_first, candidate_window, live, usable
from factloom.operators.semantic import cosine_pairs


def signal_rank(signal: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in fixed.SIGNAL_RANK.items() for x in kv)), signal), F.lit(1))


def default_confidence(signal: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in fixed.SIGNAL_CONFIDENCE.items() for x in kv)), signal), F.lit(fixed.SIGNAL_CONFIDENCE["none"]))


def exact_duplicates(memory: DataFrame) -> DataFrame:
    """namespace, content_norm hash, the first id and the number of live rows whose normalized contents are equal."""
    rows = live(memory).select("namespace", F.sha2(T.normalized(F.col("content")), 256).alias("norm"), "id")
    return rows.groupBy("namespace", "norm").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


def known_duplicates(batch: DataFrame, memory: DataFrame) -> DataFrame:
    """Rows of a batch whose normalized content a live record of the namespace has: row_id and the smallest such id."""
    have = live(memory).groupBy("namespace", T.normalized(F.col("content")).alias("norm")).agg(F.min("id").alias("dup_of"))
    return batch.withColumn("norm", T.normalized(F.col("content"))).join(have, ["namespace", "norm"]).select("row_id", "dup_of")


def merged_metadata(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The fold of each group's metadata into its first row: largest confidence, strongest signal (ties keep the older), all
    tags sorted, and one use more for every row folded in. Everything is an aggregate, combined map-side."""
    first, kept = F.struct(*order), F.coalesce("retrieval_count", F.lit(0))
    return rows.groupBy(*group).agg(
        F.min_by("id", first).alias("id"), F.max(usable()).alias("confidence"), F.min_by("signal", F.struct((-signal_rank(F.col("signal"))).alias("rank"), *order)).alias("signal"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(T.tag_list(F.col("tags")))))), ",").alias("tags"),
        (F.min_by(kept, first) + F.count("*") - 1).alias("retrieval_count"), F.count("*").alias("folded"),
    )


def lexical_classes(rows: DataFrame) -> DataFrame:
    """namespace, id, class_id: rows of one namespace with the same lexical tokens are one class, named by its smallest id. Rows without
    tokens are in none; a null namespace is a namespace."""
    keyed = rows.select("namespace", "id", T.lexical_tokens(F.col("content")).alias("toks")).filter(F.size("toks") > 0).select("namespace", "id", F.sha2(F.array_join(F.array_sort("toks"), " "), 256).alias("t"))
    named = keyed.groupBy("namespace", "t").agg(F.min("id").alias("class_id"))
    # The class of a third of all rows is one row here; adaptive skew handling splits its members.
    k, c = keyed.alias("k"), named.alias("c")
    return k.join(c.hint("merge"), F.col("k.namespace").eqNullSafe(F.col("c.namespace")) & (F.col("k.t") == F.col("c.t"))).select("k.namespace", "k.id", "c.class_id")


def lexical_pairs(rows: DataFrame, threshold: float = fixed.CLUSTER_JACCARD) -> DataFrame:
    """Pairs (namespace, a, b, sim) of rows of one namespace whose lexical tokens reach a Jaccard similarity, a before b.

    The result is exact, by three steps. Rows meet only over one of their rarest tokens: the longer of the two sends the first
    n - ceil(t * n) + 1 by frequency, the shorter the first n - ceil(2t / (1 + t) * n) + 1. What travels is a key, the size and a
    fingerprint in which each token flips one of 128 bits: sets can't differ in fewer tokens than their fingerprints in bits.
    Only pairs that pass are compared token by token, once each. Rows without tokens are similar to nothing.
    """
    toks = rows.select("namespace", "id", T.lexical_tokens(F.col("content")).alias("toks")).filter(F.size("toks") > 0)
    each = toks.select("namespace", "id", F.explode("toks").alias("tok"))
    freq = each.groupBy("namespace", "tok").agg(F.count("*").alias("df"))
    ranked = each.join(freq, ["namespace", "tok"]).groupBy("namespace", "id").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("tok").alias("h")))).alias("o"))
    flips = lambda half: F.aggregate(F.filter("hs", lambda h: F.pmod(h, F.lit(2)) == half), F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 1), F.lit(64)).cast("int"))))
    sets = ranked.select("namespace", "id", F.col("o.h").alias("hs")).select("namespace", "id", "hs", F.size("hs").alias("n"), flips(0).alias("f0"), flips(1).alias("f1")).persist()

    def sent(s: str, length: Column) -> DataFrame:
        """One row for each leading token, all columns named by side."""
        lead = F.slice("hs", F.lit(1), length.cast("int"))
        out = sets.select(F.explode(F.transform(lead, lambda h: F.xxhash64("namespace", h))).alias("key"), "id", "n", "f0", "f1")
        return out.select(*(F.col(c).alias(f"{s}_{c}") for c in out.columns))

    x, y = sent("x", F.col("n") - F.ceil(F.col("n") * threshold) + 1), sent("y", F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9) + 1)
    bits = sum(F.bit_count(F.col(f"x_{f}").bitwiseXOR(F.col(f"y_{f}"))) for f in ("f0", "f1"))
    first = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_id") > F.col("y_id")))
    near = (F.col("y_n") >= threshold * F.col("x_n")) & (bits * (1 + threshold) <= (1 - threshold) * (F.col("x_n") + F.col("y_n")) + 1e-9)
    met = x.join(y.hint("merge"), (F.col("x_key") == F.col("y_key")) & first & near).select("x_id", "y_id").distinct()
    left, right = (sets.select(F.col("id").alias(f"{s}_id"), F.col("namespace").alias(f"{s}_ns"), F.col("hs").alias(f"{s}_hs")) for s in "xy")
    both = met.join(left, "x_id").join(right, "y_id").filter("x_ns = y_ns")
    sims = both.select(F.col("x_ns").alias("namespace"), F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), T.jaccard(F.col("x_hs"), F.col("y_hs")).alias("sim"))
    return sims.filter(F.col("sim") >= threshold)


def absorb_reason(keeper: Column, other: Column, other_id: Column) -> Column:
    """What folding one content into another would do: empty, already-represented, size-cap or unique."""
    mark = F.concat(F.lit("\n\n--- merged from "), other_id, F.lit(" ---\n"))
    size = F.length(keeper) + F.length(mark) + F.length(other)
    n = T.normalized(other)
    return F.when(n == "", "empty").when(T.normalized(keeper).contains(n), "already-represented").when(size > fixed.CONTENT_CHARS, "size-cap").otherwise("unique")


def new_tokens(keeper: Column, other: Column) -> Column:
    return F.array_except(T.plain_tokens(other), T.plain_tokens(keeper))


CLUSTERS = "namespace string, keeper string, member string, contested boolean"


#: Links that are handed to one call of the greedy step, unless one component alone has more.
LINKS_AT_ONCE = 50_000


def greedy(edges: pd.DataFrame, merge_contested: bool = False) -> pd.DataFrame:
    """Seeded star clusters of whole components, in order of place.

    A seed takes all free neighbours. A cluster whose members state opposite things is contested: it is reported, and its
    members are parked, so that they can't seed but may still be taken by a later seed that is neither taken nor parked.
    A node may stand for several rows: then it has a link to itself, and na or nb is 2 if they state opposite things.
    """
    near, negated, place, space = defaultdict(set), {}, {}, {}
    for ns, a, b, pa, pb, na, nb in zip(edges["namespace"], edges["a"], edges["b"], edges["pa"], edges["pb"], edges["na"], edges["nb"]):
        near[a].add(b)
        near[b].add(a)
        place[a], place[b], negated[a], negated[b], space[a] = pa, pb, na, nb, ns
        space[b] = ns
    taken, parked, out = set(), set(), []
    for seed in sorted(near, key=place.get):
        if seed in taken or seed in parked:
            continue
        members = sorted((m for m in near[seed] if m not in taken), key=place.get)
        if not members:
            continue
        kinds = {negated[m] for m in [seed, *members]}
        contested = not merge_contested and (len(kinds) > 1 or 2 in kinds)
        out += [(space[seed], seed, m, contested) for m in members]
        (parked if contested else taken).update(members if not contested else [seed, *members])
        if not contested:
            taken.add(seed)
    return pd.DataFrame({name: [x[i] for x in out] for i, name in enumerate(("namespace", "keeper", "member", "contested"))})


def clusters(memory: DataFrame, threshold: float | None = None, per_namespace: int | None = None, merge_contested: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """namespace, keeper, member, contested: the clusters of all live rows, by lexical similarity, or by cosine where vectors
    (id, embedding) are given: then rows without a vector are in no cluster.

    per_namespace, if given, is the reference's cap: only so many of the best rows of each namespace take part.
    Rows of one namespace with the same tokens have the same neighbours, so they are one node, named by its best row: copies
    are never paired with each other. The order-dependent part runs on whole connected components, which can't affect each
    other, on their links alone. Above a threshold of 1 not even copies are similar.
    """
    threshold = threshold_for(threshold, vectors is not None)
    window = live(memory) if per_namespace is None else candidate_window(memory, per_namespace)
    toks = T.lexical_tokens(F.col("content"))
    if vectors is not None:
        window = window.join(vectors.filter(F.size("embedding") > 0).select("id", "embedding"), "id")
    same = F.sha2(F.array_join(F.array_sort(toks), " "), 256) if vectors is None else F.sha2(F.col("embedding").cast("string"), 256)
    used = F.size(toks) > 0 if vectors is None else F.lit(True)
    rows = window.filter(used & F.col("namespace").isNotNull() & F.lit(threshold <= 1)).select(
        "namespace", "id", same.alias("tokens"), T.negated(F.col("content")).cast("int").alias("neg"), best_first().alias("ord")).persist()
    grouped = rows.groupBy("namespace", "tokens").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.min("neg").alias("least"), F.max("neg").alias("most"))
    nodes = grouped.select("namespace", "tokens", F.col("ord.id").alias("node"), "ord", "n", F.when(F.col("least") == F.col("most"), F.col("most")).otherwise(2).alias("neg")).persist()
    one = window.join(nodes.select(F.col("node").alias("id")), "id", "left_semi")
    pairs = (lexical_pairs(one, threshold) if vectors is None else cosine_pairs(one, threshold)).select("a", "b")
    links = pairs.unionAll(nodes.filter("n > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))).persist()
    labels = components(links, "a", "b")
    info = nodes.join(labels, "node").select("namespace", "node", "label", "neg", F.row_number().over(Window.partitionBy("label").orderBy("ord")).alias("place"))
    a = info.select("namespace", "label", F.col("node").alias("a"), F.col("place").alias("pa"), F.col("neg").alias("na"))
    edges = links.join(a, "a").join(info.select(F.col("node").alias("b"), F.col("place").alias("pb"), F.col("neg").alias("nb")), "b")
    bins = max(1, -(-links.count() // LINKS_AT_ONCE))
    found = edges.groupBy(F.pmod(F.xxhash64("label"), F.lit(bins))).applyInPandas(lambda pdf: greedy(pdf, merge_contested), CLUSTERS)
    of = rows.join(nodes.select("namespace", "tokens", "node"), ["namespace", "tokens"]).select("node", "id")
    return found.join(of, F.col("member") == F.col("node")).filter("keeper <> id").select("namespace", "keeper", F.col("id").alias("member"), "contested")


def fold(memory: DataFrame, found: DataFrame) -> DataFrame:
    """Keepers of uncontested clusters after their members were folded in, in order of place: id, content, merged_from.

    A member is appended to the keeper as grown so far, with a mark of where it came from, unless the keeper has it already or
    would grow beyond the size cap, in which case its id alone is recorded as truncated.
    """
    m = live(memory).select("id", "content", best_first().alias("ord"))
    members = found.filter("not contested").join(m.select(F.col("id").alias("member"), F.col("content").alias("text"), "ord"), "member")
    listed = members.groupBy("keeper").agg(F.array_sort(F.collect_list(F.struct("ord", "member", "text"))).alias("ms"))
    start = lambda c: F.struct(c.alias("content"), F.lit("").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        why = absorb_reason(acc["content"], x["text"], x["member"])
        grown = F.when(why == "unique", F.concat(acc["content"], F.lit("\n\n--- merged from "), x["member"], F.lit(" ---\n"), x["text"])).otherwise(acc["content"])
        ids = F.concat(acc["ids"], F.when(acc["ids"] == "", "").otherwise(","), x["member"], F.when(why == "size-cap", ":truncated").otherwise(""))
        return F.struct(grown.alias("content"), ids.alias("ids"))

    rows = listed.join(m.select(F.col("id").alias("keeper"), "content"), "keeper")
    done = rows.select("keeper", F.aggregate("ms", start(F.col("content")), step).alias("r"))
    return done.select(F.col("keeper").alias("id"), "r.content", F.col("r.ids").alias("merged_from"))


def threshold_for(threshold: float | None, vectors: bool) -> float:
    """The similarity in force: one that is given holds; else the default of the mode, by cosine or by words."""
    return threshold if threshold is not None else (fixed.CLUSTER_COSINE if vectors else fixed.CLUSTER_JACCARD)


def consolidated(memory: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The table after the fold: keepers grown and with merged metadata, members dead with the keeper as their reason."""
    merged = found.filter("not contested").persist()
    grown = fold(memory, merged).select(F.col("id").alias("k_id"), F.col("content").alias("k_content"), F.col("merged_from").alias("k_from"))
    m = memory.select("id", usable().alias("confidence"), "signal", "tags", "retrieval_count", "ingestion_ts")
    all_ = merged.select("keeper", F.col("member").alias("id"), F.lit(1).alias("later")).unionAll(merged.select("keeper", F.col("keeper"), F.lit(0)).distinct())
    # The keeper is the oldest of its fold: on equal rank its signal stays.
    meta = all_.join(m, "id").groupBy("keeper").agg(
        F.max("confidence").alias("k_conf"), F.min_by("signal", F.struct(-signal_rank(F.col("signal")), "later", "id")).alias("k_signal"), F.flatten(F.collect_set(T.tag_list(F.col("tags")))).alias("k_tags"), F.sum("later").alias("k_n"))
    dead = merged.groupBy(F.col("member").alias("m_id")).agg(F.min("keeper").alias("m_keeper"))
    out = memory.join(grown, F.col("id") == F.col("k_id"), "left").join(meta, F.col("id") == F.col("keeper"), "left").join(dead, F.col("id") == F.col("m_id"), "left")
    hit, gone = F.col("k_id").isNotNull(), F.col("m_id").isNotNull()
    tags = F.array_join(F.array_sort(F.array_distinct("k_tags")), ",")
    new = {
        "content": F.when(hit, F.col("k_content")), "merged_from": F.when(hit, F.concat_ws(",", F.when(F.col("merged_from") != "", F.col("merged_from")), "k_from")), "confidence": F.when(hit, F.col("k_conf")), "signal": F.when(hit, F.col("k_signal")),
        "tags": F.when(hit & (tags != ""), tags), "retrieval_count": F.when(hit, F.coalesce("retrieval_count", F.lit(0)) + F.col("k_n")), "superseded_at": F.when(gone, now), "supersede_reason": F.when(gone, F.concat(F.lit("merged into "), "m_keeper")),
    }
    return out.select(*(F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in memory.columns))


def report(memory: DataFrame, found: DataFrame, per_namespace: int | None = None, pruned: Column | None = None, vectors: bool = False) -> DataFrame:
    """One row: mode, rows merged, clusters, contested clusters with their members (contested_clusters, an array), rows pruned, and by
    how many eligible rows the windows fell short (0 without a cap; knn_truncated is always 0, since no list of neighbours is cut).

    absorbed, truncated_content and empty say what the fold does with the members: how many are appended or there already, how
    many would make their keeper too long, how many have no text. Nothing is written, so a dry run is this alone.
    """
    short = 0
    if per_namespace is not None:
        eligible = live(memory).groupBy("namespace").agg(F.count("*").alias("n"))
        short = eligible.agg(F.coalesce(F.sum(F.greatest(F.col("n") - per_namespace, F.lit(0))), F.lit(0)).alias("truncated")).first()["truncated"]
    counts = found.agg(F.count_if(~F.col("contested")).alias("merged"), F.count_distinct(F.when(~F.col("contested"), F.col("keeper"))).alias("clusters"), F.count_distinct(F.when(F.col("contested"), F.col("keeper"))).alias("contested"))
    groups = found.filter("contested").groupBy("namespace", "keeper").agg(F.array_sort(F.collect_list("member")).alias("members"))
    listed = groups.agg(F.array_sort(F.collect_list(F.struct("namespace", "keeper", "members"))).alias("contested_clusters"))
    folded = fold(memory, found)
    each = folded.select(F.explode(F.split("merged_from", ",")).alias("m"))
    sizes = each.agg(F.count_if(~F.col("m").endswith(":truncated")).alias("absorbed"), F.count_if(F.col("m").endswith(":truncated")).alias("truncated_content"))
    one = F.lit(1).alias("__one")
    out = counts.withColumn("__one", F.lit(1)).join(listed.select("*", one), "__one").join(sizes.select("*", one), "__one").drop("__one")
    return out.withColumn("pruned", F.lit(0).cast("long") if pruned is None else pruned.cast("long")).withColumn("truncated", F.lit(short).cast("long")).withColumn("knn_truncated", F.lit(0).cast("long")).withColumn("mode", F.lit("cosine" if vectors else "lexical"))
