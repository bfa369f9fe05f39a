"""Sources mixed to target weights, by hierarchical budgeting."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.tokens import DEFAULT_TOKENIZER, n_tokens

#: Hash ranges by which a leaf's seeded order is cut.
RANGE_BITS = 12


@dataclass
class Node:
    """A node of the weight tree; a leaf has tokens and repeats."""

    weight: float
    tokens: int = 0
    repeats: int = 0
    children: dict[object, Node] = field(default_factory=dict)
    budget: float = 0.0

    def room(self) -> float:
        return sum(c.room() for c in self.children.values()) if self.children else float(self.tokens * self.repeats)


def share_out(node: Node, budget: float) -> None:
    """Gives a node's budget to its children by weight, no child more than it has room for.

    What a short child leaves goes to its siblings by their weights; only when all of them are full does the shortage reach the
    parent, whose own siblings then take it, because a parent's room is the sum of its children's.
    """
    node.budget = min(budget, node.room())
    open_, left = [c for c in node.children.values() if c.weight > 0 and c.room() > 0], node.budget
    given = {id(c): 0.0 for c in open_}
    while open_:
        total = sum(c.weight for c in open_)
        short = [c for c in open_ if left * c.weight / total >= c.room()]
        if not short:
            for c in open_:
                given[id(c)] = left * c.weight / total
            break
        for c in short:
            given[id(c)] = c.room()
            left -= c.room()
        open_ = [c for c in open_ if c not in short]
    for c in node.children.values():
        share_out(c, given.get(id(c), 0.0))


def clean_source(col: str) -> Column:
    return F.lower(F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def leaves_under(node: Node, path: tuple = ()) -> list[tuple[tuple, Node]]:
    """The leaves below a node with their paths."""
    return [x for name, c in node.children.items() for x in leaves_under(c, (*path, name))] if node.children else [(path, node)]


def budgets(leaves: list[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total: float) -> Node:
    """The tree of domain, language and source with a budget at every node.

    leaves are (domain, lang, source, tokens). A source's target weight goes to its leaves by the tokens they hold, and the weight
    of a language or a domain is the sum of those below it, so that without any shortage every source has its target share and
    its own mix of domains and languages. What a short leaf leaves goes first to the other sources of the same language and
    domain, then to the other languages of the domain, then to the other domains.
    """
    held: dict[str, int] = {}
    for _, _, s, n in leaves:
        held[s] = held.get(s, 0) + n
    root = Node(1.0)
    for domain, lang, s, n in sorted(leaves):
        w = targets[s][0] * n / held[s]
        d = root.children.setdefault(domain, Node(0.0))
        x = d.children.setdefault(lang, Node(0.0))
        x.children[s] = Node(w, n, targets[s][1])
        d.weight += w
        x.weight += w
    if root.children:
        share_out(root, total)
    return root


def prefix(rows: DataFrame, keys: list[str], nearest: bool) -> DataFrame:
    """Adds `taken`: whether a row is in its group's prefix, in the unsigned order of u, then doc_id, that `rest` tokens pay for.

    The prefix ends before the first row that would overdraw, or with nearest where it comes nearest to rest. The sum up to a row is
    that of the ranges of u before its own and of the rows before it in its range, so no group is gathered in one task.
    """
    placed = rows.withColumn("range", F.shiftrightunsigned("u", 64 - RANGE_BITS))
    sums = placed.groupBy(*keys, "range").agg(F.sum("n_tokens").alias("in_range"))
    before = sums.select(*keys, "range", (F.sum("in_range").over(Window.partitionBy(*keys).orderBy("range")) - F.col("in_range")).alias("before"))
    w = Window.partitionBy(*keys, "range").orderBy(F.shiftrightunsigned("u", 1), "u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("n_tokens").over(w) - (F.col("n_tokens") / 2 if nearest else F.lit(0))
    return placed.join(before.hint("merge"), [*keys, "range"]).select(*rows.columns, (upto <= F.col("rest")).alias("taken"))


def small(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A frame of a few rows that the plan holds itself."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))}))


def mix(documents: DataFrame, mix_target: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str = DEFAULT_TOKENIZER, domain: str = "doc_kind") -> tuple[DataFrame, DataFrame]:
    """The chosen documents with their repeats, and the share each source of the mix reached.

    The tree has the domains (the column `domain`) below its root, then the languages, then the sources; see `budgets`. Each leaf
    gets its budget as whole epochs over its documents and, for what remains, the longest prefix of one more epoch that the
    budget pays for, in an order seeded by hash. What the leaves of a source leave over because documents aren't cut is settled
    at the source: one more seeded prefix over documents not yet taken in this epoch, up to the one that comes nearest, with
    documents larger than what is left passed over. No document is used more than max_repeats times. The total is total_tokens
    or, without it, all tokens that the sources of the mix hold; a larger total is met as far as the room goes.

    planned_share is a source's share of the budgets: its target, less what it can't give, plus what it takes over from short
    siblings. Sources are compared without case and surrounding blanks. Null, unknown or empty sources, documents without an id
    and documents without tokens are never chosen; rows that repeat a document in the same leaf are one document, the longest; null
    domains and languages are nodes of their own. mix_target is a small
    fixed table of settings and is read on the driver, as are the token sums of the leaves, one row for each domain, language and source.
    """
    targets = {}
    for r in mix_target.select(clean_source("source").alias("source"), "target_share", "max_repeats").filter("source is not null").collect():
        targets[r["source"]] = (max(r["target_share"] or 0.0, 0.0), max(r["max_repeats"] or 0, 0))
    kind = F.coalesce(F.col(domain).cast("string"), F.lit("")) if domain in documents.columns else F.lit("")
    docs = documents.select("doc_id", clean_source("source").alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), kind.alias("domain"), "text").filter(F.col("source").isin(list(targets)) & F.col("doc_id").isNotNull())
    at = ["domain", "lang", "source"]
    sized = docs.select("doc_id", *at, n_tokens(F.col("text"), tokenizer).alias("n_tokens")).filter("n_tokens > 0").groupBy("doc_id", *at).agg(F.max("n_tokens").alias("n_tokens")).persist()
    sums, largest = sized.groupBy(*at).agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest")).collect(), dict.fromkeys(targets, 0)
    held = [(*(r[c] for c in at), r["tokens"]) for r in sums]
    for r in sums:
        largest[r["source"]] = max(largest[r["source"]], r["largest"])
    root = budgets(held, targets, float(sum(x[3] for x in held) if total_tokens is None else total_tokens))
    spark, plan, planned, owed = documents.sparkSession, [], dict.fromkeys(targets, 0.0), dict.fromkeys(targets, 0.0)
    for path, leaf in leaves_under(root):
        if path:
            epochs = min(int((leaf.budget + 1e-6) // leaf.tokens), leaf.repeats)
            plan.append((*path, epochs, leaf.repeats, 0.0 if epochs == leaf.repeats else max(0.0, leaf.budget - epochs * leaf.tokens)))
            planned[path[2]] += leaf.budget
            owed[path[2]] += plan[-1][-1]
    leaves = small(spark, "domain string, lang string, source string, epochs int, most int, rest double", plan)

    order = lambda salt: F.xxhash64(F.lit(seed + salt), "epochs", "doc_id")
    first = prefix(sized.join(F.broadcast(leaves), at).withColumn("u", order(0)), at, nearest=False).persist()
    paid = first.groupBy("source").agg(F.sum(F.when(F.col("taken"), F.col("n_tokens")).otherwise(0)).alias("paid"))
    left = small(spark, "source string, owed double", list(owed.items())).join(paid, "source").select("source", (F.col("owed") - F.col("paid")).alias("left"))
    # A leaf whose documents are all used up to their repeats has no further epoch.
    may = first.filter("not taken and epochs < most").join(F.broadcast(left), "source").filter("n_tokens <= left")
    more = prefix(may.select("doc_id", *at, "n_tokens", "epochs", F.col("left").alias("rest"), order(1).alias("u")), ["source"], nearest=True).filter("taken")
    once = first.select("source", "lang", "domain", "doc_id", "n_tokens", (F.col("epochs") + F.col("taken").cast("int")).alias("repeats"))
    both = once.unionAll(more.select("source", "lang", "domain", "doc_id", "n_tokens", F.lit(1).alias("repeats")))
    chosen = both.groupBy("source", "lang", "domain", "doc_id", "n_tokens").agg(F.sum("repeats").cast("int").alias("repeats")).filter("repeats > 0")

    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    whole = sum(planned.values()) or 1.0
    wanted = small(spark, "source string, target_share double, max_repeats int, planned_share double, planned_tokens double, largest_document double", [(s, float(w), int(k), planned[s] / whole, planned[s], float(largest[s])) for s, (w, k) in targets.items()])
    all_ = wanted.join(got, "source", "left").select("source", "target_share", "max_repeats", "planned_share", "planned_tokens", "largest_document", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_repeats")))
    shares = all_.withColumn("actual_share", F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), F.lit(0.0)))
    return chosen, shares


def promises(documents: DataFrame, mix_target: DataFrame) -> DataFrame:
    """By source what a mix must keep, counted over all of it: documents with tokens that it could choose from, chosen documents that
    aren't among them, documents used more often than allowed, and whether its tokens are those planned, to 1 % of the mix or to one
    document of its own, since documents aren't cut."""
    chosen, shares = mix(documents, mix_target)
    chosen = chosen.persist()
    mine = documents.filter(F.col("doc_id").isNotNull() & (F.col("text") != "")).groupBy(clean_source("source").alias("source")).agg(F.count_distinct("doc_id").alias("available"))
    known = documents.select("doc_id", clean_source("source").alias("source")).distinct()
    strange = chosen.join(known, ["doc_id", "source"], "left_anti").groupBy("source").agg(F.count("*").alias("strange"))
    most = shares.select("source", "max_repeats")
    often = chosen.join(F.broadcast(most), "source").groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("too_often"))
    all_ = shares.join(mine, "source", "left").join(strange, "source", "left").join(often, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_.select("source", "target_share", "max_repeats", zero("available"), zero("strange"), zero("too_often"), (F.abs(F.col("tokens") - F.col("planned_tokens")) <= F.greatest("largest_document", 0.01 * F.sum("tokens").over(Window.partitionBy()))).alias("as_planned"))
