"""Items of varying length in containers of fixed capacity, by vector best-fit."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import DEFAULT_TOKENIZER, n_tokens

#: Items that one task packs.
SHARD_ITEMS = 16_384
#: Containers that leave more of their capacity than this unused after the first round are emptied and packed again, those of all shards together.
OPEN_SHARE = 0.02
#: Attention cost that a container may hold, as a share of its capacity squared.
COST_SHARE = 0.8


def docs_limit(capacity: int) -> int:
    """Documents that a container may hold."""
    return max(4, capacity // 64)


def best_fit(sizes: list[int], capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> list[int]:
    """The container number of each item, largest items first.

    A container has three residual capacities: tokens, documents, and attention cost (the sum of squared lengths). Among all
    containers in which an item fits under all three, the one with the smallest weighted norm of what remains is taken, or with
    rule "dot" the one with the largest weighted dot product of the item with the residuals; the first opened on a tie. An item
    whose own cost exceeds the limit gets a container without any other item of cost.

    Containers in the same state are held together, states by their residual tokens. These are tried from the tightest (for "dot"
    from the roomiest) until the token part of the score alone can't beat the best one found, so the choice is that of a full search.
    """
    out, n_bins = [0] * len(sizes), 0
    by_room: dict[int, dict[tuple[int, int], list[int]]] = {}
    mask = 0
    wt, wd, wc = weights
    dot = rule == "dot"
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        cost = n * n
        best, best_score, m = None, None, mask >> n
        ahead = wd * max_docs / max_docs**2 + wc * cost * max_cost / max_cost**2
        while m:
            at = m.bit_length() - 1 if dot else (m & -m).bit_length() - 1
            m ^= 1 << at
            room = n + at
            part = -wt * n * room / capacity**2 if dot else (wt * at / capacity) ** 2
            if best_score is not None and part - (ahead if dot else 0.0) > best_score + 1e-9:
                break
            for (d, c), bins in by_room[room].items():
                if d < 1 or c < cost:
                    continue
                score = part - (wd * d / max_docs**2 + wc * cost * c / max_cost**2) if dot else part + (wd * (d - 1) / max_docs) ** 2 + (wc * (c - cost) / max_cost) ** 2
                score = round(score, 12)  # so that equal scores are equal in whatever order they were added up
                if best_score is None or (score, bins[0]) < (best_score, best[3]):
                    best, best_score = (room, d, c, bins[0]), score
        if best is None:
            room, d, c, b = capacity, max_docs, max(max_cost, cost), n_bins
            n_bins += 1
        else:
            room, d, c, b = best
            bins = by_room[room][d, c]
            heappop(bins)
            if not bins:
                del by_room[room][d, c]
                if not by_room[room]:
                    del by_room[room]
                    mask ^= 1 << room
        room, d, c = room - n, d - 1, c - cost
        if d > 0:
            heappush(by_room.setdefault(room, {}).setdefault((d, c), []), b)
            mask |= 1 << room
        out[i] = b
    return out


def _by_shard(max_docs: Callable[[int], int], cost_share: float, rule: str, name: str):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["piece_tokens", "item"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins = pd.Series(best_fit([int(x) for x in pdf["piece_tokens"]], c, max_docs(c), int(cost_share * c * c), rule=rule))
        used = pdf.groupby(bins)["piece_tokens"].transform("sum")
        kind, shard = pdf["container_kind"].iloc[0], pdf["shard"].iloc[0]
        return pd.DataFrame({
            "container_kind": pdf["container_kind"], "container_id": [f"{kind}/{name}{shard}/{b}" for b in bins], "item": pdf["item"], "piece_no": pdf["piece_no"].astype("int32"),
            "piece_start": pdf["piece_start"], "piece_tokens": pdf["piece_tokens"], "used_tokens": used, "unused_tokens": c - used,
        })

    return run


def pack(items: DataFrame, kinds: list[tuple[str, int]], id_col: str = "doc_id", size_col: str = "n_tokens", max_docs: Callable[[int], int] = docs_limit, cost_share: float = COST_SHARE, rule: str = "norm", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every item, once for each kind of container, with its container and what that leaves unused.

    An item larger than the capacity is cut: its full pieces fill containers of their own, the rest is packed like an item. No
    other item is cut. Items are spread by hash over shards of about `shard_items`, each packed by best_fit under three
    capacities: tokens, max_docs(capacity) documents, and an attention cost of cost_share * capacity**2, more only for a single
    item that needs it. What each shard leaves part-filled, by more than OPEN_SHARE, is packed once more over all shards, so that
    the space lost doesn't grow with their number. Items of size 0 are placed too. A null size counts as 0, rows that repeat an
    id are items of their own, and other columns play no role.
    """
    if any(c < 1 for _, c in kinds):
        raise ValueError("capacities must be positive")
    item = items.select(F.col(id_col).alias("item"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    each = item.withColumn("kind", F.explode(F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds)))).select("item", "size", "kind.*")
    full = F.floor(F.col("size") / F.col("capacity"))
    whole = each.filter(F.col("size") > F.col("capacity")).withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), full - 1))).select(
        "container_kind", F.concat_ws("/", "container_kind", F.lit("full"), F.col("item").cast("string"), F.col("piece_no").cast("string")).alias("container_id"), "item",
        F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("capacity")).alias("piece_start"), F.col("capacity").alias("piece_tokens"), F.col("capacity").alias("used_tokens"), F.lit(0).cast("long").alias("unused_tokens"),
    )
    cut = F.col("size") > F.col("capacity")
    rest = each.select("item", "container_kind", "capacity", F.when(cut, full).otherwise(F.lit(0).cast("long")).alias("piece_no"), F.when(cut, full * F.col("capacity")).otherwise(F.lit(0).cast("long")).alias("piece_start"), F.when(cut, F.col("size") % F.col("capacity")).otherwise(F.col("size")).alias("piece_tokens"))
    rest = rest.filter((F.col("piece_start") == 0) | (F.col("piece_tokens") > 0))
    kind = items.schema[id_col].dataType.simpleString()
    schema = f"container_kind string, container_id string, item {kind}, piece_no int, piece_start long, piece_tokens long, used_tokens long, unused_tokens long"

    def shared_out(rows: DataFrame, n: int, name: str) -> DataFrame:
        shards = max(1, -(-n // shard_items))
        sharded = rows.withColumn("shard", F.pmod(F.xxhash64("item", "container_kind"), F.lit(shards)))
        return sharded.groupBy("container_kind", "shard").applyInPandas(_by_shard(max_docs, cost_share, rule, name), schema)

    n = item.count()
    packed = shared_out(rest, n, "")
    if n > shard_items:
        first = packed.persist()
        room = F.col("used_tokens") + F.col("unused_tokens")
        open_ = first.filter(F.col("unused_tokens") > OPEN_SHARE * room)
        again = open_.select("item", "container_kind", room.alias("capacity"), "piece_no", "piece_start", "piece_tokens")
        packed = first.filter(F.col("unused_tokens") <= OPEN_SHARE * room).unionAll(shared_out(again, -(-open_.count() // len(kinds)), "again-"))
    return packed.unionByName(whole).withColumnRenamed("item", "doc_id")


def settings(container_kind: DataFrame) -> list[tuple[str, int]]:
    """The kinds with a name and a capacity: a small fixed table of settings, read on the driver."""
    return sorted((r["container_kind"], r["capacity_tokens"]) for r in container_kind.filter("container_kind is not null and capacity_tokens > 0").collect())


def sizes(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    return documents.select("doc_id", n_tokens(F.col("text"), tokenizer).alias("n_tokens")).persist()


def containers(documents: DataFrame, container_kind: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Every document in a container of each kind."""
    return pack(sizes(documents, tokenizer), settings(container_kind))


def unused_space(packed: DataFrame) -> DataFrame:
    """By kind: containers, tokens, unused tokens and their share of the whole room."""
    one = packed.groupBy("container_kind", "container_id").agg(F.first("used_tokens").alias("used"), F.first("unused_tokens").alias("unused"))
    return one.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("used").alias("used_tokens"), F.sum("unused").alias("unused_tokens")).withColumn("unused_share", F.col("unused_tokens") / (F.col("used_tokens") + F.col("unused_tokens")))


def promises(documents: DataFrame, container_kind: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """By kind what a packing must keep, counted over the whole of it: documents placed, documents that were cut though they fit,
    tokens lost, containers over their tokens, documents or attention cost, and whether little space is unused (2 % and two
    containers at most)."""
    kinds, sized = settings(container_kind), sizes(documents, tokenizer)
    packed = pack(sized, kinds).persist()
    of = {k: F.element_at(F.create_map(*(F.lit(x) for name, c in kinds for x in (name, v(c)))), F.col("container_kind")) for k, v in (("capacity", int), ("docs", docs_limit), ("cost", lambda c: int(COST_SHARE * c * c)))}
    square = F.col("piece_tokens") * F.col("piece_tokens")
    bins = packed.groupBy("container_kind", "container_id").agg(F.sum("piece_tokens").alias("used"), F.count("*").alias("pieces"), F.sum(square).alias("cost"), F.max(square).alias("largest"))
    by_bin = bins.groupBy("container_kind").agg(
        F.count_if(F.col("used") > of["capacity"]).alias("over_capacity"), F.count_if(F.col("pieces") > of["docs"]).alias("over_documents"),
        F.count_if(F.col("cost") > F.greatest(of["cost"].cast("long"), "largest")).alias("over_cost"), F.sum("used").alias("used"), (F.sum(of["capacity"].cast("long") - F.col("used"))).alias("unused"))
    docs = packed.join(sized.select("doc_id", "n_tokens"), "doc_id").groupBy("container_kind", "doc_id").agg(F.first("n_tokens").alias("n"), F.sum("piece_tokens").alias("got"), F.count("*").alias("pieces"))
    by_doc = docs.groupBy("container_kind").agg(F.count("*").alias("documents"), F.sum(F.col("n") - F.col("got")).alias("tokens_lost"), F.count_if((F.col("n") <= of["capacity"]) & (F.col("pieces") > 1)).alias("cut_though_fitting"))
    little = F.col("unused") <= 0.02 * (F.col("used") + F.col("unused")) + 2 * of["capacity"]
    return by_doc.join(by_bin, "container_kind").select("container_kind", of["capacity"].cast("long").alias("capacity"), "documents", "tokens_lost", "cut_though_fitting", "over_capacity", "over_documents", "over_cost", little.alias("little_unused"))
