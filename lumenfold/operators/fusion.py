"""Rank fusion, recency blending, quotas and quota merging over ranked lists with explicit ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import id_recency

# Fusion constant, blend weights and slots.
RRF_K = 60
SEMANTIC_WEIGHT, RECENCY_WEIGHT = 0.80, 0.20
TOTAL_SLOTS, MIN_SLOTS = 100, 3


def rrf(lists: list[DataFrame], k: int = RRF_K, query: str = "query_id", item: str = "paper_id") -> DataFrame:
    """``rrf_score`` and ``fused_rank`` of items over ranked lists; ties in order of the lists, then of ranks in them."""
    rows = reduce(DataFrame.unionByName, [x.select(query, item, (F.lit(1.0) / (k + F.col("rank"))).alias("term"), F.struct(F.lit(i).alias("list"), F.col("rank").cast("int").alias("rank")).alias("seen")) for i, x in enumerate(lists)])
    fused = rows.groupBy(query, item).agg(F.round(F.sum("term"), 12).alias("rrf_score"), F.min("seen").alias("seen"))
    order = W.partitionBy(query).orderBy(F.desc("rrf_score"), "seen")
    return fused.withColumn("fused_rank", F.row_number().over(order)).drop("seen")


def recency_rerank(fused: DataFrame, as_of_month: int, query: str = "query_id") -> DataFrame:
    """``final_score`` and ``rank`` of fused rows that have an ``arxiv_id``; one score for all becomes 0."""
    all_ = W.partitionBy(query)
    low, high = F.min("rrf_score").over(all_), F.max("rrf_score").over(all_)
    scaled = (F.col("rrf_score") - low) / F.when(high == low, 1.0).otherwise(high - low)
    score = F.round(SEMANTIC_WEIGHT * scaled + RECENCY_WEIGHT * id_recency(F.col("arxiv_id"), as_of_month), 9)
    scored = fused.withColumn("final_score", score)
    return scored.withColumn("rank", F.row_number().over(all_.orderBy(F.desc("final_score"), "fused_rank")))


def allocate_quotas(clusters: DataFrame, total: int = TOTAL_SLOTS, least: int = MIN_SLOTS, group: str = "user_id", index: str = "cluster_idx") -> DataFrame:
    """``quota`` of each cluster by its ``importance``: floors with a minimum, what is left by largest fraction.

    Without importance at all, slots are dealt evenly and the first cluster gets the rest.  Floors may lift the sum
    above ``total``.  A single cluster gets all.
    """
    all_ = W.partitionBy(group)
    weight, n = F.sum("importance").over(all_), F.count(F.lit(1)).over(all_)
    position = F.row_number().over(all_.orderBy(index))
    rows = clusters.withColumns({"__w": weight, "__n": n, "__i": position})
    raw = F.round(F.col("importance") / F.col("__w") * total, 9)
    rows = rows.withColumns({"__raw": F.when(F.col("__w") > 0, raw), "__floor": F.when(F.col("__w") > 0, F.greatest(F.floor(raw).cast("int"), F.lit(least)))})
    rows = rows.withColumns({"__rest": F.lit(total) - F.sum("__floor").over(all_), "__order": F.row_number().over(all_.orderBy(F.desc(F.col("__raw") % 1), "__i"))})
    even = F.greatest(F.floor(F.lit(total) / F.col("__n")) + F.when(F.col("__i") == 1, F.lit(total) % F.col("__n")).otherwise(0), F.lit(least))
    quota = F.when(F.col("__n") == 1, F.greatest(F.lit(total), F.lit(least))).when(F.col("__w") <= 0, even).otherwise(F.col("__floor") + (F.col("__order") <= F.col("__rest")).cast("int"))
    return rows.withColumn("quota", quota.cast("int")).select(*clusters.columns, "quota")


def merge_quota(lists: DataFrame, group: str = "user_id", item: str = "paper_id") -> DataFrame:
    """Sequential merge of ranked lists (``list_no``, ``rank``, ``quota``): list by list, each takes its first ``quota``
    items that no earlier list took.  Returns ``position`` (from 1) and the ``list_no`` that took the item.

    One exchange by group and a fold over the group's rows in order, for any number of lists.  A group's lists are what
    its quotas let through, so they fit a task.
    """
    types = dict(lists.dtypes)
    none = F.array().cast(f"array<struct<item: {types[item]}, list_no: {types['list_no']}>>")
    rows = F.array_sort(F.collect_list(F.struct("list_no", "rank", F.col(item).alias("item"), "quota")))

    def step(state, row):
        n = F.when(state["list_no"] == row["list_no"], state["n"]).otherwise(0)
        takes = (n < row["quota"]) & ~F.exists(state["taken"], lambda t: t["item"] == row["item"])
        taken = F.when(takes, F.array_append(state["taken"], F.struct(row["item"].alias("item"), row["list_no"].alias("list_no")))).otherwise(state["taken"])
        return F.struct(taken.alias("taken"), row["list_no"].alias("list_no"), (n + takes.cast("int")).cast("int").alias("n"))

    start = F.struct(none.alias("taken"), F.lit(None).cast(types["list_no"]).alias("list_no"), F.lit(0).alias("n"))
    merged = lists.groupBy(group).agg(F.aggregate(rows, start, step, lambda s: s["taken"]).alias("taken"))
    return merged.select(group, F.posexplode("taken").alias("position", "t")).select(group, F.col("t.item").alias(item), "t.list_no", (F.col("position") + 1).alias("position"))


def attribution(lists: DataFrame, group: str = "user_id", item: str = "paper_id") -> DataFrame:
    """The list in which each item first occurs, over the whole lists, not what their quotas took."""
    return lists.groupBy(group, item).agg(F.min("list_no").alias("list_no"))


def ordered_distinct(table: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """The first of each item in its group, with all columns."""
    return table.withColumn("__n", F.row_number().over(W.partitionBy(group, item).orderBy(order))).where("__n = 1").drop("__n")


def exclude_seen(ranked: DataFrame, seen: DataFrame, k: int, query: str = "query_id", item: str = "paper_id") -> DataFrame:
    """Ranked rows without the seen ones, cut to k and ranked anew."""
    left = ranked.join(seen, [query, item], "left_anti")
    return left.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy("rank"))).where(F.col("rank") <= k)
