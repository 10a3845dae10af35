"""Recommendations for all users at once: clusters, quotas, candidates, re-ranking, diversity and fallback tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.vectors import dense_topk, shared_topk
from ..operators import clustering, fusion, ranking, state
from ..sources.staging import staged

# Candidates fetched per quota slot, size of the session supplement.
OVERSAMPLE = 3
SUPPLEMENT = 20
RANKER = "heuristic_v1"


def _vectors_of(state_table: DataFrame, column: str, vectors: DataFrame) -> DataFrame:
    return state.exploded(state_table, column).join(vectors.select("paper_id", "embedding"), "paper_id")


def profile_table(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """``user_id``, ``lt``, ``st``, ``neg``, ``n`` (long-term updates)."""
    long_term = state.ewma_profile(events, vectors, "long_term").withColumnRenamed("profile", "lt")
    short_term = state.ewma_profile(events, vectors, "short_term").select("user_id", F.col("profile").alias("st"))
    negative = state.ewma_profile(events, vectors, "negative").select("user_id", F.col("profile").alias("neg"))
    return long_term.join(short_term, "user_id", "full").join(negative, "user_id", "full").select("user_id", "lt", "st", "neg", "n")


def cluster_candidates(clusters: DataFrame, vectors: DataFrame, seen: DataFrame) -> DataFrame:
    """Ranked lists per user and cluster, in order of importance: ``list_no``, ``rank``, ``quota``, ``cluster_idx``."""
    order = W.partitionBy("user_id").orderBy(F.desc("importance"), "cluster_idx")
    numbered = fusion.allocate_quotas(clusters.withColumn("list_no", F.row_number().over(order)), index="list_no")
    asked = numbered.select(
        (F.col("user_id") * 8 + F.col("list_no")).alias("query_id"), "user_id", "list_no", "quota", "cluster_idx", F.col("medoid_embedding").alias("embedding"), (F.col("quota") * OVERSAMPLE).alias("k")
    )
    barred = seen.join(asked.select("user_id", "query_id"), "user_id").select("query_id", "paper_id")
    # Medoids are papers, so many users ask with the same vector.
    found = shared_topk(asked, vectors, (fusion.TOTAL_SLOTS + 8) * OVERSAMPLE, exclude=barred, k_column="k")
    return found.join(asked.select("query_id", "user_id", "list_no", "quota", "cluster_idx"), "query_id").drop("query_id")


def multi_interest(events: DataFrame, vectors: DataFrame, papers: DataFrame, as_of: str, limit: int = 10, lists_of: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """``user_id``, ``position``, ``paper_id``, ``candidate_source``, ``cluster_id`` for users with enough saved vectors.

    ``lists_of`` (user state) and ``profiles`` may be given if they are at hand.  Tables that several steps read are
    written once to shared storage.
    """
    lists_of = staged(state.user_state(events), "state") if lists_of is None else lists_of
    profiles = staged(profile_table(events, vectors), "profiles") if profiles is None else profiles
    saved = staged(_vectors_of(lists_of, "positives", vectors), "saved")
    enough = saved.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= state.MIN_CLUSTER_SAVES).select("user_id")
    clusters = staged(clustering.user_clusters(saved.join(enough, "user_id", "left_semi")), "clusters")
    seen = state.all_seen(lists_of)
    lists = staged(cluster_candidates(clusters, vectors, seen), "lists")
    merged = staged(fusion.merge_quota(lists), "merged")
    source = lists.groupBy("user_id", "paper_id").agg(F.min_by("cluster_idx", "list_no").alias("cluster_idx"))
    # The session's own neighbours follow the merged lists and overwrite their attribution.
    asks = profiles.where("st IS NOT NULL").join(enough, "user_id", "left_semi").select(F.col("user_id").alias("query_id"), F.col("st").alias("embedding"))
    barred = seen.union(merged.select("user_id", "paper_id")).withColumnRenamed("user_id", "query_id")
    extra = dense_topk(asks, vectors, SUPPLEMENT, exclude=barred).select(F.col("query_id").alias("user_id"), "paper_id", F.lit(-1).alias("cluster_idx"), (F.col("rank") + 1000).alias("position"))
    candidates = merged.join(source, ["user_id", "paper_id"]).select("user_id", "paper_id", "cluster_idx", "position").union(extra)
    candidates = staged(candidates.withColumn("position", F.row_number().over(W.partitionBy("user_id").orderBy("position")) - 1), "candidates")
    known = candidates.join(vectors.select("paper_id", "embedding"), "paper_id").join(papers.select("paper_id", "category", "published"), "paper_id")
    # Ranks are made without the vectors, which only features and diversity need.
    ranked = ranking.rerank(ranking.features(known, profiles.drop("n"), as_of).drop("embedding"))
    ranked = staged(ranking.drop_suppressed(ranked, state.suppressed_categories(events, papers, as_of)).select("user_id", "paper_id", "rank", "score"), "ranked")
    chosen = staged(ranking.mmr(ranked.join(vectors.select("paper_id", "embedding"), "paper_id"), limit), "chosen")
    explored = ranking.explore(chosen, ranked)
    final = chosen.select("user_id", "paper_id", F.col("mmr_rank").alias("position"), F.lit(False).alias("explored")).union(
        explored.select("user_id", "paper_id", F.col("explore_rank") + limit, F.lit(True))
    )
    tagged = final.join(candidates.select("user_id", "paper_id", "cluster_idx"), ["user_id", "paper_id"], "left")
    return tagged.select(
        "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("position")).alias("position"), "paper_id",
        scalars.candidate_source(F.col("cluster_idx"), F.col("explored")).alias("candidate_source"), F.when(F.col("cluster_idx") >= 0, F.col("cluster_idx")).alias("cluster_id"),
    )


def recommend(events: DataFrame, vectors: DataFrame, papers: DataFrame, codes: list[str], as_of: str, limit: int = 10) -> DataFrame:
    """``user_id``, ``tier``, ``position``, ``paper_id``, ``candidate_source`` of every user, from the first tier that has rows.

    1 interest clusters, 2 nearest to the long-term profile, 3 best score from examples, 0 trending for users without saves.
    A later tier is computed only for users whom the earlier ones left without rows.
    """
    lists_of = staged(state.user_state(events), "state")
    profiles = staged(profile_table(events, vectors), "profiles")
    seen = state.all_seen(lists_of).withColumnRenamed("user_id", "query_id")
    first = staged(multi_interest(events, vectors, papers, as_of, limit, lists_of, profiles), "tier1")
    first = first.select("user_id", F.lit(1).alias("tier"), "position", "paper_id", "candidate_source")
    plain = lambda table, tier: table.select(F.col("query_id").alias("user_id"), F.lit(tier).alias("tier"), F.col("rank").alias("position"), "paper_id", F.lit(None).cast("string").alias("candidate_source"))
    asks = profiles.where(F.col("n") >= state.MIN_EWMA_SAVES).join(first, "user_id", "left_anti").select(F.col("user_id").alias("query_id"), F.col("lt").alias("embedding"))
    second = staged(plain(dense_topk(asks, vectors, limit, exclude=seen), 2), "tier2")
    examples = _vectors_of(lists_of, "positives", vectors).withColumn("positive", F.lit(True)).unionByName(_vectors_of(lists_of, "negatives", vectors).withColumn("positive", F.lit(False)))
    examples = examples.join(first, "user_id", "left_anti").join(second, "user_id", "left_anti")
    third = plain(ranking.best_score(staged(examples, "examples").select(F.col("user_id").alias("query_id"), "paper_id", "embedding", "positive"), vectors, limit), 3)
    fresh = events.select("user_id").distinct().join(lists_of.where(F.size("positives") > 0), "user_id", "left_anti")
    zero = fresh.join(F.broadcast(tables_trending(papers, codes, limit))).select("user_id", F.lit(0).alias("tier"), "position", "paper_id", F.lit("trending").alias("candidate_source"))
    return first.union(second).union(third).union(zero)


def tables_trending(papers: DataFrame, codes: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows: ``paper_id``, ``position``."""
    from ..operators.tables import trending

    top = trending(papers, codes, limit)
    order = W.orderBy(F.desc("citation_count"), F.desc("update_date"), "arxiv_id")
    return top.select("paper_id", F.row_number().over(order).alias("position"))
