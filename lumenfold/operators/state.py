"""Per-user state folded from the event log: recent events, bounded save and dismiss lists, profile vectors, tiers.

Ordered folds over lists sort a user's last events inside an array, at most ``HISTORY``; profiles are folded row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# List lengths, learning rates and thresholds.
MAX_POSITIVES = 20
MAX_NEGATIVES = 50
HISTORY = MAX_POSITIVES + MAX_NEGATIVES
ALPHA = {"long_term": 0.03, "short_term": 0.40, "negative": 0.15}
MIN_CLUSTER_SAVES = 5
MIN_EWMA_SAVES = 3


def recent(events: DataFrame, n: int, kinds: list[str] | None = None) -> DataFrame:
    """Each user's newest ``n`` events (of the kinds named), with their ``rank``; equal times by larger id."""
    own = events.where(F.col("event_type").isin(kinds)) if kinds else events
    order = W.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _added(items: Column, item: Column, most: int) -> Column:
    """``item`` put first, unless it is there already; the oldest beyond ``most`` go."""
    return F.when(F.array_contains(items, item), items).otherwise(F.slice(F.array_prepend(items, item), 1, most))


def user_state(events: DataFrame) -> DataFrame:
    """``user_id``, ``positives``, ``negatives``: newest first, each paper in one of them, from the last events replayed.

    Saving a paper that is saved already does not move it.
    """
    own = recent(events, HISTORY, ["save", "not_interested"])
    log = F.array_sort(F.collect_list(F.struct("timestamp", "id", "event_type", "paper_id")))
    empty = F.array().cast("array<bigint>")

    def step(state, e):
        save = e["event_type"] == "save"
        p, n, item = state["positives"], state["negatives"], e["paper_id"]
        return F.struct(
            F.when(save, _added(p, item, MAX_POSITIVES)).otherwise(F.array_remove(p, item)).alias("positives"),
            F.when(save, F.array_remove(n, item)).otherwise(_added(n, item, MAX_NEGATIVES)).alias("negatives"),
        )

    folded = own.groupBy("user_id").agg(F.aggregate(log, F.struct(empty.alias("positives"), empty.alias("negatives")), step).alias("s"))
    return folded.select("user_id", "s.positives", "s.negatives")


def exploded(state: DataFrame, column: str) -> DataFrame:
    """``user_id``, ``pos`` (from 0), ``paper_id`` of a list column."""
    return state.select("user_id", F.posexplode(column).alias("pos", "paper_id"))


def all_seen(state: DataFrame) -> DataFrame:
    return exploded(state, "positives").union(exploded(state, "negatives")).select("user_id", "paper_id").distinct()


def _folded(events: DataFrame, vectors: DataFrame, kind: str, each: bool) -> DataFrame:
    """``user_id``, ``timestamp``, ``id``, ``profile``, ``n`` after each of a user's events, or the last one alone.

    A user's events lie together in order; the fold holds one vector, however long the log is.
    """
    alpha, event = ALPHA[kind], "not_interested" if kind == "negative" else "save"
    own = events.where((F.col("event_type") == event) & F.col("user_id").isNotNull())
    own = own.join(vectors.select("paper_id", "embedding").where("embedding IS NOT NULL"), "paper_id").select("user_id", "timestamp", "id", "embedding")

    def fold(batches):
        user, profile, n, last = None, np.zeros(0), 0, None
        for batch in batches:
            out = []
            for u, at, i, row in zip(*(batch[c].tolist() for c in ("user_id", "timestamp", "id", "embedding")), strict=True):
                if u != user and last is not None:
                    out += [] if each else [last]
                    profile, n = np.zeros(0), 0
                row = np.asarray(row, dtype=float)
                blended = (1 - alpha) * profile + alpha * row if len(profile) else row
                size = np.sqrt((blended * blended).sum())
                profile = blended / size if size >= 1e-10 else profile
                user, n = u, n + 1
                last = (u, at, i, profile, n)
                out += [last] if each else []
            yield pd.DataFrame(out, columns=["user_id", "timestamp", "id", "profile", "n"])
        if last is not None and not each:
            yield pd.DataFrame([last], columns=["user_id", "timestamp", "id", "profile", "n"])

    schema = own.drop("embedding").schema.add("profile", T.ArrayType(T.DoubleType())).add("n", "long")
    return own.repartition("user_id").sortWithinPartitions("user_id", "timestamp", "id").mapInPandas(fold, schema)


def ewma_profile(events: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """``user_id``, ``profile``, ``n``: exponentially weighted unit vector over saves (dismissals for ``negative``).

    Events whose paper has no vector are left out, as are those without a user.  An update to the zero vector keeps what was there.
    """
    return _folded(events, vectors, kind, each=False).select("user_id", "profile", "n")


def profile_history(events: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """``user_id``, ``timestamp``, ``profile``, ``n``: the profile as it was after each event that changed it."""
    return _folded(events, vectors, kind, each=True).drop("id")


def suppressed_categories(events: DataFrame, papers: DataFrame, as_of: str, days: int = 14, least: int = 3) -> DataFrame:
    """``user_id``, ``category``, ``n``: categories dismissed at least so often in the days before ``as_of``."""
    own = events.where((F.col("event_type") == "not_interested") & (F.col("timestamp") >= F.expr(f"timestamp_ntz'{as_of}' - interval {days} days")))
    named = own.join(papers.select("paper_id", "category").where("category <> ''"), "paper_id")
    return named.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def tiers(state: DataFrame, profiles: DataFrame) -> DataFrame:
    """``user_id``, ``tier``: 1 with enough saves to cluster, 2 with a long-term profile, 3 with a save, else 0."""
    n = F.size("positives")
    tier = F.when(n >= MIN_CLUSTER_SAVES, 1).when(F.coalesce("n", F.lit(0)) >= MIN_EWMA_SAVES, 2).when(n >= 1, 3).otherwise(0)
    return state.join(profiles.select("user_id", "n"), "user_id", "left").select("user_id", tier.alias("tier"))


def onboarding_status(users: DataFrame, onboarding: DataFrame, events: DataFrame) -> DataFrame:
    """``user_id``, ``status``: complete (also by any event), in_progress (row without completion) or new."""
    active = events.select("user_id").distinct().withColumn("active", F.lit(True))
    status = F.when(F.coalesce("completed", F.lit(False)) | F.coalesce("active", F.lit(False)), "complete").when(F.col("completed").isNotNull(), "in_progress").otherwise("new")
    return users.join(onboarding, "user_id", "left").join(active, "user_id", "left").select("user_id", status.alias("status"))
