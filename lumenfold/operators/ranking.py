"""Feature re-ranking, suppression, diversity, exploration and tags for candidates of many users at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.vectors import by_group, cosines, places, runs, stacked
from ..sources.staging import staged

# Feature weights, decay and diversity.
WEIGHTS = {"lt": 0.40, "st": 0.25, "recency": 0.15, "rank": 0.10, "negative": 0.15}
DECAY = 0.002
MMR_LAMBDA = 0.6
EXPLORE = 2
#: Items, and examples, that meet at once; numbers in the vectors of the items that a task holds (64 MB).
ITEM_BLOCK, EXAMPLE_BLOCK, ITEM_NUMBERS = 2048, 256, 1 << 23
#: Numbers in the vectors of the examples that meet at once, where vectors are long.
EXAMPLE_NUMBERS = 1 << 21


def features(candidates: DataFrame, profiles: DataFrame, as_of: str) -> DataFrame:
    """Candidates (``user_id``, ``paper_id``, ``position`` from 0, ``embedding``, ``published``) with their five features.

    ``profiles`` has ``user_id``, ``lt``, ``st``, ``neg``; a missing profile gives similarity 0.
    """
    joined = candidates.join(profiles, "user_id", "left")
    similar = cosines("embedding", "lt", "st", "neg")
    rows = joined.select(*candidates.columns, similar.alias("__similar"), scalars.age_days(F.col("published"), as_of).alias("age"))
    return rows.select(*candidates.columns, "__similar.lt_sim", "__similar.st_sim", "age", "__similar.neg_sim")


def rerank(featured: DataFrame) -> DataFrame:
    """``score`` and ``rank`` within the user; ties by position."""
    all_ = W.partitionBy("user_id")
    confidence = 1 - F.col("position") / (F.max("position").over(all_) + 1)
    score = (
        WEIGHTS["lt"] * F.col("lt_sim") + WEIGHTS["st"] * F.col("st_sim") + WEIGHTS["recency"] * F.exp(-DECAY * F.col("age"))
        + WEIGHTS["rank"] * confidence - WEIGHTS["negative"] * F.greatest(F.col("neg_sim"), F.lit(0.0))
    )
    scored = featured.withColumn("score", F.round(score, 9))
    return scored.withColumn("rank", F.row_number().over(all_.orderBy(F.desc("score"), "position")))


def drop_suppressed(ranked: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Candidates outside their user's suppressed categories; all of them, if none would remain."""
    marked = ranked.join(suppressed.select("user_id", "category").withColumn("__bad", F.lit(True)), ["user_id", "category"], "left")
    left = F.sum(F.col("__bad").isNull().cast("int")).over(W.partitionBy("user_id"))
    return marked.withColumn("__left", left).where(F.col("__bad").isNull() | (F.col("__left") == 0)).drop("__bad", "__left")


def relevance(scored: DataFrame, group: str = "user_id") -> DataFrame:
    """Scores scaled to 0..1 within the group; all 1 where they are equal."""
    low, high = F.min("score").over(W.partitionBy(group)), F.max("score").over(W.partitionBy(group))
    return scored.withColumn("relevance", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def mmr(candidates: DataFrame, k: int, weight: float = MMR_LAMBDA, group: str = "user_id") -> DataFrame:
    """``mmr_rank`` of the k candidates chosen greedily for relevance and difference from those chosen before.

    Candidates have ``paper_id``, ``rank``, ``score``, ``embedding``.  Groups of at most k stay in their order.  A
    group's candidates are what quotas let through, so they fit a task.
    """
    key_type = dict(candidates.dtypes)[group]

    def choose(own: pa.RecordBatch) -> pa.RecordBatch:
        n, picked = len(own), []
        if n <= k:
            picked = list(range(n))
        else:
            v = stacked(own.column("embedding"))
            unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)
            near = np.round(unit @ unit.T, 9)
            score = own.column("score").to_numpy(zero_copy_only=False).astype(float)
            spread = score.max() - score.min()
            rel = (score - score.min()) / spread if spread else np.ones(n)
            closest, left = np.zeros(n), np.ones(n, dtype=bool)
            for _ in range(k):
                value = np.where(left, np.round(weight * rel - (1 - weight) * closest, 9), -np.inf)
                i = int(value.argmax())
                picked.append(i)
                left[i] = False
                closest = near[i] if len(picked) == 1 else np.maximum(closest, near[i])
        chosen = own.select([group, "paper_id"]).take(pa.array(picked, pa.int64()))
        return chosen.append_column("mmr_rank", pa.array(np.arange(1, len(picked) + 1), pa.int32()))

    rows = candidates.select(group, F.col("paper_id").cast("long").alias("paper_id"), "rank", "score", "embedding")
    return by_group(rows, group, ["rank"], choose, f"{group} {key_type}, paper_id long, mmr_rank int")


def explore(selected: DataFrame, candidates: DataFrame, n: int = EXPLORE, seed: str = "0", group: str = "user_id") -> DataFrame:
    """``n`` candidates that were not selected, by hash order of (group, id, seed): the same in every run."""
    left = candidates.select(group, "paper_id").join(selected.select(group, "paper_id"), [group, "paper_id"], "left_anti")
    draw = F.md5(F.concat_ws("|", F.col(group).cast("string"), F.col("paper_id").cast("string"), F.lit(seed)))
    return left.withColumn("explore_rank", F.row_number().over(W.partitionBy(group).orderBy(draw))).where(F.col("explore_rank") <= n)


# The share of exploring slots at first, its factor per list served, and the least.
EPSILON, EPSILON_DECAY, LEAST_EPSILON = 0.1, 0.999, 0.05


def decayed_epsilon(served: Column, epsilon: float = EPSILON, decay: float = EPSILON_DECAY, least: float = LEAST_EPSILON) -> Column:
    """The share of exploring slots of who was served so many lists (none: null) before; it falls with each."""
    return F.greatest(F.lit(least), F.lit(epsilon) * F.pow(F.lit(decay), F.coalesce(served, F.lit(0)))).cast("double")


def epsilon_greedy(ranked: DataFrame, k: int, epsilon: float | Column = EPSILON, seed: str = "0", group: str = "user_id") -> DataFrame:
    """``slot`` (1 to k), ``paper_id``, ``explored``: each slot explores with probability ``epsilon``, by a hash of group and slot.

    ``epsilon`` may be a column of ``ranked``, one value in a group (``decayed_epsilon``).  Slots that exploit take the best rows in order; those that explore take rows beyond the first k in hash order, and
    the next best ones where there are none.
    """
    fraction = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0
    key = F.col(group).cast("string")
    share = epsilon if isinstance(epsilon, Column) else F.lit(epsilon)
    slots = ranked.select(group, share.alias("epsilon")).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(k))))
    slots = slots.withColumn("explored", fraction(key, F.col("slot").cast("string"), F.lit(seed)) < F.col("epsilon")).drop("epsilon")
    order = W.partitionBy(group).orderBy("slot")
    n = F.count_if("explored").over(order)
    slots = slots.withColumns({"explores": n, "exploits": F.col("slot") - n})
    draw = F.md5(F.concat_ws("|", key, F.col("paper_id").cast("string"), F.lit(seed)))
    beyond = ranked.where(F.col("rank") > k).select(group, "paper_id", F.row_number().over(W.partitionBy(group).orderBy(draw)).alias("explores"))
    filled = slots.join(beyond.withColumnRenamed("paper_id", "new"), [group, "explores"], "left").withColumn("explored", F.col("explored") & F.col("new").isNotNull())
    filled = filled.withColumn("exploits", F.col("slot") - F.count_if("explored").over(order))
    best = ranked.where(F.col("rank") <= k).select(group, F.col("rank").alias("exploits"), "paper_id")
    filled = filled.join(best, [group, "exploits"], "left")
    paper = F.when(F.col("explored"), F.col("new")).otherwise(F.col("paper_id"))
    return filled.select(group, "slot", paper.alias("paper_id"), "explored").where("paper_id IS NOT NULL")


FEATURES = ["lt_sim", "st_sim", "neg_sim", "age", "position"]


def learned_rerank(featured: DataFrame, labels: DataFrame, rounds: int = 20) -> DataFrame:
    """``rank`` by gradient-boosted trees fitted on ``labels`` (``user_id``, ``paper_id``, ``label`` 0 or 1) over the features.

    A stand-in for a pairwise learned ranker; candidates without a label are ranked too.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(featured.select("user_id", "paper_id", *FEATURES))
    known = rows.join(labels.select("user_id", "paper_id", F.col("label").cast("double").alias("label")), ["user_id", "paper_id"])
    model = GBTRegressor(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=3, seed=0).fit(known)
    scored = model.transform(rows.select("user_id", "paper_id", "position", "x")).withColumnRenamed("prediction", "score")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "position"))
    return scored.select("user_id", "paper_id", "score", rank.alias("rank"))


def factorised(affinity: DataFrame, k: int, dims: int = 16, rounds: int = 5) -> DataFrame:
    """``user_id``, ``paper_id``, ``rank``: the k best papers per user by matrix factorisation of positive ``affinity``."""
    from pyspark.ml.recommendation import ALS

    positive = affinity.where("affinity > 0 AND user_id IS NOT NULL AND paper_id IS NOT NULL").select("user_id", "paper_id", F.col("affinity").cast("float").alias("affinity"))
    users, items = numbered(positive, "user_id", "u"), numbered(positive, "paper_id", "i")
    rows = positive.join(users, "user_id").join(items, "paper_id").select("u", "i", "affinity")
    model = ALS(rank=dims, maxIter=rounds, implicitPrefs=True, seed=0, userCol="u", itemCol="i", ratingCol="affinity").fit(rows)
    found = model.recommendForAllUsers(k).select("u", F.posexplode("recommendations").alias("at", "r")).select("u", F.col("r.i").alias("i"), (F.col("at") + 1).alias("rank"))
    return found.join(users, "u").join(items, "i").select("user_id", "paper_id", "rank")


def numbered(table: DataFrame, key: str, name: str) -> DataFrame:
    """``key``, ``name``: the distinct keys numbered from 0 without gaps, whatever the keys are.

    Each task numbers its own; where a task starts follows from the counts, a row per task.
    """
    ids = staged(table.select(key).distinct().withColumn("own", F.monotonically_increasing_id()), "numbered").withColumn("task", F.shiftright("own", 33))
    counts = ids.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("start"))
    within = F.col("own") - F.shiftleft(F.col("task"), 33)
    return ids.join(F.broadcast(starts), "task").select(key, (F.col("start") + within).cast("int").alias(name))


def best_score(examples: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``paper_id``, ``score``, ``rank``: items nearest to any positive example and not nearer a negative.

    ``examples``: ``query_id``, ``paper_id``, ``embedding``, ``positive``.  The score is the best positive similarity if it
    beats the best negative one, else minus the square of the latter.  Examples themselves are not returned; queries
    without positives give no rows, rows without an id take no part, repeated rows count once.  A task holds some items, at most
    ``ITEM_NUMBERS`` numbers about, and the examples of some queries stream past them, a query's one after the other, however many
    they are; what leaves it is each query's k best of its items.
    """
    examples, items = examples.where("query_id IS NOT NULL AND paper_id IS NOT NULL"), items.where("paper_id IS NOT NULL")
    n, size = items.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    m, asked = examples.agg(F.count(F.lit(1)), F.approx_count_distinct("query_id")).first()
    # Few queries meet all items in every task; more are dealt too, so that as little as can be is sent twice.
    tasks = 2 * items.sparkSession.sparkContext.defaultParallelism
    wanted = tasks if asked < 4 * tasks else round((tasks * n / max(m, 1)) ** 0.5)
    parts = max(1, min(wanted, tasks, n), -(-n * (size or 0) // ITEM_NUMBERS))
    groups = 1 if asked < 4 * tasks else -(-tasks // parts)
    step = max(1, min(EXAMPLE_BLOCK, EXAMPLE_NUMBERS // max(size or 0, 1)))
    dealt = lambda key, among: F.pmod(F.xxhash64(key), F.lit(among)).cast("int")
    every = lambda among: F.explode(F.sequence(F.lit(0), F.lit(among - 1)))
    held = items.select(dealt("paper_id", parts).alias("part"), every(groups).alias("group"), F.lit(None).cast("long").alias("query_id"), F.col("paper_id").cast("long"), "embedding", F.lit(None).cast("boolean").alias("positive"))
    sent = examples.select(every(parts).alias("part"), dealt("query_id", groups).alias("group"), F.col("query_id").cast("long"), F.col("paper_id").cast("long"), "embedding", "positive")
    both = held.unionByName(sent).withColumn("number", F.col("part") * groups + F.col("group")).drop("part", "group")
    # A task's items come first, in order, then the examples query by query.
    ordered = both.repartitionById(parts * groups, "number").sortWithinPartitions("number", F.col("query_id").isNotNull(), "query_id", "paper_id")

    def best(query: int, names: np.ndarray, good: np.ndarray, bad: np.ndarray, known: np.ndarray):
        good, bad = np.round(good, 9), np.maximum(np.round(bad, 9), -1.0)
        value = np.round(np.where(good > bad, good, -bad * bad), 9)
        left = np.flatnonzero(~known)
        if len(left) > k:
            left = left[value[left] >= np.partition(value[left], len(left) - k)[len(left) - k]]
        top = left[np.lexsort([names[left], -value[left]])[:k]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(top), query), names[top], value[top])], ["query_id", "paper_id", "score"])

    def stream(batches):
        number, query, waiting = None, None, []
        names, rows, near, known = np.zeros(0, dtype=np.int64), np.zeros((0, 0)), np.zeros((2, 0)), np.zeros(0, dtype=bool)

        def answer():
            # Without a positive example there is no answer.
            if query is not None and len(names) and np.isfinite(near[0]).any():
                yield best(query, names, *near, known)

        for batch in batches:
            numbers, isitem = batch.column("number").to_numpy(), batch.column("query_id").is_null().to_numpy(zero_copy_only=False)
            asks = batch.column("query_id").fill_null(0).to_numpy()
            for own in runs(numbers, isitem, asks):
                part = batch.slice(own.start, own.stop - own.start)
                if numbers[own.start] != number:
                    yield from answer()
                    number, query, waiting, names = numbers[own.start], None, [], np.zeros(0, dtype=np.int64)
                if isitem[own.start]:
                    waiting.append((part.column("paper_id").to_numpy(), stacked(part.column("embedding"))))
                    continue
                if waiting:
                    names, rows = (np.concatenate([w[i] for w in waiting]) for i in range(2))
                    waiting = []
                if not len(names):
                    continue
                if asks[own.start] != query:
                    yield from answer()
                    query, near, known = asks[own.start], np.full((2, len(names)), -np.inf), np.zeros(len(names), dtype=bool)
                known[places(names, part.column("paper_id").to_numpy())[1]] = True
                vectors, positive = stacked(part.column("embedding")), part.column("positive").to_numpy(zero_copy_only=False).astype(bool)
                for side, examples_ in enumerate((vectors[positive], vectors[~positive])):
                    for low in range(0, len(examples_), step):
                        for at in range(0, len(names), ITEM_BLOCK):
                            here = slice(at, at + ITEM_BLOCK)
                            np.maximum(near[side, here], (examples_[low : low + step] @ rows[here].T).max(axis=0), out=near[side, here])
        yield from answer()

    found = ordered.select("number", "query_id", "paper_id", "embedding", "positive").mapInArrow(stream, "query_id long, paper_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "paper_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
