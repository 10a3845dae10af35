"""A learned ranker: boosted trees whose gradients are the changes of nDCG that swaps within a group would make.

Features are cut into bins once.  Each round, groups are taken one by one inside the tasks for their gradients, and a
tree grows level by level from histograms that Spark sums per node, feature and bin; only those reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

BINS = 32
#: Decimals of gradients and gains: sums in any order give the same trees.
_DECIMALS = 9


@dataclass
class Tree:
    """Splits by node (children of i are 2i + 1 and 2i + 2) as (feature, threshold), and the leaves' values."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def node(self, features: str, at: int = 0) -> Column:
        if at not in self.splits:
            return F.lit(at)
        feature, threshold = self.splits[at]
        return F.when(F.col(features)[feature] <= threshold, self.node(features, 2 * at + 1)).otherwise(self.node(features, 2 * at + 2))

    def value(self, features: str, at: int = 0) -> Column:
        if at not in self.splits:
            return F.lit(self.leaves.get(at, 0.0))
        feature, threshold = self.splits[at]
        return F.when(F.col(features)[feature] <= threshold, self.value(features, 2 * at + 1)).otherwise(self.value(features, 2 * at + 2))


def gradients(labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lambda gradient and curvature of each row of one group, over its pairs with different labels."""
    n = len(labels)
    order = np.lexsort([np.arange(n), -scores])
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    discount = 1 / np.log2(place + 2)
    gain = np.exp2(labels) - 1
    best = (np.sort(gain)[::-1] / np.log2(np.arange(n) + 2)).sum()
    if best <= 0:
        return np.zeros(n), np.zeros(n)
    better = labels[:, None] > labels[None, :]
    swap = np.abs((gain[:, None] - gain[None, :]) * (discount[:, None] - discount[None, :])) / best
    rho = 1 / (1 + np.exp(np.clip(scores[:, None] - scores[None, :], -50, 50)))
    push, bend = np.where(better, swap * rho, 0.0), np.where(better, swap * rho * (1 - rho), 0.0)
    return push.sum(axis=1) - push.sum(axis=0), bend.sum(axis=1) + bend.sum(axis=0)


def _edges(rows: DataFrame, n_features: int) -> list[list[float]]:
    """Inner limits of each feature's bins: quantiles of all rows."""
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col("features")[i], shares, 10_000).alias(f"f{i}") for i in range(n_features)]).first()
    return [sorted(set(found[f"f{i}"] or [])) for i in range(n_features)]


def _bin(value: Column, limits: list[float]) -> Column:
    """How many of the limits are below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in limits]), lambda x: x < value)) if limits else F.lit(0)


def _best_splits(histogram: pd.DataFrame, nodes: list[int], least: int) -> dict[int, tuple[int, int]]:
    """(feature, bin) of the largest gain for each node that a split improves; ties to the smaller."""
    found = {}
    for node in nodes:
        best = (1e-9, 0, 0)
        own = histogram[histogram["node"] == node]
        for feature, rows in own.groupby("feature", sort=True):
            rows = rows.sort_values("bin")
            g, h, n = (np.cumsum(rows[c].to_numpy(float)) for c in ("g", "h", "n"))
            score = lambda g, h: g * g / (h + 1e-6)
            gain = np.round(score(g, h) + score(g[-1] - g, h[-1] - h) - score(g[-1], h[-1]), _DECIMALS)
            gain[(n < least) | (n[-1] - n < least)] = -1.0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], int(feature), int(rows["bin"].iloc[at]))
        if best[0] > 1e-9:
            found[node] = best[1:]
    return found


def fit(rows: DataFrame, rounds: int = 8, depth: int = 3, rate: float = 0.3, least: int = 10) -> list[Tree]:
    """Trees fitted on ``rows``: ``group``, ``id`` (unique within it), ``features`` (array<double>, no nulls), ``label`` (0, 1, ...).

    A group holds the candidates shown together, some hundred at most; its pairs are looked at inside a task.  Groups with one
    label teach nothing.  An empty table gives no trees.
    """
    rows = staged(rows.select("group", "id", "features", F.col("label").cast("double").alias("label")), "rank-rows")
    first = rows.select(F.size("features").alias("n")).first()
    if first is None:
        return []
    edges = _edges(rows, first["n"])
    trees: list[Tree] = []
    schema = "features array<double>, g double, h double"

    def lambdas(batches):
        held: list = []

        def flush(out: list):
            labels, scores = (np.array([r[i] for r in held]) for i in (1, 2))
            g, h = gradients(labels, scores)
            out += zip([r[0] for r in held], np.round(g, _DECIMALS), np.round(h, _DECIMALS), strict=True)
            held.clear()

        last = None
        for batch in batches:
            out: list = []
            for group, features, label, score in zip(batch["group"].tolist(), batch["features"].tolist(), batch["label"].tolist(), batch["score"].tolist(), strict=True):
                if held and group != last:
                    flush(out)
                held.append((features, label, score))
                last = group
            yield pd.DataFrame(out, columns=["features", "g", "h"])
        if held:
            out = []
            flush(out)
            yield pd.DataFrame(out, columns=["features", "g", "h"])

    for _ in range(rounds):
        scored = rows.withColumn("group", F.col("group").cast("string")).withColumn("score", F.round(predict(trees, "features", rate), _DECIMALS))
        told = staged(scored.repartition("group").sortWithinPartitions("group", "id").mapInPandas(lambdas, schema), "rank-gradients")
        tree, nodes = Tree(), [0]
        # Bins are places in a short list of limits, so counts per node, feature and bin are few.
        binned = F.array(*[_bin(F.col("features")[i], limits) for i, limits in enumerate(edges)])
        for level in range(depth + 1):
            at = told.select(tree.node("features").alias("node"), F.posexplode(binned).alias("feature", "bin"), "g", "h")
            sums = at.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
            histogram = sums.toPandas()  # nodes x features x bins rows at most
            if level == depth:
                break
            splits = _best_splits(histogram, nodes, least)
            tree.splits |= {n: (f, edges[f][b]) for n, (f, b) in splits.items() if b < len(edges[f])}
            nodes = [c for n in tree.splits for c in (2 * n + 1, 2 * n + 2) if c not in tree.splits]
            if not splits:
                break
        for node, own in histogram[histogram["feature"] == 0].groupby("node"):
            tree.leaves[int(node)] = float(np.round(own["g"].sum() / (own["h"].sum() + 1e-6), _DECIMALS))
        if not tree.splits:
            break
        trees.append(tree)
    return trees


def predict(trees: list[Tree], features: str = "features", rate: float = 0.3) -> Column:
    """The trees' score as an expression of the features: no Python runs for it."""
    score = F.lit(0.0)
    for tree in trees:
        score = score + rate * tree.value(features)
    return score
