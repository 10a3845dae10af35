"""Interest clusters of a user's saved papers by Ward's method, and stable numbers for them over time.

Both are sequential algorithms over at most a few dozen vectors per user; Spark deals the users over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import by_group, stacked
from ..schemas import CLUSTERS

# Clustering limits.
MIN_PAPERS = 5
MAX_CLUSTERS = 7
MIN_COSINE = 0.5
LAST_MERGE_SHARE = 0.7


def ward_merges(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) in order of height; new clusters are numbered on from the points."""
    n = len(points)
    square = (points**2).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square - 2 * points @ points.T, 0))
    np.fill_diagonal(d, np.inf)
    alive, size, label, merges = list(range(n)), np.ones(n, dtype=int), list(range(n)), []
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        a, b = divmod(int(sub.argmin()), len(alive))
        i, j = sorted((alive[a], alive[b]))
        height = d[i, j]
        k = np.array([x for x in alive if x not in (i, j)], dtype=int)
        d[i, k] = d[k, i] = np.sqrt(((size[k] + size[i]) * d[i, k] ** 2 + (size[k] + size[j]) * d[j, k] ** 2 - size[k] * height**2) / (size[i] + size[j] + size[k]))
        x, y = sorted((label[i], label[j]))
        merges.append((x, y, float(height)))
        size[i] += size[j]
        label[i] = n + len(merges) - 1
        alive.remove(j)
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, threshold: float) -> np.ndarray:
    """Labels from 0 of the clusters below the threshold, numbered in the order in which the tree's leaves are read."""
    children = {n + i: (a, b) for i, (a, b, _) in enumerate(merges)}
    heights = {n + i: h for i, (_, _, h) in enumerate(merges)}
    labels, next_label, stack = np.zeros(n, dtype=int), 0, [2 * n - 2]
    while stack:
        node = stack.pop()
        if node >= n and heights[node] > threshold:
            stack += reversed(children[node])
            continue
        leaves = [node]
        while leaves:
            x = leaves.pop()
            if x < n:
                labels[x] = next_label
            else:
                leaves += children[x]
        next_label += 1
    return labels


def threshold_of(heights: list[float]) -> float:
    """Middle of the largest gap between heights, kept between the first and a share of the last."""
    if len(heights) < 2:
        return heights[0]
    i = int(np.diff(heights).argmax())
    return max(heights[0], min((heights[i] + heights[i + 1]) / 2, heights[-1] * LAST_MERGE_SHARE))


def cluster_one(ids: list, vectors: np.ndarray) -> list[dict]:
    """Clusters of one user's papers, newest first, in order of importance (the sum of 1/(1+position))."""
    n = len(ids)
    medoid = lambda v: int(np.linalg.norm(v - v.mean(axis=0), axis=1).argmin())
    if n < MIN_PAPERS:
        m = medoid(vectors)
        return [{"cluster_idx": 0, "medoid_paper_id": ids[m], "medoid_embedding": vectors[m], "paper_ids": list(ids), "importance": float(n)}]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms < 1e-10, 1.0, norms)
    merges = ward_merges(unit)
    heights = [h for *_, h in merges]
    labels = cut(merges, n, threshold_of(heights))
    if labels.max() >= MAX_CLUSTERS:
        labels = cut(merges, n, heights[n - MAX_CLUSTERS - 1])
    weight, out = 1.0 / (np.arange(n) + 1), []
    for label in range(labels.max() + 1):
        own = np.flatnonzero(labels == label)
        m = own[medoid(unit[own])]
        out.append({"cluster_idx": label, "medoid_paper_id": ids[m], "medoid_embedding": unit[m], "paper_ids": [ids[i] for i in own], "importance": float(weight[own].sum())})
    return sorted(out, key=lambda c: -c["importance"])


def user_clusters(positives: DataFrame) -> DataFrame:
    """Clusters per user from ``user_id``, ``pos``, ``paper_id``, ``embedding``."""
    names = [c.split()[0] for c in CLUSTERS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.float64()]

    def one(own: pa.RecordBatch) -> pa.RecordBatch:
        found = cluster_one(own.column("paper_id").to_pylist(), stacked(own.column("embedding")))
        users = own.column("user_id").slice(0, 1).cast(pa.int64()).take(pa.array([0] * len(found)))
        return pa.RecordBatch.from_arrays([users, *(pa.array([c[n] for c in found], t) for n, t in zip(names[1:], types, strict=True))], names)

    return by_group(positives.select("user_id", "pos", "paper_id", "embedding"), "user_id", ["pos"], one, CLUSTERS)


def best_matching(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, as many as the shorter side has; exact, by subsets of columns."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((b, a) for a, b in best_matching(cost.T))
    best: dict[int, tuple[float, list[tuple[int, int]]]] = {0: (0.0, [])}
    for row in range(cost.shape[0]):
        grown: dict[int, tuple[float, list[tuple[int, int]]]] = {}
        for used, (total, pairs) in best.items():
            for column in range(cost.shape[1]):
                if not used >> column & 1:
                    candidate = (total + cost[row, column], [*pairs, (row, column)])
                    if used | 1 << column not in grown or candidate[0] < grown[used | 1 << column][0]:
                        grown[used | 1 << column] = candidate
        best = grown
    return min(best.values(), key=lambda x: x[0])[1]


def stable_numbers(new: list[tuple[int, np.ndarray]], old: list[tuple[int, np.ndarray]], least: float = MIN_COSINE) -> list[int]:
    """Numbers for the new clusters: that of the matched old one if near enough, else the lowest free number."""
    if not new or not old:
        return [i for i, _ in new]
    unit = lambda rows: np.stack([v / max(np.linalg.norm(v), 1e-10) for _, v in rows])
    near = unit(new) @ unit(old).T
    kept = {a: old[b][0] for a, b in best_matching(1 - near) if near[a, b] >= least}
    used, out = set(kept.values()), []
    for a in range(len(new)):
        if a not in kept:
            kept[a] = next(i for i in range(len(new) + len(old) + 1) if i not in used)
            used.add(kept[a])
        out.append(kept[a])
    return out


def stabilise(new: DataFrame, old: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """``new`` (as of ``user_clusters``) with each user's clusters renumbered after ``old`` (``user_id``, ``cluster_idx``, ``medoid_embedding``).

    Clusters are matched in order of importance, whatever the order of the rows.
    """
    columns = new.columns
    before = old.select("user_id", "cluster_idx", "medoid_embedding").withColumn("__old", F.lit(True))
    both = new.withColumn("__old", F.lit(False)).unionByName(before, allowMissingColumns=True)

    def one(own: pa.RecordBatch) -> pa.RecordBatch:
        n = int((~own.column("__old").to_numpy(zero_copy_only=False)).sum())
        rows = list(zip(own.column("cluster_idx").to_pylist(), stacked(own.column("medoid_embedding")), strict=True))
        fresh = own.select(columns).slice(0, n)
        at = columns.index("cluster_idx")
        return fresh.set_column(at, fresh.schema.field(at), pa.array(stable_numbers(rows[:n], rows[n:], least), fresh.schema.field(at).type))

    return by_group(both, "user_id", ["__old", F.desc("importance"), "cluster_idx"], one, new.schema)
