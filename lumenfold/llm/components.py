"""Connected components of a table of links: contracted in tasks, then by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Links that a task takes in between two contractions.
LINKS_AT_ONCE = 1_000_000


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node that it reaches over the links ``i`` - ``j``."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fewest links with the same components: each node but the least of its component leads to that one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = least_reachable(len(names), at[: len(a)], at[len(a) :])
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _contracted(links: DataFrame) -> DataFrame:
    """``u`` > ``v``: spanning links of what each task holds, about a million links at a time."""

    def contract(batches):
        u, v, fresh = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            u, v = np.concatenate([u, batch["u"].to_numpy(np.int64)]), np.concatenate([v, batch["v"].to_numpy(np.int64)])
            fresh += len(batch)
            if fresh >= LINKS_AT_ONCE:
                u, v = spanning_links(u, v)
                fresh = 0
                if len(u) >= LINKS_AT_ONCE:
                    yield pd.DataFrame({"u": u, "v": v})
                    u, v = u[:0], v[:0]
        u, v = spanning_links(u, v)
        yield pd.DataFrame({"u": u, "v": v})

    return links.mapInPandas(contract, "u long, v long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of the links but those linked with themselves alone.

    Each task first contracts the links it holds to spanning ones, so a group in which everything is linked with
    everything enters the rounds with few links per node.  Every round is two aggregations and two joins on nodes;
    tables are written to shared storage between rounds, so the lineage stays short and a lost executor costs no round.
    A node with very many links is one row of partial minima before the exchange, and the joins' large partitions may
    be split.
    """
    edges = _contracted(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    edges, state = staged(edges.distinct(), "components"), None
    while True:
        edges = staged(_small_star(_large_star(edges)), "components")
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    # Now every edge leads from a node to the least of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least among it and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
