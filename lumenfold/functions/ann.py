"""Approximate dense search by an inverted file: cells around centroids, residuals as 8-bit codes, exact re-scoring.

An index is two Parquet tables, written once and read by any number of searches: ``cells`` (centroid, rows, radius) and
``blocks`` (codes of up to some thousand rows of one cell).  A query reads the cells whose centres have the largest inner products with it; the best rows by code are
scored again with their vectors.  Every query learns whether its answer is certain, from bounds on the cells and rows it
did not look at, and those that are not may be answered by the exact search.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import shared_root, staged
from .vectors import dense_topk, dot

#: Numbers in the sample that centroids are fitted on (its rows are this many over the dimension), and cells at most.
SAMPLE_NUMBERS, MAX_CELLS = 8_000_000, 4096
#: Rows of a cell, and queries that read it, which meet in one task.
CELL_ROWS, CELL_QUERIES = 32768, 2048
BLOCK_ROWS = 4096
#: Queries whose cells are listed at once: each is repeated for every cell it reads.
PROBED = 16
#: Queries of a task that are scored at once.
SCORED = 256
#: Rows by code that are scored exactly, for each row returned.
REFINE = 4
#: Pairs of query and row that may be broadcast to be scored where the vectors lie.
BROADCAST_ROWS = 200_000
#: Queries that tell how many cells must be read.
CALIBRATION = 128


def _usable(vectors: DataFrame, item: str, vector: str, dim: int) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    sound = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(item).isNotNull() & sound).select(F.col(item).cast("long").alias(item), v.alias(vector))


def _sampled(key: str, one_in: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(one_in)) == 0


def _centroids(rows: DataFrame, item: str, vector: str, n: int, dim: int, cells: int) -> np.ndarray:
    """Centres of a bounded sample, which the hashes of the ids choose."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    one_in = -(-n * dim // SAMPLE_NUMBERS)
    sample = staged(rows.where(_sampled(item, max(1, one_in))).select(array_to_vector(vector).alias("features")), "ann-sample")
    if sample.limit(cells + 1).count() <= cells:  # too few to group: every row of the sample is a centre
        return np.array([r["features"].toArray() for r in sample.distinct().collect()])
    return np.array(KMeans(k=cells, maxIter=8, seed=1).fit(sample).clusterCenters())


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def build_index(vectors: DataFrame, item: str = "paper_id", vector: str = "embedding", cells: int | None = None, path: str | None = None) -> str:
    """Writes the index of ``vectors`` to ``path`` (below the shared folder if none is given) and returns it.

    All rows are indexed, those without an id, or with a vector that is null, not finite or not of the commonest
    dimension apart.  ``cells`` is about the root of the rows unless given.
    """
    sizes = vectors.where(F.col(item).isNotNull()).groupBy(F.size(vector).alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").first()
    path = path or f"{shared_root(vectors.sparkSession)}/lumenfold/index-{uuid.uuid4().hex}"
    dim = sizes["dim"] if sizes else 0
    rows = _usable(vectors, item, vector, dim)
    n = sizes["count"] if sizes else 0
    wanted = max(2, min(MAX_CELLS, cells or round(n**0.5)))
    centres = _centroids(rows, item, vector, n, dim, wanted) if n else np.zeros((0, 0))

    def encode(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector]).astype(float)
                cell = _nearest(x, centres)
                rest = x - centres[cell]
                scale = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-300)
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(rest - codes * scale[:, None], axis=1)
                yield pd.DataFrame({"cell": cell, "id": batch[item].to_numpy(np.int64), "code": [c.tobytes() for c in codes], "scale": scale, "error": error, "far": np.linalg.norm(rest, axis=1)})

    coded = "cell int, id long, code binary, scale double, error double, far double"
    codes = staged(rows.mapInPandas(encode, coded), "ann-codes") if n else vectors.sparkSession.createDataFrame([], coded)
    counts = codes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max("error").alias("error"))
    table = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    table.join(counts, "cell", "left").na.fill(0).withColumn("parts", F.ceil(F.col("n") / CELL_ROWS).cast("int")).coalesce(1).write.parquet(f"{path}/cells")
    parts = vectors.sparkSession.read.parquet(f"{path}/cells").select("cell", "parts")
    # The cells are at most MAX_CELLS rows; a frequent cell is dealt in parts.
    dealt = codes.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.greatest("parts", F.lit(1))).cast("int"))

    def pack(batches):
        for batch in batches:
            for (cell, part), own in batch.groupby(["cell", "part"], sort=False):
                for at in range(0, len(own), BLOCK_ROWS):
                    b = own.iloc[at : at + BLOCK_ROWS]
                    yield pd.DataFrame([{"cell": cell, "part": part, "ids": b["id"].to_numpy(np.int64).tobytes(), "codes": b"".join(b["code"]), "scales": b["scale"].to_numpy(float).tobytes()}])

    packed = dealt.select("cell", "part", "id", "code", "scale").repartition("cell", "part").sortWithinPartitions("cell", "part", "id")
    packed.mapInPandas(pack, "cell int, part int, ids binary, codes binary, scales binary").write.parquet(f"{path}/blocks")
    return path


def _order_of_cells(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cells by inner product of each row and their centres, largest first."""
    return np.argsort(-(rows @ centres.T), axis=1, kind="stable")


class DenseIndex:
    """A stored index, open for searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.blocks = spark.read.parquet(f"{path}/blocks")
        own = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MAX_CELLS rows at most
        self.centres = np.array([r["centre"] for r in own])
        self.sizes, self.radius = np.array([r["n"] for r in own]), np.array([r["radius"] for r in own])
        self.error = max((r["error"] for r in own), default=0.0)
        self.parts = [(r["cell"], r["parts"]) for r in own if r["parts"]]

    def stats(self) -> dict:
        """Rows, cells, rows of the largest cell, dimension and bytes a row."""
        dim = self.centres.shape[1] if len(self.centres) else 0
        return {"rows": int(self.sizes.sum()), "cells": len(self.sizes), "largest_cell": int(self.sizes.max(initial=0)), "dim": dim, "row_bytes": dim + 16}

    def calibrated(self, vectors: DataFrame, k: int, target: float = 0.95, item: str = "paper_id", vector: str = "embedding") -> int:
        """The least number of cells that hold ``target`` of the k nearest rows of some fixed rows, which hashes choose."""
        rows = _usable(vectors, item, vector, self.centres.shape[1] if len(self.centres) else 0)
        n = int(self.sizes.sum())
        chosen = rows.where(_sampled(item, max(1, n // CALIBRATION))).select(F.col(item).alias("query_id"), vector)
        chosen = staged(chosen, "ann-calibration")
        truth = dense_topk(chosen, rows, k + 1, item=item, vector=vector).where(F.col("query_id") != F.col(item)).where(F.col("rank") <= k + 1)
        pairs = truth.join(rows, item).select("query_id", F.col(vector).alias("found")).join(chosen, "query_id").select(vector, "found").toPandas()
        if not len(pairs):
            return len(self.sizes)
        order = _order_of_cells(np.stack(pairs[vector]), self.centres)
        home = _nearest(np.stack(pairs["found"]), self.centres)
        needed = np.sort((order == home[:, None]).argmax(axis=1) + 1)
        return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, probes: int, item: str = "paper_id", vector: str = "embedding", refine: int = REFINE) -> DataFrame:
        """``query_id``, ``item``, ``score``, ``rank``, ``certain`` of about each query's k best rows, ties to smaller ids.

        ``probes`` cells are read for each query.  ``certain`` answers are those of the exact search.  Queries without a usable
        vector, and an empty index, give no rows.
        """
        spark, k_codes = queries.sparkSession, k * refine
        if not len(self.sizes):
            return spark.createDataFrame([], f"query_id long, {item} long, score double, rank int, certain boolean")
        centres, radius, sizes = self.centres, self.radius, self.sizes
        asks = staged(_usable(queries, "query_id", vector, centres.shape[1]), "ann-queries")

        def probe(batches):
            for batch in batches:
                for at in range(0, len(batch), PROBED):
                    part = batch.iloc[at : at + PROBED]
                    x = np.stack(part[vector])
                    order = _order_of_cells(x, centres)
                    # An empty cell costs a probe nothing to leave out, and bounds nothing.
                    bound = np.where(sizes > 0, x @ centres.T + np.linalg.norm(x, axis=1)[:, None] * radius, -np.inf)
                    rest = np.take_along_axis(bound, order[:, probes:], axis=1).max(axis=1, initial=-np.inf)
                    near = order[:, :probes]
                    asked = list(np.repeat(x, near.shape[1], axis=0))
                    yield pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(np.int64), near.shape[1]), "cell": near.ravel(), "asked": asked, "unread": np.repeat(rest, near.shape[1])})

        probed = staged(asks.mapInPandas(probe, "query_id long, cell int, asked array<double>, unread double"), "ann-probes")
        parts = F.broadcast(spark.createDataFrame(self.parts, "cell int, parts int"))
        groups = staged(probed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("groups")), "ann-groups")
        numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = probed.join(parts, "cell").join(F.broadcast(groups), "cell").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).withColumn("part", numbers("parts")).drop("parts", "groups", "unread")
        right = self.blocks.join(F.broadcast(groups), "cell").withColumn("group", numbers("groups")).drop("groups")
        place = ["cell", "part", "group"]

        def meet(own: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame({"query_id": pd.Series(dtype=np.int64), "id": pd.Series(dtype=np.int64), "near": pd.Series(dtype=float)})
            if not len(own) or not len(blocks):
                return out
            x = np.stack(own["asked"])
            asked, base = own["query_id"].to_numpy(np.int64), x @ centres[own["cell"].iloc[0]]
            kept: list = []
            for b in blocks.itertuples():
                ids = np.frombuffer(b.ids, np.int64)
                codes, scales = np.frombuffer(b.codes, np.int8).reshape(len(ids), -1).astype(np.float32), np.frombuffer(b.scales)
                for low in range(0, len(x), SCORED):
                    here = slice(low, low + SCORED)
                    near = base[here, None] + (x[here].astype(np.float32) @ codes.T) * scales
                    top = np.argpartition(-near, k_codes - 1, axis=1)[:, :k_codes] if len(ids) > k_codes else np.tile(np.arange(len(ids)), (len(near), 1))
                    kept.append(pd.DataFrame({"query_id": np.repeat(asked[here], top.shape[1]), "id": ids[top].ravel(), "near": np.take_along_axis(near, top, axis=1).ravel()}))
            return pd.concat(kept).sort_values("near", ascending=False, kind="stable").groupby("query_id", sort=False).head(k_codes)

        found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(meet, "query_id long, id long, near double")
        order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "id"))
        short = staged(found.withColumn("place", order).where(F.col("place") <= k_codes), "ann-shortlist")
        pairs = short.select("query_id", F.col("id").alias(item)).join(asks.select("query_id", F.col(vector).alias("asked")), "query_id")
        pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        rows = _usable(vectors, item, vector, centres.shape[1])
        scored = rows.join(pairs, item).select("query_id", item, F.round(dot(F.col("asked"), F.col(vector)), 9).alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), item))
        best = scored.withColumn("rank", rank).where(F.col("rank") <= k)
        # A row left out by its code scores at most its code's value and the largest error; one in an unread cell the cell's bound.
        size = F.sqrt(F.aggregate("asked", F.lit(0.0), lambda s, x: s + x * x))
        unread = probed.groupBy("query_id").agg(F.first("unread").alias("unread"), F.first(size).alias("size"))
        cut = short.where(F.col("place") == k_codes).select("query_id", "near")
        limits = unread.join(cut, "query_id", "left").select("query_id", F.greatest("unread", F.col("near") + F.col("size") * (self.error + 1e-5)).alias("limit"))
        last = W.partitionBy("query_id")
        sure = (F.max("rank").over(last) == k) & (F.min("score").over(last) > F.col("limit") + 1e-8)
        whole = (F.col("limit") == float("-inf")) | F.col("limit").isNull()
        return best.join(limits, "query_id").select("query_id", item, "score", "rank", F.coalesce(sure | whole, F.lit(False)).alias("certain"))


def dense_topk_ann(index: DenseIndex, queries: DataFrame, vectors: DataFrame, k: int, probes: int, exact: str = "short", item: str = "paper_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``item``, ``score``, ``rank``: as ``dense_topk``, by the index.

    Queries that the index gives fewer than k rows for (``exact`` short) or no certain answer (``exact`` uncertain: then all
    answers are exact) are answered by the exact search.
    """
    queries = _usable(queries, "query_id", vector, index.centres.shape[1] if len(index.centres) else 0)
    found = staged(index.search(queries, vectors, k, probes, item, vector), "ann-found")
    done = found.where("certain") if exact == "uncertain" else found.where(F.col("rank") == k)
    done = done.select("query_id").distinct()
    rest = staged(queries.join(done, "query_id", "left_anti"), "ann-rest")
    plain = _usable(vectors, item, vector, index.centres.shape[1] if len(index.centres) else 0)
    columns = ["query_id", item, "score", "rank"]
    return found.join(done, "query_id", "left_semi").select(*columns).union(dense_topk(rest, plain, k, item=item, vector=vector).select(*columns))
