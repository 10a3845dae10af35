"""Exact top-k inner-product search by pivot-table elimination.

Vectors are packed in blocks, each with a table of distances to fixed pivots.  Inner products become distances by one
more coordinate: with M the largest norm of a block, x is extended by sqrt(M*M - |x|*|x|) and a query by 0, so
distance**2 = |q|**2 + M**2 - 2 q.x.  For a query, the largest difference of its and a candidate's pivot distances
is a lower bound of their distance; candidates are evaluated in the order of this bound until it exceeds the k-th best
distance.  A query's k-th best score among a few fixed rows is a floor from the start.  Blocks hold rows near the same
pivot; a block of queries meets a block of candidates only if their ranges of pivot distances let some pair reach the
floor, and the best of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batches, staged

PIVOTS = 24
BLOCK_ROWS = 4096
QUERY_ROWS = 256
#: Rows whose scores give each query's first floor; the floor changes what is evaluated, never what is found.
SCOUTS = 1024
#: Parts in which summaries of blocks meet.
_PARTS = 64
#: Pairs of blocks in a batch handed to Python; each holds a few MB.
BATCH_BLOCKS = 8
#: Candidates evaluated between two looks at the bound.
_STEP = 512


def quantise(column: str):
    """floor(256 * x) of every component, or null where the vector is null, empty or holds null or non-finite components."""
    x = F.col(column)
    bad = x.isNull() | (F.size(x) == 0) | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")))


def _matrix(rows) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in rows])


def _fixed_rows(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors with the smallest digests of their ids: a fixed small number, the same for any order of the input.

    The first of them are the pivots, all are scouts."""
    chosen = vectors.where(F.size("v") == dim).orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "v").limit(SCOUTS).collect()
    return np.array([r["vec_id"] for r in chosen], dtype=np.int64), _matrix(r["v"] for r in chosen)


def _distances(rows: np.ndarray, pivots: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Distances to the pivots (extended by 0) of rows extended by a coordinate with the square ``extra``."""
    square = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0) + extra[:, None])


def _exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; floats hold them exactly as long as no sum can pass 2**53."""
    if float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query) < 2.0**53:
        return (rows.astype(float) @ query.astype(float)).astype(np.int64)
    return rows @ query


def _floors(ids: np.ndarray, rows: np.ndarray, scout_ids: np.ndarray, scouts: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the scouts that are not itself; none where they are too few."""
    out = np.full(len(ids), -np.inf)
    for i, (own, row) in enumerate(zip(ids, rows, strict=True)):
        scores = _exact_scores(scouts, row)[scout_ids != own]
        if len(scores) >= k:
            out[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
    return out


def _best(query_id: int, query: np.ndarray, reach: np.ndarray, block: dict, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's k best for one query, ties to smaller ids; scores below the floor may be missing."""
    bound = np.abs(block["table"] - reach).max(axis=1)
    order = np.argsort(bound, kind="stable")
    limit = float((query.astype(float) ** 2).sum() + block["most"])
    ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for at in range(0, len(order), _STEP):
        known = max(floor, float(scores[-1])) if len(scores) == k else floor
        if known > -np.inf:
            # The k-th best distance, with room for rounding: whoever is farther can't tie.
            worst = np.sqrt(max(limit - 2 * known, 0.0))
            if bound[order[at]] > worst + 1e-6 * (1 + np.sqrt(limit)):
                break
        own = order[at : at + _STEP]
        own = own[block["ids"][own] != query_id]
        ids = np.concatenate([ids, block["ids"][own]])
        scores = np.concatenate([scores, _exact_scores(block["rows"][own], query)])
        top = np.lexsort([ids, -scores])[:k]
        ids, scores = ids[top], scores[top]
    return ids, scores


def _worth_meeting(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(``query_block``, ``block``) whose summaries let some query's score reach its floor.

    The distance of any two is at least the gap between their ranges at each pivot, which bounds their inner product.
    Summaries are a few hundred bytes for thousands of rows; they meet in parts, not in one task.
    """
    left = queries.select("dim", "query_block", F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("most").alias("q_most"), "floor", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part"))
    right = candidates.select("dim", "block", "low", "high", "most", F.pmod(F.xxhash64("block"), F.lit(_PARTS)).cast("int").alias("part"))
    gaps = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("q_low", "q_high"), lambda c, q: F.greatest(c["low"] - q["q_high"], q["q_low"] - c["high"], F.lit(0.0)))
    gap = F.array_max(gaps)
    room = 1e-6 * (1 + F.col("most") + F.col("q_most"))
    return left.join(right, ["dim", "part"]).where((F.col("q_most") + F.col("most") - gap * gap) / 2 + room >= F.col("floor")).select("query_block", "block")


def top_k(table: DataFrame, queries_where: str = "vec_id % 50 = 0", k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's k best among all rows but its own.

    ``queries_where`` is a condition on ``vec_id``.  Scores are inner products of the quantised vectors; ties go to
    smaller ids; fewer than k candidates give fewer rows.  Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows without an id.  A vector is compared with those of its own dimension.  Repeated
    rows are candidates each; a query id that occurs repeatedly is answered for each of its rows, and its rows are not
    its own candidates.  An empty table gives no rows.
    """
    vectors = table.select(F.col(key).cast("long").alias("vec_id"), quantise(vector).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    vectors = staged(vectors, "topk-vectors")
    dims = [r["d"] for r in vectors.select(F.size("v").alias("d")).distinct().collect()]
    fixed = {d: _fixed_rows(vectors, d) for d in dims}
    pivots = {d: rows[:PIVOTS].astype(float) for d, (_, rows) in fixed.items()}
    schema = "dim int, n int, ids binary, rows binary, distances binary, floors binary, low array<double>, high array<double>, most double, floor double"

    def near(batches):
        for batch in batches:
            place = np.zeros(len(batch), dtype=np.int32)
            sizes = batch["v"].map(len).to_numpy()
            for dim in np.unique(sizes):
                rows = _matrix(batch["v"][sizes == dim]).astype(float)
                place[sizes == dim] = _distances(rows, pivots[dim], np.zeros(len(rows))).argmin(axis=1)
            yield batch.assign(near=place)

    def pack(rows_per_block: int, extended: bool):
        def step(batches):
            for batch in batches:
                for dim, own in batch.groupby(batch["v"].map(len)):
                    for at in range(0, len(own), rows_per_block):
                        part = own.iloc[at : at + rows_per_block]
                        rows, ids = _matrix(part["v"]), part["vec_id"].to_numpy(np.int64)
                        norms = (rows.astype(float) ** 2).sum(axis=1)
                        most = float(norms.max())
                        far = _distances(rows.astype(float), pivots[dim], most - norms if extended else np.zeros(len(rows)))
                        floors = np.zeros(0) if extended else _floors(ids, rows, *fixed[dim], k)
                        packed = {"ids": ids, "rows": rows, "distances": far, "floors": floors}
                        yield pd.DataFrame([{"dim": dim, "n": len(rows), **{c: x.tobytes() for c, x in packed.items()}, "low": far.min(axis=0), "high": far.max(axis=0), "most": most, "floor": floors.min(initial=np.inf)}])

        return step

    # Rows near the same pivot lie together within a task, so blocks are narrow; nothing is exchanged for it.
    placed = vectors.mapInPandas(near, "vec_id long, v array<long>, near int").sortWithinPartitions("near", "vec_id")
    candidates = placed.mapInPandas(pack(BLOCK_ROWS, True), schema).withColumn("block", F.monotonically_increasing_id())
    candidates = staged(candidates, "topk-candidates")
    queries = placed.where(queries_where).mapInPandas(pack(QUERY_ROWS, False), schema)
    queries = staged(queries.withColumn("query_block", F.monotonically_increasing_id()), "topk-queries")
    pairs = _worth_meeting(candidates, queries)
    sent = queries.join(pairs, "query_block").select("query_block", "block", *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "rows", "distances", "floors")])
    met = candidates.join(sent, "block").select("dim", "n", "ids", "rows", "distances", "most", "query_block", *[f"q_{c}" for c in ("n", "ids", "rows", "distances", "floors")])

    def search(batches):
        for batch in batches:
            for r in batch.itertuples():
                block = {
                    "ids": np.frombuffer(r.ids, dtype=np.int64),
                    "rows": np.frombuffer(r.rows, dtype=np.int64).reshape(r.n, r.dim),
                    "table": np.frombuffer(r.distances).reshape(r.n, -1),
                    "most": r.most,
                }
                ids = np.frombuffer(r.q_ids, dtype=np.int64)
                rows, reach = np.frombuffer(r.q_rows, dtype=np.int64).reshape(r.q_n, r.dim), np.frombuffer(r.q_distances).reshape(r.q_n, -1)
                floors = np.frombuffer(r.q_floors)
                found = [_best(int(ids[i]), rows[i], reach[i], block, k, floors[i]) for i in range(r.q_n)]
                sizes = [len(x) for x, _ in found]
                yield pd.DataFrame(
                    {
                        "query_block": r.query_block, "place": np.repeat(np.arange(r.q_n), sizes), "query_id": np.repeat(ids, sizes),
                        "vec_id": np.concatenate([x for x, _ in found]), "score": np.concatenate([s for _, s in found]),
                    }
                )

    best = met.mapInPandas(search, "query_block long, place int, query_id long, vec_id long, score long")
    with arrow_batches(table.sparkSession, BATCH_BLOCKS):
        best = staged(best, "topk-best")
    rank = F.row_number().over(W.partitionBy("query_block", "place").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
