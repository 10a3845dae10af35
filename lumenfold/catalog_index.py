"""Registered queries over stored indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _DENSE_SQL, query
from .functions import ann
from .sources.tables import vectors as vector_table

#: Every hundredth vector asks.
_ASKED_SQL = _DENSE_SQL.replace("FROM vectors q", "FROM (SELECT * FROM vectors WHERE paper_id % 100 = 0) q")


def _asked(spark, sf):
    return vector_table(spark, sf).where("paper_id % 100 = 0").select(F.col("paper_id").alias("query_id"), "embedding")


def _index(spark, sf, k: int, target: float):
    """(index over all vectors, cells to read)."""
    items = vector_table(spark, sf)
    index = ann.DenseIndex(spark, ann.build_index(items))
    return index, index.calibrated(items, k, target)


@query("dense_topk_ann")
def dense_topk_ann(spark, sf):
    """Approximate: its recall is measured against ``dense_topk`` in the tests."""
    index, probes = _index(spark, sf, 10, 0.97)
    return ann.dense_topk_ann(index, _asked(spark, sf), vector_table(spark, sf), 10, probes).select("query_id", "paper_id", "rank", "score")


@query("dense_topk_certain", f"SELECT query_id, paper_id, rank, score FROM ({_ASKED_SQL}) WHERE rank <= 10", "vectors")
def dense_topk_certain(spark, sf):
    """By the index where its bounds prove the answer, else by the exact search."""
    index, probes = _index(spark, sf, 10, 0.9)
    return ann.dense_topk_ann(index, _asked(spark, sf), vector_table(spark, sf), 10, probes, exact="uncertain").select("query_id", "paper_id", "rank", "score")
