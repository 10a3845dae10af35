"""Queries whose tasks hold bounded shares: with small bounds they are dealt to more tasks, and their rows stay those of their SQL."""

import pytest
from pyspark.sql import functions as F

from lumenfold import catalog
from lumenfold.functions import postings, sparse, vectors
from lumenfold.sources.tables import read

#: Depth of each query's search of all vectors by all.
DENSE = {
    "citation_rerank": 20,
    "cluster_attribution": 30,
    "exclude_seen": 40,
}
INDEXED = [
    "keyword_search",
    "seed_search",
    "sparse_topk_index",
    "hybrid_search",
    "search_text",
    "recency_rerank",
    "ndcg",
]


@pytest.fixture
def dealt(spark, monkeypatch):
    """To how many tasks rows were dealt by number, in order."""
    kind, seen = type(spark.range(0)), []
    deal = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, n, *columns: seen.append(n) or deal(self, n, *columns))
    return seen


@pytest.mark.parametrize("name", DENSE)
def test_queries_of_a_task_are_bounded(name, spark, sf, same_rows, dealt, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 1)
    monkeypatch.setattr(vectors, "HELD_NUMBERS", 400)
    same_rows(catalog.QUERIES[name], catalog.ORACLE[name])
    n = read(spark, sf, "embeddings").count()
    assert dealt == [min(n, -(-n * (64 + 2 * DENSE[name]) // 400))] and dealt[0] > 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", INDEXED)
def test_postings_of_a_task_are_bounded(name, spark, sf, same_rows, dealt, monkeypatch):
    monkeypatch.setattr(postings, "SHARD_POSTINGS", 400)
    same_rows(catalog.QUERIES[name], catalog.ORACLE[name])
    n = sparse.term_counts(read(spark, sf, "documents"), "doc_id").selectExpr("sum(size(terms))").first()[0]
    assert max(dealt) == -(-n // 400) > spark.sparkContext.defaultParallelism


def test_twice_the_items_are_twice_the_shards(spark, monkeypatch):
    """No shard grows with the table."""
    monkeypatch.setattr(postings, "SHARD_POSTINGS", 4000)
    most = []
    for n in (2000, 4000):
        rows = spark.range(n).selectExpr("id AS paper_id", "array_join(transform(sequence(1, 20), i -> concat('w', i * (1 + id % 11))), ' ') AS text")
        found = spark.read.parquet(f"{postings.build_postings(sparse.term_counts(rows, 'paper_id'))}/postings").where("term IS NOT NULL")
        held = [r["n"] for r in found.groupBy("shard").agg(F.sum(F.expr("length(items) div 4")).alias("n")).collect()]
        most.append((len(held), max(held), sum(held)))
    assert [m[0] for m in most] == [10, 20] and [m[2] for m in most] == [40_000, 80_000] and all(m[1] < 1.5 * 4000 for m in most)
