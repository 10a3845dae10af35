"""Stored indexes: recall and certainty of approximate dense search, against the exact one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold import catalog, catalog_index  # noqa: F401
from lumenfold.functions import ann, postings, sparse
from lumenfold.functions.vectors import dense_topk

BIG = 2**60


def pairs(df, columns=("query_id", "paper_id")):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.1"
    got = pairs(catalog.QUERIES["dense_topk_ann"](spark, sf))
    exact = pairs(dense_topk(catalog_index._asked(spark, sf), catalog_index.vector_table(spark, sf), 10))
    assert len(got) == len(exact)
    assert len(got & exact) / len(exact) >= 0.9


@pytest.fixture(scope="module")
def clustered(spark):
    """8 groups of 300 rows, a third of all rows in one more group of near copies; odd rows."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.1 * draw.normal(size=16)).tolist()) for i in range(2400)]
    rows += [(10_000 + i, (centres[0] + 1e-3 * draw.normal(size=16)).tolist()) for i in range(1200)]
    odd = [(None, [1.0] * 16), (BIG + 1, None), (BIG + 3, [float("nan")] * 16), (BIG + 5, [1.0] * 3), (BIG + 7, (centres[1] * 2).tolist()), (BIG + 9, [None] * 16)]
    return spark.createDataFrame(rows + odd, "paper_id long, embedding array<double>")


@pytest.mark.parametrize("limits", [(32768, 2048), (256, 8)])
def test_few_cells_find_nearly_all(spark, clustered, monkeypatch, limits):
    monkeypatch.setattr(ann, "CELL_ROWS", limits[0])
    monkeypatch.setattr(ann, "CELL_QUERIES", limits[1])
    index = ann.DenseIndex(spark, ann.build_index(clustered, cells=16))
    assert index.stats()["rows"] == 3601 and index.stats()["dim"] == 16
    probes = index.calibrated(clustered, 10, 0.95)
    assert probes <= 8
    asks = clustered.where("paper_id % 21 = 0 AND embedding IS NOT NULL").withColumnRenamed("paper_id", "query_id")
    exact = pairs(dense_topk(asks, clustered.where(f"paper_id < 20000 OR paper_id = {BIG + 7}"), 10))
    found = index.search(asks, clustered, 10, probes)
    assert len(pairs(found) & exact) / len(exact) >= 0.9
    sure = found.where("certain").select("query_id").distinct()
    assert pairs(found.join(sure, "query_id", "left_semi")) <= exact
    assert any(i == BIG + 7 for _, i in pairs(found))


def test_uncertain_queries_are_answered_exactly(spark, clustered):
    index = ann.DenseIndex(spark, ann.build_index(clustered, cells=16))
    asks = clustered.where("paper_id % 50 = 0 AND embedding IS NOT NULL").withColumnRenamed("paper_id", "query_id")
    found = ann.dense_topk_ann(index, asks, clustered, 10, 1, exact="uncertain")
    exact = dense_topk(asks, clustered.where(f"paper_id < 20000 OR paper_id = {BIG + 7}"), 10)
    columns = ("query_id", "paper_id", "rank")
    assert pairs(found, columns) == pairs(exact, columns)
    every = index.search(asks, clustered, 10, 16, refine=400)
    assert {r["certain"] for r in every.collect()} == {True} and pairs(every, columns) == pairs(exact, columns)


def test_index_of_few_rows(spark):
    none = spark.createDataFrame([], "paper_id long, embedding array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    assert ann.dense_topk_ann(ann.DenseIndex(spark, ann.build_index(none)), ask, none, 3, 2).count() == 0
    two = spark.createDataFrame([(5, [1.0, 0.0]), (4, [1.0, 0.0])], "paper_id long, embedding array<double>")
    index = ann.DenseIndex(spark, ann.build_index(two))
    found = ann.dense_topk_ann(index, ask, two, 3, 1).collect()
    assert [(r["query_id"], r["paper_id"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 4, 1), (1, 5, 2)]


# Postings


@pytest.fixture(scope="module")
def texts(spark):
    draw = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)] + ["élan", "2024", "x1", "ÜBER", "日本"]
    rows = [(i, " ".join(words[j] for j in (draw.zipf(1.3, size=draw.integers(1, 40)) - 1) % len(words))) for i in range(900)]
    rows += [(1000 + i, "common words of one frequent line") for i in range(450)]  # a third of the table
    return spark.createDataFrame([*rows, (None, "w1 w2"), (BIG + 1, "w1 élan, 2024!"), (BIG + 3, "w1 élan, 2024!"), (3000, None), (3001, " ... ")], "paper_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, f"w{i % 9} w{i % 5} élan common line über") for i in range(40)] + [(90, "2024"), (91, None), (92, "unknown"), (None, "w1")]
    return sparse.term_counts(spark.createDataFrame(rows, "query_id long, text string"), "query_id")


@pytest.mark.parametrize("limits", [(32768, 512, 4), (64, 64, 2), (32768, 10**6, 16)])
def test_index_equals_scan(spark, texts, asked, monkeypatch, limits):
    for name, value in zip(("SHARD_ITEMS", "LEAST_ITEMS", "WINDOW"), limits, strict=True):
        monkeypatch.setattr(postings, name, value)
    monkeypatch.setattr(postings, "QUERY_GROUP", 16)
    monkeypatch.setattr(postings, "STEP", 2)
    counts = sparse.term_counts(texts, "paper_id")
    index = postings.PostingIndex(spark, postings.build_postings(counts))
    asks, columns = sparse.scaled(asked), ("query_id", "paper_id", "rank")
    plain = sparse.sparse_topk(asks, sparse.scaled(counts), 7)
    assert pairs(index.search(asks, 7), columns) == pairs(plain, columns)
    assert index.items == 900 + 450 + 2
    found = [r["paper_id"] for r in index.search(asks, 7).where("query_id = 90").orderBy("rank").collect()]
    assert {BIG + 1, BIG + 3} <= set(found)
    assert 0 < index.share_read(asks, 7) <= 1


def test_keyword_relevance_equals_plain_sums(spark, texts, asked):
    import math
    import re
    from collections import Counter

    index = postings.PostingIndex(spark, postings.build_postings(sparse.term_counts(texts, "paper_id")))
    docs = {r["paper_id"]: Counter(re.findall(r"[^\W_]+", r["text"].lower())) for r in texts.where("paper_id IS NOT NULL AND text IS NOT NULL").collect()}
    docs = {i: c for i, c in docs.items() if c}
    mean, df = sum(sum(c.values()) for c in docs.values()) / len(docs), Counter(w for c in docs.values() for w in c)
    expected = set()
    for q, terms in [(r["query_id"], r["terms"]) for r in asked.collect()]:
        scores = {}
        for i, c in docs.items():
            hits = [w for w in terms if c[w]]
            if hits:
                scores[i] = round(sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in hits), 9)
        if q is not None:
            expected |= {(q, i, rank + 1) for rank, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:5])}
    assert pairs(index.keyword_search(asked, 5), ("query_id", "paper_id", "rank")) == expected


def test_bounds_spare_most_postings(spark):
    """Where few items fit a query, most windows cannot reach its best and are not read."""
    rows = spark.range(20_000).selectExpr("id AS paper_id", "concat('the of and ', CASE WHEN id % 100 = 7 THEN 'rare rare' ELSE repeat(concat('word', id % 50, ' '), 5) END) AS text")
    index = postings.PostingIndex(spark, postings.build_postings(sparse.term_counts(rows, "paper_id")))
    ask = sparse.term_counts(spark.createDataFrame([(1, "the rare of")], "query_id long, text string"), "query_id")
    assert index.share_read(index.keyword_weights(ask), 10, "keyword") < 0.2
    assert index.keyword_search(ask, 10).count() == 10


def test_words_are_counted_once(spark, tmp_path):
    """One pass of the tokeniser for all that a search needs of the documents."""
    rows = spark.range(500).selectExpr("id AS paper_id", "concat('a b ', id) AS text")
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def noted(text: pd.Series) -> pd.Series:
        seen.add(len(text))
        return text

    index = postings.PostingIndex(spark, postings.build_postings(sparse.term_counts(rows.withColumn("text", noted("text")), "paper_id")))
    ask = spark.createDataFrame([(1, ["a", "7"], [1.0, 1.0])], "query_id long, terms array<string>, weights array<double>")
    assert index.keyword_search(ask, 3).count() == 3 and index.search(ask, 3).count() == 3
    assert seen.value == 500


def test_shards_and_score_tables_are_bounded(spark, monkeypatch):
    """What a task holds follows from postings and products, not from how many items there are or share words."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(postings, "SHARD_POSTINGS", 3000)
    rows = spark.range(600).selectExpr("id AS paper_id", "concat(repeat('x', 50000), ' ', array_join(transform(sequence(1, 30), i -> concat('w', i * (id % 7 + 1))), ' ')) AS text")
    path = postings.build_postings(sparse.term_counts(rows, "paper_id"))
    assert spark.read.parquet(f"{path}/postings").select("shard").distinct().count() >= 6
    ask = sparse.term_vectors(spark.createDataFrame([(1, "w3 w5 w14")], "query_id long, text string"), "query_id")
    assert pairs(postings.PostingIndex(spark, path).search(ask, 5)) == pairs(sparse.sparse_topk(ask, sparse.term_vectors(rows, "paper_id"), 5))
    words = [f"w{i}" for i in range(100)]
    index = sparse._Index(range(500), pa.array(words * 500), np.full(500, 100), np.ones(50_000))
    tracemalloc.start()
    best = index.best(3)
    index.add(best, np.arange(400), np.full(400, 100), pa.array(words * 400), np.ones(40_000))  # 20 million products
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and best.names.tolist() == [[0, 1, 2]] * 500 and (best.scores == 100).all()


def test_empty_postings(spark):
    none = sparse.term_counts(spark.createDataFrame([], "paper_id long, text string"), "paper_id")
    index = postings.PostingIndex(spark, postings.build_postings(none))
    ask = spark.createDataFrame([(1, ["a"], [1.0])], "query_id long, terms array<string>, weights array<double>")
    assert index.search(ask, 3).count() == 0 and index.keyword_search(ask, 3).count() == 0
