"""Hybrid search: dense and sparse top-k, rank fusion, recency blend and metadata, for all queries in one plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.postings import PostingIndex, build_postings
from ..functions.sparse import sparse_topk, term_counts, term_vectors
from ..functions.vectors import dense_topk
from ..operators.fusion import recency_rerank, rrf
from ..operators.tables import with_fallback
from ..sources.staging import staged

#: Rows fetched per leg for each row returned (fixed value).
OVERFETCH = 6


def hybrid_search(query_vectors: DataFrame, query_terms: DataFrame, vectors: DataFrame, item_terms: DataFrame | PostingIndex, papers: DataFrame, as_of_month: int, limit: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``paper_id``, ``final_score`` and metadata.  A leg without rows leaves the other's order.

    ``item_terms`` are the items' term vectors, or a stored index of them.
    """
    n = limit * OVERFETCH
    by_terms = item_terms.search(query_terms, n) if isinstance(item_terms, PostingIndex) else sparse_topk(query_terms, item_terms, n)
    fused = rrf([dense_topk(query_vectors, vectors, n), by_terms])
    ranked = recency_rerank(fused.join(papers.select("paper_id", "arxiv_id", "title"), "paper_id"), as_of_month)
    return ranked.where(F.col("rank") <= limit).select("query_id", "rank", "paper_id", "final_score", "title")


def search(queries: DataFrame, vectors: DataFrame, texts: DataFrame | PostingIndex, papers: DataFrame, encoder, dim: int, as_of_month: int, rewriter=None, limit: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``paper_id``, ``origin`` for queries given as ``text``: rewritten, encoded, searched.

    ``texts``: ``paper_id``, ``text`` of the items, or their stored index, which is built otherwise: one for both legs.  Queries that the encoder gives nothing for are answered by keyword
    relevance (``origin`` keyword, else hybrid).  Blank queries give no rows.
    """
    asked = staged(rewrite_queries(queries, rewriter).select("query_id", "query").where("query <> ''"), "search-queries")
    encoded = staged(encode(asked, encoder, dim, "query_id", "query"), "search-vectors")
    able = encoded.where("embedding IS NOT NULL")
    own = asked.join(able, "query_id", "left_semi")
    index = texts if isinstance(texts, PostingIndex) else PostingIndex(texts.sparkSession, build_postings(term_counts(texts, "paper_id")))
    found = hybrid_search(able, term_vectors(own, "query_id", "query"), vectors, index, papers, as_of_month, limit)
    by_words = index.keyword_search(term_counts(asked.join(able, "query_id", "left_anti"), "query_id", "query"), limit)
    columns = ("query_id", "rank", "paper_id")
    return found.select(*columns, F.lit("hybrid").alias("origin")).union(by_words.select(*columns, F.lit("keyword")))


def seed_papers(queries: DataFrame, found: DataFrame, cache: DataFrame, remote: DataFrame, limit: int = 6) -> DataFrame:
    """The onboarding search: metadata of the first rows ``found``, from the cache or else from the remote table."""
    top = staged(found.where(F.col("rank") <= limit).join(queries.select("query_id"), "query_id", "left_semi").select("query_id", "rank", "paper_id"), "search-top")
    return top.join(with_fallback(top, cache, remote, "paper_id"), "paper_id")


def rewrite_queries(queries: DataFrame, rewriter=None, text: str = "text") -> DataFrame:
    """``query``: the text as a rewriter (a function from column to column; none keeps it) would have it.

    Academic-looking and blank queries are left alone, as are those for which the rewriter gives nothing usable.
    """
    plain = F.trim(F.col(text))
    rewritten = scalars.accept_rewrite(F.coalesce(rewriter(plain), F.lit("")), plain) if rewriter else plain
    return queries.withColumn("query", F.when((plain == "") | scalars.looks_academic(plain), plain).otherwise(rewritten))


def encode(texts: DataFrame, encoder, dim: int, key: str, text: str = "text") -> DataFrame:
    """``key``, ``embedding`` by ``encoder`` (a function from a list of strings to vectors, or None where it has none);
    blank texts give zeros.

    The encoder runs on batches inside the tasks; texts are not exchanged.
    """

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        plain = [(t or "").strip() for t in batch]
        rows: list = [np.zeros(dim)] * len(plain)
        filled = [i for i, t in enumerate(plain) if t]
        if filled:
            for i, vector in zip(filled, encoder([plain[i] for i in filled]), strict=True):
                rows[i] = None if vector is None else np.asarray(vector, dtype=float)
        return pd.Series(rows)

    return texts.select(key, run(F.col(text)).alias("embedding"))
