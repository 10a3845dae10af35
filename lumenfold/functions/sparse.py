"""Sparse term vectors of texts, exact sparse top-k and keyword relevance.

A vector is a pair of arrays, ``terms`` and ``weights``.  Items are read once for each block of queries: every batch is
multiplied with the block's inverted index inside its task and keeps its own best per query, so what is exchanged does
not depend on how many items share a frequent term with how many queries.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import Best, runs

#: Queries, and terms in them, that travel with a task at once; more are dealt to tasks.
QUERY_BLOCK, QUERY_TERMS = 2048, 1_000_000
#: Cells of the score table of some items by all queries of a block, and products summed into it at once.
_CELLS, _ENTRIES = 1_000_000, 1_000_000
#: Items that are scored at once, and texts whose words are held as Python objects at once.
ITEMS_AT_ONCE = 1024
TEXTS_AT_ONCE = 256
#: Words are runs of letters and digits of any script.
_WORDS = re.compile(r"[^\W_]+")


def term_counts(texts: DataFrame, key: str, text: str = "text", unit: bool = False) -> DataFrame:
    """``key``, ``terms``, ``weights``, ``total``: how often each word (a run of letters and digits, lower-cased) occurs, and all words.

    With ``unit``, weights are scaled to unit length.  Only texts go to Python; null texts and those
    without words have empty arrays.
    """

    def count(batches):
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                found = [Counter(_WORDS.findall(t)) if t is not None else Counter() for t in part.column(1).to_pylist()]
                weights = [np.fromiter(c.values(), dtype=float, count=len(c)) for c in found]
                totals = [float(w.sum()) for w in weights]
                if unit:
                    weights = [w / np.sqrt((w * w).sum()) if len(w) else w for w in weights]
                lists = [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(totals, pa.float64())], [key, "terms", "weights", "total"])

    rows = texts.select(key, F.lower(text).alias("__text"))
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a table in few files is dealt to all cores; large ones stay where they are
        rows = rows.repartition(cores)
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string("terms array<string>, weights array<double>, total double").fields])
    return rows.mapInArrow(count, schema)


def scaled(counts: DataFrame) -> DataFrame:
    """``counts`` with weights scaled to unit length."""
    norm = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x * x))
    return counts.withColumn("weights", F.transform("weights", lambda x: x / norm))


def term_vectors(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Term frequencies scaled to unit length."""
    return term_counts(texts, key, text, unit=True)


class _Index:
    """A block of queries by term, ready to score items."""

    def __init__(self, ids, terms: pa.Array, sizes: np.ndarray, values: np.ndarray):
        self.ids = np.asarray(ids, dtype=np.int64)
        coded = terms.dictionary_encode()
        self.vocabulary, at = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        self.owner, self.values = np.repeat(np.arange(len(sizes)), sizes)[order], values[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.vocabulary) + 1))

    def best(self, k: int) -> Best:
        """Nothing found yet."""
        return Best(self.ids, np.zeros((len(self.ids), 0)), np.full(len(self.ids), k), [None] * len(self.ids))

    def add(self, best: Best, names: np.ndarray, sizes: np.ndarray, terms: pa.Array, weights: np.ndarray) -> None:
        """Puts the items that share a term with a query to its best.  Items are taken in slices, bounded by cells and by entries."""
        at = pc.fill_null(pc.index_in(terms, value_set=self.vocabulary), -1).to_numpy()
        item = np.repeat(np.arange(len(names)), sizes)
        known = at >= 0
        at, item, weights = at[known], item[known], weights[known]
        count = self.first[at + 1] - self.first[at]
        upto = np.cumsum(np.bincount(item, count, len(names)))
        step, low = max(1, _CELLS // len(self.ids)), 0
        while low < len(names):
            done = upto[low - 1] if low else 0
            high = min(low + step, len(names), max(low + 1, int(np.searchsorted(upto, done + _ENTRIES, "right"))))
            own = slice(*np.searchsorted(item, [low, high]))
            n, counts = high - low, count[own]
            entry = np.repeat(self.first[at[own]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            cell = self.owner[entry] * n + np.repeat(item[own] - low, counts)
            scores = np.bincount(cell, np.repeat(weights[own], counts) * self.values[entry], len(self.ids) * n).reshape(-1, n)
            best.take(names[low:high], np.where(scores != 0, scores, -np.inf))
            low = high


def _flat(batch: pa.RecordBatch):
    """Sizes, terms and weights of a batch's rows, end to end."""
    terms, weights = batch.column("terms"), batch.column("weights").flatten().to_numpy(zero_copy_only=False)
    return np.diff(terms.offsets.to_numpy()), terms.flatten(), weights


def sparse_topk(queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", item: str = "paper_id") -> DataFrame:
    """``query_id``, ``paper_id``, ``score``, ``rank`` of each query's k best items that share a term with it.

    ``queries`` and ``items`` have ``terms`` and ``weights``; the score is the inner product, ties go to smaller ids.
    Rows without an id take no part.  Few queries travel with the tasks that read the items; more are dealt to tasks, and all items stream past them.
    """
    schema = "query long, item long, score double, most long"
    asks = queries.where(F.col(query).isNotNull() & (F.size("terms") > 0)).select(F.col(query).cast("long").alias("id"), "terms", "weights")
    n, terms = asks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    rows = items.where(F.col(item).isNotNull() & (F.size("terms") > 0)).select(F.col(item).cast("long").alias("id"), "terms", "weights")
    if n <= QUERY_BLOCK and terms <= QUERY_TERMS:
        own = asks.collect()
        ids, words = [r["id"] for r in own], [t for r in own for t in r["terms"]]
        sizes, values = np.array([len(r["terms"]) for r in own], dtype=np.int64), np.array([w for r in own for w in r["weights"]], dtype=float)

        def score(batches):
            if not ids:
                return
            index = _Index(ids, pa.array(words, pa.string()), sizes, values)
            best = index.best(k)
            for batch in batches:
                for part in (batch.slice(at, ITEMS_AT_ONCE) for at in range(0, len(batch), ITEMS_AT_ONCE)):
                    index.add(best, part.column("id").to_numpy(), *_flat(part))
            yield best.found()

        out = rows.mapInArrow(score, schema)
    else:
        cores = items.sparkSession.sparkContext.defaultParallelism
        groups = max(-(-n // QUERY_BLOCK), -(-terms // QUERY_TERMS), min(n, 2 * cores))
        held = asks.withColumns({"number": F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), "isitem": F.lit(False)})
        sent = rows.withColumns({"number": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "isitem": F.lit(True)})
        dealt = held.unionByName(sent).repartitionById(groups, "number").sortWithinPartitions("number", "isitem", "id")

        def stream(batches):
            number, waiting, index, best = None, [], None, None
            for batch in batches:
                numbers, isitem = batch.column("number").to_numpy(), batch.column("isitem").to_numpy(zero_copy_only=False)
                for own in runs(numbers, isitem):
                    part = batch.slice(own.start, own.stop - own.start)
                    if numbers[own.start] != number:
                        if best is not None:
                            yield best.found()
                        number, waiting, index, best = numbers[own.start], [], None, None
                    if not isitem[own.start]:
                        waiting.append((part.column("id").to_numpy(), *_flat(part)))
                        continue
                    if waiting:
                        ids, sizes, values = (np.concatenate([w[i] for w in waiting]) for i in (0, 1, 3))
                        index, waiting = _Index(ids, pa.concat_arrays([w[2] for w in waiting]), sizes, values), []
                        best = index.best(k)
                    for few in (part.slice(at, ITEMS_AT_ONCE) for at in range(0, len(part), ITEMS_AT_ONCE)) if index is not None else ():
                        index.add(best, few.column("id").to_numpy(), *_flat(few))
            if best is not None:
                yield best.found()

        out = dealt.select("number", "isitem", "id", "terms", "weights").mapInArrow(stream, schema)
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), item))
    return out.select(F.col("query").alias(query), F.col("item").alias(item), "score").withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_topk(queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", item: str = "paper_id") -> DataFrame:
    """As ``sparse_topk``, by keyword relevance (BM25) over ``term_counts`` of both; a query's repeated words count once.

    Items without a word take no part.  The index of the items is built for this call; who searches them more than once
    builds it once (``postings``).
    """
    from .postings import PostingIndex, build_postings

    return PostingIndex(items.sparkSession, build_postings(items, item)).keyword_search(queries, k, query, item)
