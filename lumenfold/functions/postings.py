"""A stored index of postings with bounds, for sparse and keyword search.

Items are dealt to shards; within a shard they are numbered so that items with words in common lie together, and numbers
fall into windows.  A term's postings in a shard know the largest weight in each window, so a query bounds the score of
every window before it reads a posting, takes the windows in order of their bounds, and stops at the first that cannot
reach its k-th best.  One index holds counts and serves both weights: term frequencies of unit length, and keyword relevance.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import shared_root, staged
from .sparse import _flat
from .vectors import runs

#: Items of a shard at most, about; of a shard at least, while there are fewer shards than cores; of a window.
SHARD_ITEMS, LEAST_ITEMS, WINDOW = 32768, 512, 4
#: Postings of a shard at most, about: one shard is held by the task that makes it and by those that search it.
SHARD_POSTINGS = 1 << 20
#: Queries that meet a shard in one task, and windows scored before the first look at the bound (then twice as many).
QUERY_GROUP, STEP = 1024, 32
#: Rows of a term table that may be broadcast.
BROADCAST_ROWS = 200_000
# Saturation and length normalisation of keyword relevance.
BM25_K, BM25_B = 1.2, 0.75
KINDS = ("unit", "keyword")
_POSTINGS = "shard int, term string, windows binary, starts binary, top_unit binary, top_keyword binary, items binary, counts binary, norms binary, least binary"
_NAMES = [c.split()[0] for c in _POSTINGS.split(", ")]


def _shard_rows(shard: int, names: np.ndarray, sizes: np.ndarray, terms: pa.Array, tf: np.ndarray, mean: float):
    """The shard's row of items (no term), then a row for each term, in order.  ``terms`` and ``tf`` lie end to end."""
    item = np.repeat(np.arange(len(names), dtype=np.int32), sizes)
    norms = np.sqrt(np.bincount(item, tf * tf, len(names)))
    least = BM25_K * (1 - BM25_B + BM25_B * np.bincount(item, tf, len(names)) / mean)
    coded = terms.dictionary_encode()
    sorted_ = pc.array_sort_indices(coded.dictionary)
    words, rank = coded.dictionary.take(sorted_), np.argsort(sorted_.to_numpy()).astype(np.int32)
    code = rank[coded.indices.to_numpy()]
    order = np.lexsort([item, code])
    code, item, tf = code[order], item[order], tf[order]
    unit, keyword = tf / norms[item], tf * (BM25_K + 1) / (tf + least[item])
    window = item // WINDOW
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (window[1:] != window[:-1])])
    tops = [np.maximum.reduceat(x, first) for x in (unit, keyword)]
    schema = pa.schema([(n, pa.int32() if n == "shard" else pa.string() if n == "term" else pa.binary()) for n in _NAMES])
    batch = lambda n, own: pa.RecordBatch.from_arrays([pa.array(own.get(c, [None] * n), schema.field(c).type) for c in _NAMES], schema=schema)
    yield batch(1, {"shard": [shard], "items": [names.tobytes()], "norms": [norms.tobytes()], "least": [least.tobytes()]})
    blocks = np.searchsorted(code[first], np.arange(len(words) + 1))
    posts = np.searchsorted(code, np.arange(len(words) + 1))
    flat_columns = {"windows": (window[first].astype(np.int32), blocks), "starts": ((first - posts[code[first]]).astype(np.int32), blocks), "top_unit": (tops[0], blocks), "top_keyword": (tops[1], blocks), "items": (item.astype(np.int32), posts), "counts": (tf.astype(np.int32), posts)}
    for low in range(0, len(words), 8192):
        n = min(8192, len(words) - low)
        cut = {"shard": [shard] * n, "term": words.slice(low, n)}
        for name, (values, ends) in flat_columns.items():
            data, size = values[ends[low] : ends[low + n]].tobytes(), values.itemsize
            at = ((ends[low : low + n + 1] - ends[low]) * size).tolist()
            cut[name] = [data[x:y] for x, y in zip(at, at[1:], strict=False)]
        yield batch(n, cut)


def build_postings(items: DataFrame, item: str = "paper_id", path: str | None = None) -> str:
    """Writes the index of ``term_counts`` (``item``, ``terms``, ``weights``, ``total``) to ``path`` and returns it.

    Items without an id or a word take no part.  ``path`` is below the shared folder if none is given.
    """
    spark = items.sparkSession
    path = path or f"{shared_root(spark)}/lumenfold/postings-{uuid.uuid4().hex}"
    # Written before it is filtered: a filter on what Python counted would count twice.
    rows = staged(items.select(F.col(item).cast("long").alias("item"), "terms", "weights", "total"), "posting-items")
    rows = rows.where(F.col("item").isNotNull() & (F.size("terms") > 0))
    n, mean, postings = rows.agg(F.count(F.lit(1)), F.avg("total"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    # The least hash of an item's terms is often shared by items with many terms in common.
    near = F.array_min(F.transform("terms", lambda t: F.xxhash64(t)))
    shards = max(1, -(-n // SHARD_ITEMS), -(-postings // SHARD_POSTINGS), min(n // LEAST_ITEMS, spark.sparkContext.defaultParallelism))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")).withColumn("near", near)
    dealt = dealt.select("shard", "near", "item", "terms", "weights").repartitionById(shards, "shard").sortWithinPartitions("shard", "near", "item")

    def index(batches):
        shard, held = None, []

        def whole():
            names, sizes, tf = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3))
            return _shard_rows(shard, names, sizes, pa.concat_arrays([h[2] for h in held]), tf, mean)

        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for own in runs(numbers):
                if numbers[own.start] != shard and held:
                    yield from whole()
                    held = []
                shard, part = int(numbers[own.start]), batch.slice(own.start, own.stop - own.start)
                held.append((part.column("item").to_numpy(), *_flat(part)))
        if held:
            yield from whole()

    dealt.mapInArrow(index, _POSTINGS).write.parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings").where("term IS NOT NULL")
    written.groupBy("term").agg(F.sum((F.length("items") / 4).cast("long")).alias("df")).write.parquet(f"{path}/terms")
    spark.createDataFrame([(n, mean)], "items long, mean double").coalesce(1).write.parquet(f"{path}/totals")
    return path


class _Shard:
    """The postings of one shard that some queries ask for, laid end to end."""

    def __init__(self, rows: pd.DataFrame, kind: str):
        head, rows = rows[rows["term"].isna()].iloc[0], rows[rows["term"].notna()]
        joined = lambda column, dtype: np.frombuffer(b"".join(rows[column]), dtype)
        sizes = lambda column, size: rows[column].map(len).to_numpy(np.int64) // size
        self.names = np.frombuffer(head["items"], np.int64)
        blocks, posts = sizes("windows", 4), sizes("items", 4)
        self.first_block, first_post = np.r_[0, np.cumsum(blocks)], np.r_[0, np.cumsum(posts)]
        self.place = {t: i for i, t in enumerate(rows["term"])}
        self.windows, self.tops = joined("windows", np.int32), joined(f"top_{kind}", np.float64)
        self.starts = joined("starts", np.int32) + np.repeat(first_post[:-1], blocks)
        self.lengths = np.diff(np.r_[self.starts, first_post[-1]])
        self.items, counts = joined("items", np.int32), joined("counts", np.int32)
        side = np.frombuffer(head["norms" if kind == "unit" else "least"])[self.items]
        self.weights = counts / side if kind == "unit" else counts * (BM25_K + 1) / (counts + side)

    def best(self, terms: list, weights: list, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Names and scores of the k best items, ties to smaller names; postings read, and those there."""
        known = [(self.place[t], w) for t, w in zip(terms, weights, strict=True) if t in self.place]
        names, scores, read = np.zeros(0, dtype=np.int64), np.zeros(0), 0
        if not known:
            return names, scores, 0, 0
        blocks = np.concatenate([np.arange(self.first_block[i], self.first_block[i + 1]) for i, _ in known])
        factor = np.repeat([w for _, w in known], [self.first_block[i + 1] - self.first_block[i] for i, _ in known])
        windows = self.windows[blocks]
        bound = np.bincount(windows, np.maximum(factor, 0.0) * self.tops[blocks], -(-len(self.names) // WINDOW))
        order = np.unique(windows)
        order = order[np.argsort(-bound[order], kind="stable")]
        at, step = 0, STEP
        while at < len(order):
            # Scores are rounded, so a window's bound has as much room.
            if len(scores) == k and bound[order[at]] + 1e-8 < scores[-1]:
                break
            chosen = order[at : at + step]
            at, step = at + step, 2 * step
            slot = np.full(len(bound), -1)
            slot[chosen] = np.arange(len(chosen))
            own = np.flatnonzero(slot[windows] >= 0)
            lengths = self.lengths[blocks[own]]
            entry = np.repeat(self.starts[blocks[own]] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            cell = np.repeat(slot[windows[own]] * WINDOW, lengths) + self.items[entry] % WINDOW
            size = len(chosen) * WINDOW
            sums, hits = np.bincount(cell, np.repeat(factor[own], lengths) * self.weights[entry], size), np.bincount(cell, minlength=size)
            read += len(entry)
            cell = np.flatnonzero(hits)
            names = np.concatenate([names, self.names[chosen[cell // WINDOW] * WINDOW + cell % WINDOW]])
            scores = np.concatenate([scores, np.round(sums[cell], 9)])
            top = np.lexsort([names, -scores])[:k]
            names, scores = names[top], scores[top]
        return names, scores, read, int(self.lengths[blocks].sum())


class PostingIndex:
    """A stored index, open for searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
        self.items, self.mean = spark.read.parquet(f"{path}/totals").first()

    def _found(self, queries: DataFrame, k: int, kind: str, query: str) -> DataFrame:
        """Each shard's best of each query, and how many postings it read (``read``) of those there (``there``)."""
        asks = staged(queries.where(F.col(query).isNotNull() & (F.size("terms") > 0)).select(F.col(query).cast("long").alias("query"), "terms", "weights"), "posting-queries")
        groups = max(1, -(-asks.count() // QUERY_GROUP))
        wanted = staged(asks.select(F.explode("terms").alias("term")).distinct(), "posting-terms")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        # Only the postings of terms that are asked for are read on, for all queries of a group together.
        used = self.postings.where("term IS NOT NULL").join(wanted, "term", "left_semi").select(self.postings.columns).union(self.postings.where("term IS NULL"))
        used = used.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        shards = self.postings.where("term IS NULL").select("shard")
        grouped = asks.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
        numbers = shards.agg(F.array_sort(F.collect_list("shard")).alias("shards"))  # a number for each SHARD_ITEMS items
        sent = grouped.withColumn("shard", F.explode(F.lit(numbers.first()["shards"]).cast("array<int>")))

        def meet(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(own) and len(rows):
                shard = _Shard(rows, kind)
                for q, terms, weights in zip(own["query"], own["terms"], own["weights"], strict=True):
                    names, scores, read, there = shard.best(terms, weights, k)
                    if len(names):
                        told = np.zeros((2, len(names)), dtype=np.int64)
                        told[:, 0] = read, there
                        out.append(pd.DataFrame({"query": q, "item": names, "score": scores, "read": told[0], "there": told[1]}))
            return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=float if c == "score" else np.int64) for c in ("query", "item", "score", "read", "there")})

        cell = ["shard", "group"]
        return used.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInPandas(meet, "query long, item long, score double, read long, there long")

    def search(self, queries: DataFrame, k: int, kind: str = "unit", query: str = "query_id", item: str = "paper_id") -> DataFrame:
        """``query``, ``item``, ``score``, ``rank`` of each query's k best items that share a term with it, ties to smaller ids.

        ``queries``: ``query``, ``terms``, ``weights``.  An item's weights are its term frequencies scaled to unit length (``unit``) or
        its saturated frequencies (``keyword``).
        """
        if not self.items:
            return queries.sparkSession.createDataFrame([], f"{query} long, {item} long, score double, rank int")
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "item"))
        found = self._found(queries, k, kind, query).withColumn("rank", rank).where(F.col("rank") <= k)
        return found.select(F.col("query").alias(query), F.col("item").alias(item), "score", "rank")

    def share_read(self, queries: DataFrame, k: int, kind: str = "unit", query: str = "query_id") -> float:
        """The share of the postings of the queries' terms that a search reads."""
        read, there = self._found(queries, k, kind, query).agg(F.sum("read"), F.sum("there")).first()
        return read / there if there else 0.0

    def keyword_weights(self, queries: DataFrame, query: str = "query_id") -> DataFrame:
        """``queries`` (``query``, ``terms``) with the rarity of each known term; repeated terms count once."""
        asked = staged(queries.select(query, F.explode(F.array_distinct("terms")).alias("term")), "posting-asked")
        known = asked.select("term").distinct()
        known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
        rarity = F.log(1 + (F.lit(float(self.items)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = asked.join(self.terms.join(known, "term", "left_semi"), "term").select(query, F.struct("term", rarity.alias("weight")).alias("t"))
        lists = weighted.groupBy(query).agg(F.sort_array(F.collect_list("t")).alias("t"))
        return lists.select(query, F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))

    def keyword_search(self, queries: DataFrame, k: int, query: str = "query_id", item: str = "paper_id") -> DataFrame:
        """As ``search``, by keyword relevance (BM25) of the queries' ``terms``."""
        return self.search(self.keyword_weights(queries, query), k, "keyword", query, item)
