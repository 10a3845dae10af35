"""Vector arithmetic on array columns, and exact dense top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import staged

EPS = 1e-10
#: Query vectors, and items barred from them, that travel with a task at once; more are dealt to tasks.
QUERY_BLOCK, BARRED = 4096, 1_000_000
#: Queries, and items, whose products are made at once (32 MB); numbers in the vectors and answers of a task's queries.
QUERIES_AT_ONCE, ITEMS_AT_ONCE, HELD_NUMBERS = 512, 8192, 1 << 23
#: Items barred from a query up to which it shares the search of its vector; answers to vectors that are broadcast.
SHARED_BARRED, SHARED_ANSWERS = 1024, 1_000_000
#: Rows, about, that groups give back at once.
OUT_ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """The unit vector, or null if the norm is next to nothing."""
    n = norm(a)
    return F.when(n >= EPS, F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a small number added to each norm; 0 without a second vector."""
    return F.when(b.isNotNull(), dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))).otherwise(F.lit(0.0))


def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    """As ``cosine``, sums in the same order; null without a first vector, or where numbers are missing."""
    sizes = [pc.list_value_length(x).fill_null(-1).to_numpy() for x in (a, b)]
    same = (sizes[0] == sizes[1]) & (sizes[0] >= 0)
    row = np.repeat(np.arange(same.sum()), sizes[0][same])
    x, y = (c.filter(pa.array(same)).flatten().to_numpy(zero_copy_only=False) for c in (a, b))
    dot_, xx, yy = (np.bincount(row, own, same.sum()) for own in (x * y, x * x, y * y))
    out = np.where(sizes[1] < 0, 0.0, np.nan)
    out[same] = dot_ / ((np.sqrt(xx) + EPS) * (np.sqrt(yy) + EPS))
    return pa.array(out, from_pandas=True)


def cosines(vector: str, *others: str) -> Column:
    """``cosine`` of ``vector`` with each of the columns ``others``, as a struct of ``<other>_sim``, in Arrow batches.

    An expression over arrays calls its function for each number; ten million candidates have billions.
    """
    names = [f"{o}_sim" for o in others]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def run(own: pa.Array, *rest: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_cosines(own, r) for r in rest], names)

    return run(vector, *others)


def centroid(table: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean per key: sums per position, partly made before the exchange."""
    parts = table.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return parts.groupBy(key).agg(F.transform(ordered, lambda p: p["m"]).alias("centroid"))


def stacked(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column of lists as rows of 64-bit floats."""
    rows, flat = len(column), column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    size = len(flat) // rows if rows else 0
    if not (np.diff(column.offsets.to_numpy()) == size).all():
        raise ValueError("vectors of different lengths")
    return flat.reshape(rows, size)


def places(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``wanted``, place in the sorted ``names``) of all that are equal."""
    low = np.searchsorted(names, wanted, "left")
    count = np.searchsorted(names, wanted, "right") - low
    return np.repeat(np.arange(len(wanted)), count), np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


class Best:
    """The best rows so far of some queries, each with its own k; ties to smaller names."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, ks: np.ndarray, barred: list):
        self.ids, self.matrix, self.ks = ids, matrix, ks
        width = int(ks.max())
        self.scores = np.full((len(ids), width), -np.inf)
        self.names = np.full((len(ids), width), np.iinfo(np.int64).max)
        own = [(j, np.asarray(b, dtype=np.int64)) for j, b in enumerate(barred) if b is not None and len(b)]
        self.barred_by = np.repeat([j for j, _ in own], [len(b) for _, b in own]).astype(np.int64)
        self.barred = np.concatenate([b for _, b in own]) if own else np.zeros(0, dtype=np.int64)

    def add(self, names: np.ndarray, rows: np.ndarray) -> None:
        """Rows in order of their names."""
        near = self.matrix @ rows.T
        if len(self.barred):
            at, place = places(names, self.barred)
            near[self.barred_by[at], place] = -np.inf
        self.take(names, near)

    def take(self, names: np.ndarray, near: np.ndarray) -> None:
        """Scores of each query by each row; none where it is minus infinity."""
        width = self.scores.shape[1]
        last = np.arange(len(self.ids)), self.ks - 1
        worst, worst_name = self.scores[last], self.names[last]
        # Scores are rounded, so a row that may be among the best has as much room.
        floor = np.maximum(worst - 1e-9, -1e300)
        if len(names) > width and np.isneginf(worst).any():
            floor = np.maximum(floor, np.partition(near, len(names) - width, axis=1)[:, len(names) - width] - 2e-9)
        at, place = np.nonzero(near >= floor[:, None])
        score, name = np.round(near[at, place], 9), names[place]
        better = (score > worst[at]) | ((score == worst[at]) & (name < worst_name[at]))
        at, score, name = at[better], score[better], name[better]
        if not len(at):
            return
        own = np.unique(at)
        at = np.concatenate([np.repeat(own, width), at])
        score, name = np.concatenate([self.scores[own].ravel(), score]), np.concatenate([self.names[own].ravel(), name])
        order = np.lexsort([name, -score, at])
        take = order[np.searchsorted(at[order], own)[:, None] + np.arange(width)]
        self.scores[own], self.names[own] = score[take], name[take]

    def found(self) -> pa.RecordBatch:
        at, place = np.nonzero((self.scores > -np.inf) & (np.arange(self.scores.shape[1]) < self.ks[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[at], self.names[at, place], self.scores[at, place], self.ks[at])], ["query", "item", "score", "most"])


def _asking(ids: np.ndarray, matrix: np.ndarray, ks: np.ndarray, barred: list) -> list[Best]:
    """Some queries at a time, those of a like k together."""
    order = np.argsort(ks, kind="stable")
    parts = [order[at : at + QUERIES_AT_ONCE] for at in range(0, len(order), QUERIES_AT_ONCE)]
    return [Best(ids[p], np.ascontiguousarray(matrix[p]), ks[p], [barred[j] for j in p]) for p in parts]


def _add(asking: list[Best], names: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(names, kind="stable")
    for at in range(0, len(order), ITEMS_AT_ONCE):
        own = order[at : at + ITEMS_AT_ONCE]
        for best in asking:
            best.add(names[own], rows[own])


def runs(*columns: np.ndarray):
    """Slices of rows whose ``columns`` are all equal."""
    n = len(columns[0])
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if n else []
    ends = [0, *cuts, n]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def by_group(rows: DataFrame, group: str, order: list, choose, schema, parts: int = 3) -> DataFrame:
    """``choose`` (a function of batches) of each group's rows in ``order``: a batch of the ``schema``'s columns.

    Groups lie end to end in a partition, so many small ones share a batch on their way to Python and back.  Their number,
    not their size, makes the work, so they are dealt to ``parts`` tasks for each core, whatever their bytes.
    """

    def run(batches):
        held, last, out, n = [], None, [], 0
        merged = lambda parts: parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        for batch in batches:
            keys = batch.column(group)
            for own in runs(keys.dictionary_encode("encode").indices.to_numpy()):
                key = keys[own.start].as_py()
                if held and key != last:
                    out.append(choose(merged(held)))
                    held, n = [], n + len(out[-1])
                    if n >= OUT_ROWS:
                        yield merged([x for x in out if len(x)])
                        out, n = [], 0
                last = key
                held.append(batch.slice(own.start, own.stop - own.start))
        if held:
            out.append(choose(merged(held)))
        if out := [x for x in out if len(x)]:
            yield merged(out)

    dealt = rows.repartition(parts * rows.sparkSession.sparkContext.defaultParallelism, group)
    return dealt.sortWithinPartitions(group, *order).mapInArrow(run, schema)


def dense_topk(queries: DataFrame, items: DataFrame, k: int, exclude: DataFrame | None = None, query="query_id", item="paper_id", vector="embedding", k_column: str | None = None) -> DataFrame:
    """``query_id``, ``paper_id``, ``score`` (inner product), ``rank`` of each query's k best items, ties to smaller ids.

    Up to ``QUERY_BLOCK`` queries travel with the tasks that read the items, and a task keeps its own k best per query.  More
    are dealt to tasks, as few as cores and ``HELD_NUMBERS`` allow; past each task's queries all items stream, so what is held
    is bounded, and what leaves a task is the answer.  ``exclude`` (query, item) pairs are left out before the cut, so lists are never short
    because of them.  ``k_column`` gives a k per query, at most ``k``.  Rows without an id or a vector take no part.
    """
    queries, items = (t.where(F.col(key).isNotNull() & F.col(vector).isNotNull()) for t, key in ((queries, query), (items, item)))
    most = F.least(F.col(k_column), F.lit(k)) if k_column else F.lit(k)
    asks = queries.select(F.col(query).cast("long").alias("id"), vector, most.cast("long").alias("most")).where("most > 0")
    if exclude is None:
        asks = asks.withColumn("barred", F.lit(None).cast("array<bigint>"))
    else:
        asks = asks.join(exclude.groupBy(F.col(query).alias("id")).agg(F.collect_set(item).alias("barred")), "id", "left")
    n, size = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    few = n <= QUERY_BLOCK
    if few and exclude is not None:
        few = exclude.join(queries.select(query), query, "left_semi").limit(BARRED + 1).count() <= BARRED
    schema = "query long, item long, score double, most long"
    rows = items.select(F.col(item).cast("long").alias("id"), vector)
    if few:
        own = asks.collect()
        ids, ks = (np.array([r[c] for r in own], dtype=np.int64) for c in ("id", "most"))
        matrix, barred = np.array([r[vector] for r in own], dtype=float), [r["barred"] for r in own]

        def score(batches):
            asking = _asking(ids, matrix, ks, barred)
            for batch in batches:
                if len(batch):
                    _add(asking, batch.column("id").to_numpy(), stacked(batch.column(vector)))
            yield from (best.found() for best in asking)

        out = rows.mapInArrow(score, schema)
    else:
        cores = items.sparkSession.sparkContext.defaultParallelism
        groups = min(-(-n // QUERIES_AT_ONCE) if n > QUERIES_AT_ONCE else n, max(2 * cores, -(-n * (size + 2 * k) // HELD_NUMBERS)))
        held = asks.withColumn("number", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        sent = rows.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        both = held.unionByName(sent.withColumns({"most": F.lit(None).cast("long"), "barred": F.lit(None).cast("array<bigint>")}))
        # A task's queries come first, then the items in order.
        dealt = both.repartitionById(groups, "number").sortWithinPartitions("number", F.col("most").isNotNull().desc(), "most", "id")

        def stream(batches):
            number, waiting, asking = None, [], []
            for batch in batches:
                numbers, isitem = batch.column("number").to_numpy(), batch.column("most").is_null().to_numpy(zero_copy_only=False)
                for own in runs(numbers, isitem):
                    part = batch.slice(own.start, own.stop - own.start)
                    if numbers[own.start] != number:
                        yield from (best.found() for best in asking)
                        number, waiting, asking = numbers[own.start], [], []
                    if not isitem[own.start]:
                        waiting.append((part.column("id").to_numpy(), stacked(part.column(vector)), part.column("most").to_numpy(), part.column("barred").to_pylist()))
                        continue
                    if waiting:
                        ids, matrix, ks = (np.concatenate([w[i] for w in waiting]) for i in range(3))
                        asking, waiting = _asking(ids, matrix, ks, [b for w in waiting for b in w[3]]), []
                    _add(asking, part.column("id").to_numpy(), stacked(part.column(vector)))
            yield from (best.found() for best in asking)

        out = dealt.select("number", "id", vector, "most", "barred").mapInArrow(stream, schema)
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), item))
    named = out.select(F.col("query").alias(query), F.col("item").alias(item), "score", "most")
    return named.withColumn("rank", rank).where(F.col("rank") <= F.col("most")).drop("most")


def shared_topk(queries: DataFrame, items: DataFrame, k: int, exclude: DataFrame, query="query_id", item="paper_id", vector="embedding", k_column: str | None = None) -> DataFrame:
    """As ``dense_topk`` with ``exclude``, for queries of which many have the same vector: each vector is searched once.

    A vector's answer is so deep that each of its queries has its k best after its own barred items are left out.  Queries
    with more than ``SHARED_BARRED`` barred items are searched by themselves.
    """
    most = F.least(F.col(k_column), F.lit(k)) if k_column else F.lit(k)
    asks = queries.where(F.col(query).isNotNull() & F.col(vector).isNotNull()).select(F.col(query).cast("long").alias("id"), vector, most.cast("long").alias("most")).where("most > 0")
    barred = exclude.groupBy(F.col(query).alias("id")).agg(F.collect_set(item).alias("barred"))
    asks = staged(asks.join(barred, "id", "left").withColumn("barred", F.coalesce("barred", F.array().cast("array<bigint>"))), "shared-asks")
    sharing = asks.where(F.size("barred") <= SHARED_BARRED)
    depth = (F.col("most") + F.size("barred")).alias("depth")
    alike = staged(sharing.select(vector, depth).groupBy(vector).agg(F.max("depth").alias("depth")).withColumn("vector_id", F.monotonically_increasing_id()), "shared-vectors")
    deepest, total = alike.agg(F.max("depth"), F.sum("depth")).first()
    columns = [F.col("id").alias(query), F.col("t.item").alias(item), "t.score", "rank"]
    out = []
    if deepest:
        found = dense_topk(alike, items, deepest, query="vector_id", item=item, vector=vector, k_column="depth")
        lists = found.groupBy("vector_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("item"), "score"))).alias("found"))
        answers = alike.select("vector_id", vector).join(lists, "vector_id").drop("vector_id")
        near = F.slice("found", F.lit(1), F.col("most").cast("int") + F.size("barred"))
        left = F.slice(F.filter(near, lambda t: ~F.array_contains("barred", t["item"])), F.lit(1), F.col("most").cast("int"))
        both = sharing.join(F.broadcast(answers) if total <= SHARED_ANSWERS else answers, vector)
        out.append(both.select("id", F.posexplode(left).alias("at", "t")).withColumn("rank", F.col("at") + 1).select(*columns))
    alone = asks.where(F.size("barred") > SHARED_BARRED)
    if not alone.isEmpty():
        own = exclude.select(F.col(query).cast("long").alias("id"), item)
        rest = dense_topk(alone, items, k, exclude=own, query="id", item=item, vector=vector, k_column="most")
        out.append(rest.select(F.col("id").alias(query), item, "score", "rank"))
    if not out:
        return dense_topk(queries, items, k, exclude=exclude, query=query, item=item, vector=vector, k_column=k_column)
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
