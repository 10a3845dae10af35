"""Hard negatives by distributed radix selection.

Every anchor has windows of scores.  To find a window's k-th best row, tasks count its scores by digit (of the distance
from the window's top) for their share of the rows; the counts are summed in Spark, which tells the bucket of the k-th;
the next pass counts the next digit inside that bucket only.  After the last digit the k-th score is known, and a last
pass gathers the rows that reach it: k of them, and ties.  Anchors and rows meet in cells of a grid whose sides are
bounded, so no cell grows with the table or with a frequent label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batches, staged
from .topk import quantise

#: Rows in a packed block, about the rows and the anchors of a cell at most, and the cells of a smaller table.
BLOCK_ROWS, CELL_ROWS, CELL_ANCHORS, CELLS = 512, 16384, 2048, 24
#: Bits of a digit at most, and anchors scored at once.
DIGIT_BITS, STEP = 10, 256


def relabelled(table: DataFrame) -> DataFrame:
    """The registered query's labels: one further, modulo 10, where ``vec_id`` is divisible by 7."""
    return table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def _floor_percent(score: str, percent: int) -> Column:
    """floor(score * percent / 100) in whole numbers, for scores whose product would not fit."""
    return F.expr(f"(({score}) - pmod({score}, 100)) div 100 * {percent} + pmod({score}, 100) * {percent} div 100")


def _packed(vectors: DataFrame) -> DataFrame:
    """Blocks of rows of one dimension: ids, labels and components as bytes, components in two bytes where they fit."""

    def pack(batches):
        for batch in batches:
            sizes = batch["v"].map(len)
            for dim in np.unique(sizes):
                own = batch[sizes == dim]
                for at in range(0, len(own), BLOCK_ROWS):
                    part = own.iloc[at : at + BLOCK_ROWS]
                    rows = np.stack([np.asarray(v, dtype=np.int64) for v in part["v"]])
                    most = int(np.abs(rows).max())
                    kind = np.int16 if most < 1 << 15 else np.int64
                    ids, labels = (part[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label"))
                    yield pd.DataFrame([{"dim": dim, "most": most, "ids": ids, "labels": labels, "rows": rows.astype(kind).tobytes()}])

    packed = vectors.select("vec_id", "label", "v").mapInPandas(pack, "dim int, most long, ids binary, labels binary, rows binary")
    return staged(packed.withColumn("block", F.monotonically_increasing_id()), "hardneg-blocks")


def _scores(rows: np.ndarray, block: dict) -> np.ndarray:
    """Integer inner products of anchors by rows; floats hold them where no sum can pass their whole numbers."""
    bound = float(np.abs(rows).max(initial=0)) * block["most"] * rows.shape[1]
    for kind, limit in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if bound < limit:
            return (rows.astype(kind) @ block["rows"].astype(kind).T).astype(np.int64)
    return rows @ block["rows"].astype(np.int64).T


def _meetings(anchors: pd.DataFrame, blocks: pd.DataFrame, same: bool):
    """(first, last, scores, which may be chosen, row ids) for each step of anchors and each block of a cell."""
    own_ids, own_labels = anchors["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
    rows = np.stack([np.asarray(v, dtype=np.int64) for v in anchors["v"]])
    held = []
    for r in blocks.itertuples():
        kind = np.int16 if r.most < 1 << 15 else np.int64
        held.append({"most": r.most, "ids": np.frombuffer(r.ids, np.int64), "labels": np.frombuffer(r.labels, np.int64), "rows": np.frombuffer(r.rows, kind).reshape(-1, rows.shape[1])})
    for at in range(0, len(rows), STEP):
        part = slice(at, at + STEP)
        for block in held:
            alike = own_labels[part][:, None] == block["labels"]
            yield part, _scores(rows[part], block), (alike if same else ~alike) & (own_ids[part][:, None] != block["ids"]), block["ids"]


def _ranges(anchors: pd.DataFrame, low: str, high: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window numbers, lows and highs of each anchor, filled up with empty windows."""
    most = max(len(w) for w in anchors["windows"])
    numbers, lows, highs = np.zeros((len(anchors), most), dtype=np.int32), np.ones((len(anchors), most), dtype=np.int64), np.zeros((len(anchors), most), dtype=np.int64)
    for i, own in enumerate(anchors["windows"]):
        for j, w in enumerate(own):
            numbers[i, j], lows[i, j], highs[i, j] = w["j"], w[low], w[high]
    return numbers, lows, highs


class _Grid:
    """Where anchors and packed rows meet: both are dealt by hash, each cell holds a bounded share of either."""

    def __init__(self, anchors: DataFrame, blocks: DataFrame, n_anchors: int, n_rows: int):
        self.anchors, self.blocks = anchors, blocks
        self.groups = max(1, -(-n_anchors // CELL_ANCHORS))
        self.parts = max(1, -(-n_rows // CELL_ROWS), min(CELLS, n_rows // (2 * BLOCK_ROWS)))

    def meet(self, windows: DataFrame, function, schema: str) -> DataFrame:
        """``function(anchors with their windows, blocks)`` of each cell."""
        asked = windows.groupBy("no").agg(F.collect_list(F.struct("j", "top", "high", "low")).alias("windows")).join(self.anchors, "no")
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumn("group", F.pmod(F.xxhash64("no"), F.lit(self.groups)).cast("int")).withColumn("part", numbers(self.parts))
        right = self.blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(self.parts)).cast("int")).withColumn("group", numbers(self.groups))
        cell = ["dim", "part", "group"]

        def run(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            found = function(anchors, blocks) if len(anchors) and len(blocks) else []
            return pd.concat(found) if found else pd.DataFrame({c.split()[0]: pd.Series(dtype=np.int64) for c in schema.split(", ")})

        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(run, schema)


def _count_digits(shift: int, buckets: int, same: bool):
    def count(anchors: pd.DataFrame, blocks: pd.DataFrame) -> list:
        numbers, lows, highs = _ranges(anchors, "low", "high")
        most = numbers.shape[1]
        owners, frames = anchors["no"].to_numpy(np.int64), []

        def told(part: slice, sums: np.ndarray) -> None:
            at = np.flatnonzero(sums)
            window, bucket = np.divmod(at, buckets)
            row, j = np.divmod(window, most)
            frames.append(pd.DataFrame({"no": owners[part][row], "j": numbers[part][row, j], "bucket": bucket, "n": sums[at]}))

        counts, last = None, None
        for part, scores, allowed, _ in _meetings(anchors, blocks, same):
            if part != last:
                if counts is not None:
                    told(last, counts)
                counts, last = np.zeros(len(scores) * most * buckets, dtype=np.int64), part
            for j in range(most):
                high = highs[part, j][:, None]
                row, column = np.nonzero(allowed & (scores <= high) & (scores >= lows[part, j][:, None]))
                digit = (high[row, 0] - scores[row, column]) >> shift
                counts += np.bincount((row * most + j) * buckets + digit, minlength=len(counts))
        told(last, counts)
        return frames

    return count


def _gather(k: int, same: bool):
    def gather(anchors: pd.DataFrame, blocks: pd.DataFrame) -> list:
        numbers, lows, tops = _ranges(anchors, "low", "top")
        owners, out = anchors["no"].to_numpy(np.int64), []
        for part, scores, allowed, ids in _meetings(anchors, blocks, same):
            for j in range(numbers.shape[1]):
                row, column = np.nonzero(allowed & (scores <= tops[part, j][:, None]) & (scores >= lows[part, j][:, None]))
                value, name = scores[row, column], ids[column]
                order = np.lexsort([name, -value, row])
                row, value, name = row[order], value[order], name[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"no": owners[part][row[kept]], "j": numbers[part, j][row[kept]], "vec_id": name[kept], "score": value[kept]}))
        return out

    return gather


def radix_select(grid: _Grid, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """``no``, ``j``, ``vec_id``, ``score``, ``rank`` of the k best rows in each window, ties to smaller ids.

    ``windows``: ``no`` of an anchor, ``j``, ``low`` and ``high`` (both inclusive).  Rows of the anchor's own id take no part; their
    labels must be the anchor's (``same``) or differ from it.
    """
    spark = windows.sparkSession
    state = windows.where("low <= high").select("no", "j", F.col("high").alias("top"), "high", "low", F.lit(k).cast("long").alias("need"))
    state = staged(state, "hardneg-windows")
    width = state.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    bits = int(width or 0).bit_length()
    passes = -(-bits // DIGIT_BITS)
    digit = -(-bits // passes) if passes else 0
    with arrow_batches(spark, 1024):
        for i in reversed(range(passes)):
            counts = grid.meet(state.where("need > 0"), _count_digits(i * digit, 1 << digit, same), "no long, j int, bucket long, n long")
            counts = counts.groupBy("no", "j", "bucket").agg(F.sum("n").alias("n"))
            so_far = F.sum("n").over(W.partitionBy("no", "j").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
            open_ = state.where("need > 0")
            reached = counts.withColumn("so_far", so_far).join(open_.select("no", "j", "need"), ["no", "j"]).where("so_far >= need")
            reached = reached.groupBy("no", "j").agg(F.min_by(F.struct("bucket", "n", "so_far"), "bucket").alias("b"))
            high = F.col("high") - F.shiftleft(F.col("b.bucket"), i * digit)
            low = F.greatest(F.col("low"), high - (1 << i * digit) + 1)
            # Windows with too few rows are wholly qualified, as are those whose bucket ends with the k-th: need 0.
            need = F.when(F.col("b").isNull() | (F.col("b.so_far") == F.col("need")), 0).otherwise(F.col("need") - F.col("b.so_far") + F.col("b.n"))
            narrowed = open_.join(reached, ["no", "j"], "left").select(
                "no", "j", "top", F.when(F.col("b").isNull(), F.col("high")).otherwise(high).alias("high"),
                F.when(F.col("b").isNull(), F.col("low")).otherwise(low).alias("low"), need.cast("long").alias("need"),
            )
            state = staged(narrowed.union(state.where("need = 0")), "hardneg-windows")
        found = staged(grid.meet(state, _gather(k, same), "no long, j int, vec_id long, score long"), "hardneg-found")
    rank = F.row_number().over(W.partitionBy("no", "j").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, anchors_where: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows that meet ``anchors_where`` (a condition on ``vec_id``).  A row's score is its integer inner product with the
    anchor, components being floor(256 * x); higher scores come first, ties by smaller id.  Each anchor's first rows of its
    label are its positives; for each of them the first rows of other labels are returned whose score is between ``low`` and
    ``high`` percent of the positive's.  Rows without an id or label, and vectors that are null, empty or hold null or
    non-finite components take no part; labels are integers; vectors meet those of their own dimension.  Fewer rows than asked for
    give fewer results, anchors without positives and an empty table none.  Repeated rows are candidates each; an anchor's id
    that occurs repeatedly is answered for each of its rows, none of which is its candidate.  Other columns are left out.
    """
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), quantise(vector).alias("v"))
    rows = staged(rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").withColumn("no", F.monotonically_increasing_id()), "hardneg-rows")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    anchors = staged(rows.where(anchors_where).select("no", F.size("v").alias("dim"), "vec_id", "label", "v", size.alias("size")), "hardneg-anchors")
    n_rows, largest = rows.agg(F.count(F.lit(1)), F.max(size)).first()
    grid = _Grid(anchors.drop("size"), _packed(rows), anchors.count(), n_rows)
    # No inner product is larger than the product of the norms, which are rounded up here.
    reach = (F.col("size") * F.lit(largest or 0.0) * (1 + 1e-9)).cast("long") + 1
    chosen = radix_select(grid, anchors.select("no", F.lit(0).alias("j"), (-reach).alias("low"), reach.alias("high")), positives, same=True)
    chosen = staged(chosen.select("no", F.col("rank").alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "hardneg-positives")
    asked = chosen.select("no", "j", (-_floor_percent("-positive_score", low)).alias("low"), _floor_percent("positive_score", high).alias("high"))
    found = radix_select(grid, asked, negatives, same=False)
    named = found.join(chosen, ["no", "j"]).join(anchors.select("no", F.col("vec_id").alias("anchor_id")), "no")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
