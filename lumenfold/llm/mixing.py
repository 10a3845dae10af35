"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, small, staged, word_count

#: Independent hash seeds tried per source; eight 32-bit draws fill one SHA-256 digest.
SEEDS = 8


def _digest(key: str, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), as_text(key)), 256)


def _draw(digest: Column, index: Column) -> Column:
    """Draw ``index`` (0 to 7) of a digest: eight hexadecimal digits as a fraction of 2**32."""
    return F.conv(F.substring(digest, index * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Target words per source, from one row per source: ``source``, ``source_size``.

    Sources in code-point order, null last, take ``weights`` in turn and share the whole of all sizes.  A target stops
    at ``most`` times its source's size and the excess goes to the others by weight, again and again.  Sorted by the
    level (cap over weight) at which each source stops, the stopped sources come first; so running sums find the final
    level at once: the first source, in that order, whose cap is not below the level of those not yet stopped.
    The table has a row per source; its windows run in one task.
    """
    everything = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "rank", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap"))
    order = W.orderBy(F.col("cap").cast("double") / F.col("weight"), "rank")
    swept = ranked.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
            "step": F.row_number().over(order),
        }
    )
    free = F.col("cap") * F.col("open") >= F.col("weight") * F.col("left")
    first = F.min(F.when(free, F.struct("step", "left", "open"))).over(everything)
    swept = swept.withColumn("level", first)
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open").cast("double")
    stopped = F.col("level").isNull() | (F.col("step") < F.col("level.step"))
    return swept.select("source", "source_size", F.when(stopped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mixing_rates(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Rates per source from rows of ``source``, ``size`` and ``digest``: ``whole`` copies for each document and a
    ``fraction`` for one more, with the ``pick`` of the eight seeds whose draws bring the source nearest to its target.

    Whatever the seed, each document's extra copy is an independent Bernoulli draw; choosing among a few seeds only
    takes the luck out of small sources and of small fractions.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.withColumn("whole", F.floor(rate).cast("long")).withColumn("fraction", rate - F.col("whole"))
    rates = staged(rates, "mixing-rates")
    drawn = sized.join(small(rates).alias("r"), sized["source"].eqNullSafe(F.col("r.source")))
    extra = [
        F.sum(F.when(_draw(F.col("digest"), F.lit(j)) < F.col("fraction"), F.col("size")).otherwise(F.lit(0))).alias(f"extra{j}")
        for j in range(SEEDS)
    ]
    keys = ["source", "source_size", "target", "whole", "fraction"]
    sums = drawn.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(*extra)
    off = [
        F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"extra{j}") - F.col("target")).alias("off"), F.lit(j).alias("pick"))
        for j in range(SEEDS)
    ]
    return staged(sums.select(*keys, F.array_min(F.array(*off))["pick"].alias("pick")), "mixing-picks")


def copies(digest: Column) -> Column:
    """How often a row is taken, given its rate's columns."""
    return F.col("whole") + (_draw(digest, F.col("pick")) < F.col("fraction")).cast("long")


def _sized(docs: DataFrame, key: str, source: str, text: str, seed: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), _digest(key, seed).alias("digest"))
    return staged(rows, "mixing-sizes")


def mixing_plan(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: str = "mix", key="doc_id", source="source", text="text") -> DataFrame:
    """What the mix takes of every document: ``doc_id``, ``size`` (words), ``source_size``, ``target``, ``taken``, ``copies``.

    A copy count depends on the key, the seed and the rates alone, so reruns agree and no row moves between tasks: the
    texts are read once, the sums per source are partly made before the exchange, and the rates (a row per source,
    counted first) are broadcast.  Null text: no words.  Null source: a source of its own, the last.  Repeated rows and
    null keys draw alike.  A source without words has target 0 and is not taken.  An empty table gives no rows.
    """
    sized = _sized(docs, key, source, text, seed)
    rates = small(mixing_rates(sized, weights, most)).alias("r")
    joined = sized.alias("d").join(rates, F.col("d.source").eqNullSafe(F.col("r.source")))
    n = copies(F.col("d.digest"))
    return joined.select("d.doc_id", "d.size", "r.source_size", "r.target", (n * F.col("d.size")).alias("taken"), n.alias("copies"))


def mix_sources(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: str = "mix", key="doc_id", source="source", text="text") -> DataFrame:
    """The mix itself: every row of ``docs`` with all its columns, as often as ``mixing_plan`` says."""
    rates = mixing_rates(_sized(docs, key, source, text, seed), weights, most)
    rates = small(rates.select(F.col("source").alias("__mix_source"), "whole", "fraction", "pick").select("__mix_source", F.struct("whole", "fraction", "pick").alias("__mix_rate")))
    joined = docs.join(rates, docs[source].eqNullSafe(F.col("__mix_source")))
    rate = F.col("__mix_rate")
    n = rate["whole"] + (_draw(_digest(key, seed), rate["pick"]) < rate["fraction"]).cast("long")
    repeated = joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), n.cast("int"))))
    return repeated.select(*[docs[c] for c in docs.columns])
