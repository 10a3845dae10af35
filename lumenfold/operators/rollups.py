"""Rollups that can be added up: counts, sums, distinct users and quantiles per day and category, at every level above.

Stored once per day; levels above are merged from the stored rows and never read the events again.  Distinct counts are
HyperLogLog sketches, quantiles are counts of values in buckets of a constant ratio, which merge by plain sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import replace_partitions

#: Relative error of quantiles, at most.
ACCURACY = 0.01
#: Binary logarithm of a distinct count's registers: the standard error is about 1.04 / sqrt(2^12) = 1.6 %.
REGISTERS = 12
#: Added to a bucket's number, so that its sign can be the value's.
_SHIFT = 1 << 20


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """The number of a value's bucket, in the order of values; null for null, NaN and infinite ones."""
    ratio = math.log((1 + accuracy) / (1 - accuracy))
    size = F.ceil(F.ln(F.abs(value)) / ratio) + _SHIFT
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * size)).cast("long")


def bucket_value(number: Column, accuracy: float = ACCURACY) -> Column:
    """The value that is within ``accuracy`` of all in the bucket."""
    ratio = math.log((1 + accuracy) / (1 - accuracy))
    size = 2 * F.exp((F.abs(number) - _SHIFT) * ratio) / ((1 + accuracy) / (1 - accuracy) + 1)
    return F.when(number == 0, F.lit(0.0)).otherwise(F.signum(number) * size)


def measured(events: DataFrame, by: Sequence[str], value: str, member: str) -> DataFrame:
    """One row per group of ``by``: ``n``, ``total`` of ``value``, ``members`` (a sketch of the distinct ``member``)."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.hll_sketch_agg(member, REGISTERS).alias("members"))


def bucketed(events: DataFrame, by: Sequence[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """One row per group of ``by`` and bucket: ``bucket``, ``n``.  Values without a bucket take no part."""
    return events.withColumn("bucket", bucket(F.col(value), accuracy)).where("bucket IS NOT NULL").groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def rolled(measures: DataFrame, by: Sequence[str]) -> DataFrame:
    """``level`` (how many columns of ``by`` are summed up, from the right), ``by``, ``n``, ``total``, ``members`` (estimated)."""
    merged = measures.rollup(*by).agg(F.grouping_id().alias("grouped"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("members")).alias("members"))
    return merged.select(F.bit_count("grouped").alias("level"), *by, "n", "total", "members")


def quantiles(buckets: DataFrame, by: Sequence[str], shares: Sequence[float], accuracy: float = ACCURACY) -> DataFrame:
    """``level``, ``by``, ``share``, ``value``: of each group at each level, the value below which the share of rows lies.

    A group's window holds its buckets, whose number the range of values bounds (about 35,000 for all positive doubles),
    not its rows.
    """
    sets = [[*by[:i], "bucket"] for i in range(len(by), -1, -1)]
    merged = buckets.groupingSets(sets, *by, "bucket").agg(F.bit_count(F.grouping_id()).alias("level"), F.sum("n").alias("n"))
    group = W.partitionBy("level", *by)
    counted = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})
    asked = counted.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    need = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("all")))
    hit = asked.where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need))
    return hit.select("level", *by, "share", bucket_value(F.col("bucket"), accuracy).alias("value"))


def refresh(events: DataFrame, path: str, day: str, by: Sequence[str], value: str, member: str) -> None:
    """Replace the stored rows of the days in ``events``, all of whose rows must be given; other days stay.

    So late events need their days alone to be read again.  Repeating it changes nothing.
    """
    keys = [day, *by]
    replace_partitions(measured(events, keys, value, member), f"{path}/measures", [day])
    replace_partitions(bucketed(events, keys, value), f"{path}/buckets", [day])


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The measures and buckets under ``path``."""
    return spark.read.parquet(f"{path}/measures"), spark.read.parquet(f"{path}/buckets")
