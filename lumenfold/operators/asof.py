"""Joins on time: the last row before an event, and the interval around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bucket(time, seconds: int):
    return F.floor(F.unix_seconds(time.cast("timestamp")) / seconds)


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` with its ``key`` and an earlier ``time``; nulls where there is none.

    Rows at the very time are not earlier, so an event never sees itself.  Of rows at one time the largest ``columns`` count.
    Both sides are sorted within a key and a bucket of time, so no task holds a frequent key's whole history; what a
    bucket inherits is the last row of those before it, found from one row per key and bucket.  Rows of ``left`` without
    key or time get nulls.
    """
    kept = left.columns
    payload = F.struct(*[F.col(c) for c in columns])
    known = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("__key"), F.col(time).alias("__time"), payload.alias("__right"))
    known = known.withColumn("__bucket", _bucket(F.col("__time"), bucket_seconds))
    rows = left.withColumns({"__key": F.col(key), "__time": F.col(time), "__bucket": _bucket(F.col(time), bucket_seconds)})
    asked = rows.select(F.struct(*[F.col(c) for c in kept]).alias("__left"), "__key", "__time", "__bucket", F.lit(None).cast(known.schema["__right"].dataType).alias("__right"))
    both = asked.unionByName(known.withColumn("__left", F.lit(None).cast(asked.schema["__left"].dataType)))
    # Questions come before answers of the same time.
    order = W.partitionBy("__key", "__bucket").orderBy("__time", F.col("__left").isNull(), "__right").rowsBetween(W.unboundedPreceding, 0)
    within = both.withColumn("__own", F.last("__right", ignorenulls=True).over(order)).where(F.col("__left").isNotNull())
    ends = known.groupBy("__key", "__bucket").agg(F.max(F.struct("__time", "__right"))["__right"].alias("__end"))
    # A question's bucket inherits the end of the nearest bucket before it: both are one row per key and bucket here.
    slots = asked.select("__key", "__bucket").where("__key IS NOT NULL AND __bucket IS NOT NULL").distinct().join(ends, ["__key", "__bucket"], "full")
    earlier = W.partitionBy("__key").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    inherited = slots.withColumn("__before", F.last("__end", ignorenulls=True).over(earlier)).where("__before IS NOT NULL").select("__key", "__bucket", "__before")
    found = within.join(inherited, ["__key", "__bucket"], "left").withColumn("__found", F.coalesce("__own", "__before"))
    return found.select(*[F.col("__left").getField(c).alias(c) for c in kept], *[F.col("__found").getField(c).alias(c) for c in columns])


def interval_join(events: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """``events`` with each of the ``intervals`` of their ``key`` that they fall into (from ``start``, before ``end``).

    Intervals are dealt to the buckets of time they touch, so the join is on equality of key and bucket, and a row meets only
    intervals about its time.  Empty and reversed intervals, and nulls, meet nothing.
    """
    low, high = _bucket(F.col(start), bucket_seconds), _bucket(F.col(end), bucket_seconds)
    dealt = intervals.where(F.col(start) < F.col(end)).withColumn("__bucket", F.explode(F.sequence(low, high)))
    timed = events.withColumn("__bucket", _bucket(F.col(time), bucket_seconds))
    return timed.join(dealt, [key, "__bucket"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("__bucket")
