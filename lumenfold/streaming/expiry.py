"""Streams whose state ends: user lists that idle users lose, sessions, and suppression over sliding windows."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.state import HISTORY, user_state
from .state import apply_event

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "user_id long, positives array<long>, negatives array<long>, held long, expired boolean"


@contextmanager
def disk_state(spark: SparkSession):
    """State on the executors' disks, which lists and timers need; the session's own store is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class RecentLists(StatefulProcessor):
    """A user's newest events, and a timer that drops them when the user has been idle."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at long, id long, save boolean, paper_id long")

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        for batch in rows:
            held += zip(*(batch[c].tolist() for c in ("at", "id", "save", "paper_id")), strict=True)
        held = sorted(held, key=lambda e: e[:2])[-HISTORY:]
        self.events.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[-1][0] // 1000 + self.idle_ms)
        positives, negatives = [], []
        for _, _, save, paper in held:
            apply_event(positives, negatives, "save" if save else "not_interested", paper)
        yield pd.DataFrame({"user_id": [key[0]], "positives": [positives], "negatives": [negatives], "held": [len(held)], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.events.clear()
        yield pd.DataFrame({"user_id": [key[0]], "positives": [[]], "negatives": [[]], "held": [0], "expired": [True]})

    def close(self) -> None:
        pass


def stream_recent_lists(events: DataFrame, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """``user_id``, ``positives``, ``negatives``, ``held`` (events in state), ``expired``: lists of active users.

    Whose last event the watermark has passed by ``idle`` loses the state, which is told by a row with ``expired``.  Lists
    of users who come back, or are new, hold only what came since; ``hydrated`` completes them.  Runs under ``disk_state``.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    own = events.where(F.col("event_type").isin("save", "not_interested") & F.col("user_id").isNotNull())
    timed = own.withColumn("time", F.col("timestamp").cast("timestamp")).withWatermark("time", late)
    rows = timed.select("user_id", "time", F.unix_micros("time").alias("at"), "id", (F.col("event_type") == "save").alias("save"), "paper_id")
    return rows.groupBy("user_id").transformWithStateInPandas(RecentLists(idle_ms), OUTPUT, "Update", "EventTime")


def hydrated(batch: DataFrame, log: DataFrame) -> DataFrame:
    """``user_id``, ``positives``, ``negatives`` of a trigger's rows; state too young to be whole is made anew from the log.

    ``log`` holds all events up to the trigger.  Only users with fewer than ``HISTORY`` events in state are looked up in it.
    """
    live = batch.where("NOT expired")
    young = live.where(F.col("held") < HISTORY).select("user_id")
    fresh = user_state(log.join(young, "user_id", "left_semi"))
    return live.where(F.col("held") >= HISTORY).select("user_id", "positives", "negatives").union(fresh.select("user_id", "positives", "negatives"))


def stream_sessions(events: DataFrame, gap_minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """``user_id``, ``start``, ``end``, ``n``: runs of events no farther apart than the gap; a late event may join two of them."""
    timed = events.withColumn("time", F.col("timestamp").cast("timestamp")).withWatermark("time", late)
    # Windows that only touch stay apart, so the gap is a microsecond longer.
    window = F.session_window("time", f"{gap_minutes} minutes 1 microsecond")
    found = timed.groupBy("user_id", window.alias("w")).agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("n"))
    return found.select("user_id", "start", "end", "n")


def stream_suppressed(events: DataFrame, papers: DataFrame, days: int = 14, least: int = 3, late: str = "1 hour") -> DataFrame:
    """``as_of``, ``user_id``, ``category``, ``n``: categories dismissed at least so often in the ``days`` before each day.

    ``papers`` (``paper_id``, ``category``) is a table beside the stream.
    """
    own = events.where("event_type = 'not_interested'").join(papers.select("paper_id", "category").where("category <> ''"), "paper_id")
    timed = own.withColumn("time", F.col("timestamp").cast("timestamp")).withWatermark("time", late)
    counted = timed.groupBy(F.window("time", f"{days} days", "1 day").alias("w"), "user_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least).select(F.col("w.end").alias("as_of"), "user_id", "category", "n")
