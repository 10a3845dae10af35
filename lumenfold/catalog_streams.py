"""Registered queries over streams whose state ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _NAMED, _drained, _event_stream, named, query
from .streaming.expiry import disk_state, stream_recent_lists, stream_sessions, stream_suppressed


@query("stream_sessions", """
    WITH f AS (SELECT *, coalesce(timestamp - lag(timestamp) OVER u > INTERVAL 60 MINUTE, true)::INT AS fresh FROM interactions WINDOW u AS (PARTITION BY user_id ORDER BY timestamp, id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY timestamp, id) AS session FROM f)
    SELECT user_id, min(timestamp) AS start, max(timestamp) AS "end", count(*) AS n FROM s GROUP BY user_id, session""", "interactions")  # fmt: skip
def sessions_of_stream(spark, sf):
    return _drained(spark, stream_sessions(_event_stream(spark, sf)), "lumenfold_sessions", "complete")


@query("stream_suppressed", f"""
    WITH {_NAMED}, days AS (SELECT unnest(generate_series((SELECT min(timestamp)::DATE FROM interactions) + 1, (SELECT max(timestamp)::DATE FROM interactions) + 14, INTERVAL 1 DAY))::TIMESTAMP AS as_of)
    SELECT as_of, user_id, category, count(*) AS n FROM days JOIN interactions i ON i.timestamp >= as_of - INTERVAL 14 DAY AND i.timestamp < as_of JOIN named USING (paper_id)
    WHERE event_type = 'not_interested' AND category <> '' GROUP BY ALL HAVING count(*) >= 3""", "interactions", "papers")  # fmt: skip
def suppressed_of_stream(spark, sf):
    """For every day, what ``suppressed_categories`` says of it."""
    stream = stream_suppressed(_event_stream(spark, sf), named(spark, sf))
    return _drained(spark, stream, "lumenfold_suppressed", "complete").withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


@query("stream_recent_lists", """
    WITH own AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS r FROM interactions WHERE event_type IN ('save', 'not_interested'))
    SELECT user_id, least(count(*), 70) AS held FROM own GROUP BY user_id""", "interactions")  # fmt: skip
def recent_lists_of_stream(spark, sf):
    """The events that the state of each user holds; its lists are held against the batch form in the tests."""
    with disk_state(spark):
        rows = _drained(spark, stream_recent_lists(_event_stream(spark, sf), idle="365 days"), "lumenfold_recent", "update")
    return rows.groupBy("user_id").agg(F.max("held").alias("held"))
