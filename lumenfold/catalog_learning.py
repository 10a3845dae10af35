"""Registered queries on time: as-of and interval joins, features as of an event, and the ranker learned from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .operators import lambdamart
from .operators.asof import asof_join, interval_join
from .plans import learning
from .sources.tables import interactions
from .sources.tables import vectors as vector_table


@query("asof_last_save", """
    SELECT c.id, c.user_id, s.paper_id AS last_paper, s.timestamp AS last_time
    FROM (SELECT * FROM interactions WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT * FROM interactions WHERE event_type = 'save') s ON c.user_id = s.user_id AND c.timestamp > s.timestamp""", "interactions")  # fmt: skip
def asof_last_save(spark, sf):
    """What each user had saved last before each click."""
    events = interactions(spark, sf)
    saves = events.where("event_type = 'save'").select("user_id", "timestamp", F.col("timestamp").alias("last_time"), F.col("paper_id").alias("last_paper"))
    return asof_join(events.where("event_type = 'click'").select("id", "user_id", "timestamp"), saves, "user_id", "timestamp", ["last_time", "last_paper"]).drop("timestamp")


@query("clicks_after_onboarding", """
    SELECT c.id, o.id AS onboarding_id FROM interactions c JOIN interactions o ON c.user_id = o.user_id AND c.timestamp >= o.timestamp AND c.timestamp < o.timestamp + INTERVAL 3 DAY
    WHERE c.event_type = 'click' AND o.event_type = 'onboarding'""", "interactions")  # fmt: skip
def clicks_after_onboarding(spark, sf):
    """Clicks within three days of each onboarding event of their user."""
    events = interactions(spark, sf)
    spans = events.where("event_type = 'onboarding'").select("user_id", F.col("id").alias("onboarding_id"), F.col("timestamp").alias("start"), (F.col("timestamp") + F.expr("interval 3 days")).alias("end"))
    return interval_join(events.where("event_type = 'click'").select("id", "user_id", "timestamp"), spans, "user_id", "timestamp", "start", "end").select("id", "onboarding_id")


@query("point_in_time_counts", """
    WITH known AS (SELECT i.* FROM interactions i JOIN vectors USING (paper_id)), shown AS (SELECT * FROM known WHERE event_type IN ('save', 'click', 'view', 'not_interested'))
    SELECT s.id, CASE event_type WHEN 'save' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS label,
      (SELECT count(*) FROM known b WHERE b.user_id = s.user_id AND b.timestamp < s.timestamp AND b.event_type = 'save') AS saves_before,
      (SELECT count(*) FROM known b WHERE b.user_id = s.user_id AND b.timestamp < s.timestamp AND b.event_type = 'not_interested') AS dismissals_before
    FROM shown s""", "interactions", "vectors")  # fmt: skip
def point_in_time_counts(spark, sf):
    """The counts among the training table's features; its similarities are held against a plain version in the tests."""
    table = learning.training_table(interactions(spark, sf), vector_table(spark, sf))
    count = lambda name: F.col("features")[learning.FEATURES.index(name)].cast("long").alias(name)
    return table.select("id", "label", count("saves_before"), count("dismissals_before"))


@query("lambdamart_rank")
def lambdamart_rank(spark, sf):
    """Events of the last fifth of time, ranked by trees fitted on those before."""
    trees, late = learning.learned(interactions(spark, sf), vector_table(spark, sf))
    return learning.ranked(late, lambdamart.predict(trees)).select(F.col("query_id").alias("group"), F.col("paper_id").alias("id"), "rank")
