"""Registered queries over stored rollups and over tables read by pages."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from .catalog import _NAMED, named, query
from .operators import rollups
from .sources.paged import read_pages, write_pages
from .sources.staging import shared_root
from .sources.tables import papers, read

_BY = ["day", "category"]
_SHARES = [0.1, 0.5, 0.9]
_SPENT = f"{_NAMED}, spent AS (SELECT ts::DATE AS day, category, user_id, value FROM events JOIN named ON paper_id = (props->>'$.k')::BIGINT)"
_RATIO = math.log((1 + rollups.ACCURACY) / (1 - rollups.ACCURACY))


def _folder(spark, name: str) -> str:
    return f"{shared_root(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"


def _stored(spark, sf):
    """The rows of all days, stored: values and users by day and category of the paper."""
    events = read(spark, sf, "events").select(F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("long").alias("paper_id"), "user_id", "value")
    path = _folder(spark, "rollups")
    rollups.refresh(events.join(named(spark, sf).select("paper_id", "category"), "paper_id"), path, "day", ["category"], "value", "user_id")
    return rollups.stored(spark, path)


@query("rollup_measures", f"""WITH {_SPENT} SELECT bit_count(grouping(day, category)::INT)::INT AS level, day, category, count(*)::BIGINT AS n, round(sum(value), 4) AS total
    FROM spent GROUP BY ROLLUP (day, category)""", "papers")  # fmt: skip
def rollup_measures(spark, sf):
    return rollups.rolled(_stored(spark, sf)[0], _BY).select("level", *_BY, "n", F.round("total", 4).alias("total"))


@query("rollup_members")
def rollup_members(spark, sf):
    """Distinct users, estimated; held against ``rollup_members_exact`` in the tests."""
    return rollups.rolled(_stored(spark, sf)[0], _BY).select("level", *_BY, "members")


@query("rollup_members_exact", f"""WITH {_SPENT} SELECT bit_count(grouping(day, category)::INT)::INT AS level, day, category, count(DISTINCT user_id) AS members
    FROM spent GROUP BY ROLLUP (day, category)""", "papers")  # fmt: skip
def rollup_members_exact(spark, sf):
    """From the events themselves, at every level."""
    events = read(spark, sf, "events").select(F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("long").alias("paper_id"), "user_id")
    spent = events.join(named(spark, sf).select("paper_id", "category"), "paper_id")
    return spent.rollup(*_BY).agg(F.bit_count(F.grouping_id()).alias("level"), F.count_distinct("user_id").alias("members")).select("level", *_BY, "members")


@query("rollup_quantiles", f"""WITH {_SPENT},
    b AS (SELECT day, category, CASE WHEN value = 0 THEN 0 ELSE sign(value) * (ceil(ln(abs(value)) / {_RATIO!r}) + 1048576) END::BIGINT AS bucket FROM spent WHERE isfinite(value)),
    g AS (SELECT bit_count(grouping(day, category)::INT)::INT AS level, day, category, bucket, count(*) AS n FROM b GROUP BY GROUPING SETS ((day, category, bucket), (day, bucket), (bucket))),
    c AS (SELECT *, sum(n) OVER (PARTITION BY level, day, category ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, day, category) AS every FROM g)
    SELECT level, day, category, share, round(CASE WHEN bucket = 0 THEN 0 ELSE sign(bucket) * 2 * exp((abs(bucket) - 1048576) * {_RATIO!r}) / ({(1 + rollups.ACCURACY) / (1 - rollups.ACCURACY)!r} + 1) END, 6) AS value
    FROM c, (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS share) WHERE upto >= greatest(1, ceil(share * every)) AND upto - n < greatest(1, ceil(share * every))""", "papers")  # fmt: skip
def rollup_quantiles(spark, sf):
    return rollups.quantiles(_stored(spark, sf)[1], _BY, _SHARES).withColumn("value", F.round("value", 6))


@query("paged_metadata", "SELECT paper_id, arxiv_id, title, citation_count FROM papers", "papers")
def paged_metadata(spark, sf):
    """All metadata rows, stored as pages and read back by them."""
    rows = papers(spark, sf).select("paper_id", "arxiv_id", "title", "citation_count")
    return read_pages(spark, write_pages(rows, _folder(spark, "pages"), "paper_id"), rows.schema, "paper_id")
