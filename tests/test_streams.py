"""Streams over several triggers: state that ends and is made anew, sessions that late events join, sliding windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import state
from lumenfold.streaming.expiry import disk_state, hydrated, stream_recent_lists, stream_sessions, stream_suppressed

SHAPE = "id long, user_id long, paper_id long, event_type string, timestamp timestamp_ntz"
START = dt.datetime(2024, 1, 1)


def event(i, user, paper, kind, hours):
    return (i, user, paper, kind, START + dt.timedelta(hours=hours))


class Log:
    """A folder that a stream reads file by file, and restarts from where it stopped."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.rows = spark, folder, []

    def add(self, rows):
        self.rows += rows
        self.spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(str(self.folder / "log"))

    def table(self):
        return self.spark.createDataFrame(self.rows, SHAPE)

    def run(self, stream, mode, write):
        events = self.spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "log"))
        query = stream(events).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", str(self.folder / "c")).trigger(availableNow=True).start()
        query.awaitTermination()


def test_idle_users_lose_state_and_get_it_back_from_the_log(spark, tmp_path):
    log, told = Log(spark, tmp_path), []
    lists = lambda df: {r["user_id"]: (r["positives"], r["negatives"]) for r in df.collect()}

    def write(batch, _):
        told.append((batch.select("user_id", "held", "expired").collect(), lists(hydrated(batch, log.table()))))

    stages = [
        [event(i, 1 + i % 2, i % 9, "save" if i % 4 else "not_interested", i / 10) for i in range(100)],
        [event(200 + i, 2, 20 + i, "save", 24 * 10 + i) for i in range(5)],  # user 1 is idle for ten days
        [event(300, 2, 40, "save", 24 * 20)],
        [event(400, 1, 3, "not_interested", 24 * 21), event(401, 2, 41, "save", 24 * 21)],
    ]
    with disk_state(spark):
        for rows in stages:  # a restart each time
            log.add(rows)
            before = len(told)
            log.run(lambda e: stream_recent_lists(e, idle="3 days"), "update", write)
            whole = lists(state.user_state(log.table()))
            for _, found in told[before:]:
                assert all(whole[u] == got for u, got in found.items())
    gone = [r["user_id"] for rows, _ in told for r in rows if r["expired"]]
    assert 1 in gone
    last = {r["user_id"]: r["held"] for rows, _ in told for r in rows if not r["expired"]}
    assert last[1] == 1  # only what came after the return is held


def test_late_events_join_sessions(spark, tmp_path):
    log, found = Log(spark, tmp_path), []
    stages = [[event(1, 1, 0, "view", 0), event(2, 1, 0, "view", 1.5), event(3, 2, 0, "view", 0.2)], [event(4, 1, 0, "view", 0.75)], [event(5, 1, 0, "view", 2.5), event(6, 2, 0, "view", 1.2)], [event(7, 3, 0, "view", 99)]]
    for rows in stages:
        log.add(rows)
    log.run(lambda e: stream_sessions(e, 60, "6 hours"), "append", lambda b, _: found.extend(b.collect()))
    hours = lambda t: (t - START).total_seconds() / 3600
    # The last session stays open, as no later event closes it; a gap of just an hour joins.
    assert sorted((r["user_id"], hours(r["start"]), hours(r["end"]), r["n"]) for r in found) == [(1, 0, 2.5, 4), (2, 0.2, 1.2, 2)]


@pytest.mark.parametrize("day", [6, 9, 14, 20])
def test_suppression_of_each_day_equals_batch(spark, tmp_path, day):
    log, found = Log(spark, tmp_path), {}
    rows = [event(i, 1 + i % 3, i % 7, "not_interested" if i % 5 else "save", 4 * i) for i in range(110)]
    for part in (rows[:40], rows[45:90], rows[40:45] + rows[90:]):
        log.add(part)
    papers = spark.createDataFrame([(p, f"c{p % 3}" if p else "") for p in range(7)], "paper_id long, category string")
    log.run(lambda e: stream_suppressed(e, papers, 14, 3, "30 days"), "update", lambda b, _: found.update({(r["as_of"], r["user_id"], r["category"]): r["n"] for r in b.collect()}))
    as_of = START + dt.timedelta(days=day)
    before = log.table().where(F.col("timestamp") < F.lit(as_of))
    batch = state.suppressed_categories(before, papers, as_of.date().isoformat())
    expected = {(r["user_id"], r["category"]): r["n"] for r in batch.collect()}
    assert {k[1:]: n for k, n in found.items() if k[0].replace(tzinfo=None) == as_of} == expected and expected
