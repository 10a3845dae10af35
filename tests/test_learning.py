"""Joins on time, features as of an event, and the learned ranker."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import evaluation, lambdamart
from lumenfold.operators.asof import asof_join, interval_join
from lumenfold.operators.state import ALPHA, ewma_profile
from lumenfold.plans import learning

START = dt.datetime(2024, 1, 1)
BIG = 2**60


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("bucket", [600, 86_400, 10**9])
def test_asof_join_equals_plain_search(spark, bucket):
    draw = random.Random(4)
    keys = [None, BIG + 1, BIG + 3, *[7] * 5]  # one key with most rows
    left = [(i, draw.choice(keys), None if draw.random() < 0.05 else at(draw.randrange(3000))) for i in range(400)]
    right = [(draw.choice(keys), None if draw.random() < 0.05 else at(draw.randrange(3000)), draw.randrange(50)) for _ in range(200)]
    got = asof_join(spark.createDataFrame(left, "id long, key long, time timestamp_ntz"), spark.createDataFrame(right, "key long, time timestamp_ntz, value int"), "key", "time", ["value"], bucket)
    expected = set()
    for i, key, time in left:
        before = [(t, v) for k, t, v in right if k is not None and k == key and t is not None and time is not None and t < time]
        expected.add((i, key, time, max(before)[1] if before else None))
    assert {tuple(r) for r in got.collect()} == expected and got.columns == ["id", "key", "time", "value"]


def test_interval_join_equals_plain_search(spark):
    draw = random.Random(5)
    events = [(i, draw.randrange(3), at(draw.randrange(20_000))) for i in range(300)] + [(900, None, at(5)), (901, 1, None)]
    spans = [(s, draw.randrange(3), at(low), at(low + draw.randrange(-5, 4000))) for s, low in ((s, draw.randrange(20_000)) for s in range(80))] + [(900, 1, None, at(9))]
    found = interval_join(spark.createDataFrame(events, "id int, key int, time timestamp_ntz"), spark.createDataFrame(spans, "span int, key int, low timestamp_ntz, high timestamp_ntz"), "key", "time", "low", "high")
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    expected = sorted((i, s) for i, k, t in events for s, q, low, high in spans if k == q and None not in (t, low) and low <= t < high)
    assert sorted((r["id"], r["span"]) for r in found.collect()) == expected and len(expected) > 50


@pytest.fixture(scope="module")
def shown(spark):
    """Users who save papers near their own direction and dismiss those away from it; all see papers of any direction."""
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(200, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    taste, rows = draw.normal(size=(12, 8)), []
    for n in range(3600):
        user, paper = int(draw.integers(12)), int(draw.integers(200))
        like = float(vectors[paper] @ taste[user]) + 0.1 * draw.normal()
        kind = "save" if like > 1.2 else "click" if like > 0.6 else "not_interested" if like < -1.2 else "view"
        rows.append((n, user, paper, kind, at(12 * n)))
    events = spark.createDataFrame(rows, "id long, user_id long, paper_id long, event_type string, timestamp timestamp_ntz")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "paper_id long, embedding array<double>")
    return events, table, rows, vectors


def test_features_are_those_before_the_event(spark, shown):
    events, table, rows, vectors = shown
    got = {r["id"]: r["features"] for r in learning.training_table(events, table).collect()}
    profiles, counts = defaultdict(dict), defaultdict(lambda: [0, 0])
    for n, user, paper, kind, _ in rows:  # in order of time
        v = vectors[paper]
        cos = {k: round(float(v @ p) / (np.linalg.norm(v) + 1e-10) / (np.linalg.norm(p) + 1e-10), 9) for k, p in profiles[user].items()}
        assert got[n] == pytest.approx([cos.get("long_term", 0.0), cos.get("short_term", 0.0), cos.get("negative", 0.0), *counts[user]], abs=1e-8)
        for k in ("long_term", "short_term") if kind == "save" else ("negative",) if kind == "not_interested" else ():
            p = profiles[user].get(k)
            p = v if p is None else (1 - ALPHA[k]) * p + ALPHA[k] * v
            profiles[user][k] = p / np.linalg.norm(p)
        counts[user][0] += kind == "save"
        counts[user][1] += kind == "not_interested"
    assert len(got) == len(rows)


def test_learned_ranks_beat_fixed_weights_and_repeat(spark, shown):
    events, table, *_ = shown
    trees, late = learning.learned(events, table, rounds=6, depth=2)
    gains = late.select(F.col("group").alias("query_id"), F.col("id").alias("paper_id"), (F.pow(2.0, "label") - 1).alias("gain"))
    mean = lambda score: evaluation.ndcg(learning.ranked(late, score), gains, 10).agg(F.avg("ndcg")).first()[0]
    by_trees, by_weights, by_chance = mean(lambdamart.predict(trees)), mean(learning.heuristic()), mean(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000)
    assert by_trees > by_weights > by_chance
    again, _ = learning.learned(events.repartition(7), table, rounds=6, depth=2)
    assert again == trees


def test_gradients_push_better_rows_up():
    g, h = lambdamart.gradients(np.array([0.0, 2.0, 1.0]), np.zeros(3))
    assert g[1] > g[2] > g[0] and abs(g.sum()) < 1e-12 and (h >= 0).all()
    assert lambdamart.gradients(np.zeros(4), np.arange(4.0))[0].tolist() == [0.0] * 4


def test_ranker_of_odd_tables(spark):
    shape = "group string, id long, features array<double>, label int"
    assert lambdamart.fit(spark.createDataFrame([], shape)) == []
    same = spark.createDataFrame([("a", i, [1.0, 2.0], i % 2) for i in range(40)], shape)
    assert lambdamart.fit(same, rounds=2) == []  # nothing tells the rows apart
    assert spark.range(1).select(F.array(F.lit(1.0)).alias("features")).select(lambdamart.predict([])).first()[0] == 0.0


def test_one_user_with_a_long_log(spark):
    """The fold holds one vector, not the log."""
    events = spark.range(100_000).selectExpr("id", "CASE WHEN id < 99000 THEN 1 ELSE id END AS user_id", "id % 50 AS paper_id", "'save' AS event_type", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS timestamp")
    vectors = spark.range(50).selectExpr("id AS paper_id", "array(cos(id), sin(id)) AS embedding")
    row = ewma_profile(events, vectors, "long_term").where("user_id = 1").first()
    assert row["n"] == 99_000 and np.linalg.norm(row["profile"]) == pytest.approx(1.0)
