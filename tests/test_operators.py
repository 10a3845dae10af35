"""Behaviour of single operators on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import scalars, sparse
from lumenfold.operators import clustering, evaluation, fusion, ranking, state, tables
from lumenfold.streaming.state import apply_event


def quotas(spark, importances, total=30, least=3):
    rows = [(1, i, float(x)) for i, x in enumerate(importances)]
    out = fusion.allocate_quotas(spark.createDataFrame(rows, "user_id long, cluster_idx int, importance double"), total, least)
    return [r["quota"] for r in out.orderBy("cluster_idx").collect()]


@pytest.mark.parametrize(
    ("importances", "total", "least", "expected"),
    [([0.55, 0.30, 0.15], 30, 3, [17, 9, 4]), ([2, 3], 10, 3, [4, 6]), ([5], 50, 3, [50]), ([0, 0, 0], 30, 3, [10, 10, 10]), ([99, 1], 100, 3, [99, 3]), ([0, 0, 0], 31, 3, [11, 10, 10])],
)
def test_quotas(spark, importances, total, least, expected):
    assert quotas(spark, importances, total, least) == expected


def test_quotas_equal_weights_share_the_rest(spark):
    assert sorted(quotas(spark, [10, 10, 10], 20)) == [6, 7, 7]
    assert sum(quotas(spark, [1.0] * 10, 20)) == 30


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, paper_id long, rank int")


def test_rrf_adds_over_lists_and_keeps_first_list_first(spark):
    dense, sparse = ranked(spark, [(1, 1, 1), (1, 2, 2), (1, 3, 3)]), ranked(spark, [(1, 2, 1), (1, 4, 2), (1, 1, 3)])
    rows = fusion.rrf([dense, sparse]).orderBy("fused_rank").collect()
    assert [r["paper_id"] for r in rows] == [2, 1, 4, 3]
    assert rows[0]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62)


def test_recency_prefers_newer_among_equals(spark):
    fused = spark.createDataFrame([(1, 1, 0.5, 1, "1501.00001"), (1, 2, 0.5, 2, "2401.00001"), (1, 3, 0.5, 3, "math/0301001")], "query_id long, paper_id long, rrf_score double, fused_rank int, arxiv_id string")
    assert [r["paper_id"] for r in fusion.recency_rerank(fused, 2024 * 12 + 1).orderBy("rank").collect()] == [2, 3, 1]


def test_merge_quota_is_sequential(spark):
    rows = [(1, 1, p, i + 1, 2) for i, p in enumerate([10, 11, 12])] + [(1, 2, p, i + 1, 2) for i, p in enumerate([10, 12, 13])]
    out = fusion.merge_quota(spark.createDataFrame(rows, "user_id long, list_no int, paper_id long, rank int, quota int")).orderBy("position").collect()
    assert [(r["paper_id"], r["list_no"]) for r in out] == [(10, 1), (11, 1), (12, 2), (13, 2)]


def test_merge_quota_takes_any_number_of_lists_in_one_exchange(spark):
    lists = [(u, n, 10 * n + i - u % 2, i, 3) for u in (1, 2) for n in range(1, 10) for i in range(12)]
    merged = fusion.merge_quota(spark.createDataFrame(lists, "user_id long, list_no int, paper_id long, rank int, quota int"))
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {}
    for r in merged.collect():
        got.setdefault(r["user_id"], []).append((r["position"], r["paper_id"], r["list_no"]))
    for u, rows in got.items():
        expected, taken = [], set()
        for n in range(1, 10):
            own = [p for _, m, p, *_ in sorted(x for x in lists if x[0] == u) if m == n and p not in taken][:3]
            taken |= set(own)
            expected += [(p, n) for p in own]
        assert [(p, n) for _, p, n in sorted(rows)] == expected and len(expected) == 27


def test_sparse_topk_in_blocks_equals_plain_products(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["the"] * int(rng.integers(0, 4)) + [f"{chr(97 + x)}{chr(97 + y)}" for x, y in rng.integers(0, 6, (int(rng.integers(0, 9)), 2))])) for i in range(300)]
    texts = spark.createDataFrame([*rows, (900, None)], "paper_id long, text string")
    items = sparse.term_vectors(texts, "paper_id")
    asks = items.where("paper_id % 3 = 0").withColumnRenamed("paper_id", "query_id")
    vectors = {r["paper_id"]: dict(zip(r["terms"], r["weights"], strict=True)) for r in items.collect()}
    expected = []
    for q in (q for q in vectors if q % 3 == 0):
        scored = [(-round(sum(w * vectors[p].get(t, 0) for t, w in vectors[q].items()), 9), p) for p in vectors if vectors[q].keys() & vectors[p].keys()]
        expected += [(q, p, r + 1) for r, (_, p) in enumerate(sorted(scored)[:5])]
    for block in (2048, 7):
        monkeypatch.setattr(sparse, "QUERY_BLOCK", block)
        monkeypatch.setattr(sparse, "_CELLS", 2000)
        got = [(r["query_id"], r["paper_id"], r["rank"]) for r in sparse.sparse_topk(asks, items, 5).collect()]
        assert sorted(got) == sorted(expected)
    assert sparse.keyword_topk(asks.limit(0), items, 5).count() == 0


def test_late_events_take_their_place_in_the_stream(spark, tmp_path):
    from lumenfold.streaming.state import stream_user_state

    schema = "id long, user_id long, paper_id long, event_type string, timestamp timestamp_ntz"
    events = [(i, 1, i % 30, "save" if i % 3 else "not_interested", f"2024-01-01 00:{i // 60:02}:{i % 60:02}") for i in range(200)]
    table = spark.createDataFrame(events, "id long, user_id long, paper_id long, event_type string, t string").selectExpr("id", "user_id", "paper_id", "event_type", "to_timestamp_ntz(t) AS timestamp")
    for part in ("id < 150 AND id % 7 <> 0", "id >= 150 OR id % 7 = 0"):
        table.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    rows = []
    run = stream_user_state(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    last = max(rows, key=lambda r: r["seen"])
    batch = state.user_state(table).first()
    assert last["seen"] == 200 and (last["positives"], last["negatives"]) == (batch["positives"], batch["negatives"])


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("2301.00001v2", "2301.00001"), ("arxiv:1706.03762", "1706.03762"), ("https://arxiv.org/abs/1706.03762v5", "1706.03762"), (" 2401.1 ", "2401.1"), ("hep-th/9901001v1", "hep-th"), ("arXiv:1706.03762", "arXi"), ("", "")],
)
def test_normalise_id(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "r string").select(scalars.normalise_id(F.col("r"))).first()[0] == expected


def test_scalars_on_odd_values(spark):
    row = spark.createDataFrame([("[1", "soon", None, None)], "a string, b string, c string, d string").select(
        scalars.json_list(F.col("a")), scalars.age_days(F.col("b"), "2024-01-31"), scalars.safe_int(F.col("c")), scalars.category(F.col("d"), F.lit("cs.CL cs.LG")), scalars.year_of(F.col("b"))
    ).first()
    assert tuple(row) == ([], 365, 0, "cs.CL", 0)


def test_user_state_replays_like_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 40)), ["save", "not_interested"][int(rng.integers(0, 2))]) for i in range(200)]
    events = spark.createDataFrame(rows, "id long, user_id long, paper_id long, event_type string").withColumn("timestamp", F.timestamp_seconds("id").cast("timestamp_ntz"))
    for r in state.user_state(events).collect():
        positives, negatives = [], []
        for _, _, paper, kind in [x for x in rows if x[1] == r["user_id"]][-state.HISTORY :]:
            apply_event(positives, negatives, kind, paper)
        assert (r["positives"], r["negatives"]) == (positives, negatives)


def test_suppression_keeps_all_if_none_would_remain(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "a"), (2, 2, "b")], "user_id long, paper_id long, category string")
    bad = spark.createDataFrame([(1, "a"), (2, "a")], "user_id long, category string")
    assert sorted((r["user_id"], r["paper_id"]) for r in ranking.drop_suppressed(rows, bad).collect()) == [(1, 1), (1, 2), (2, 2)]


def greedy(v, score, k, weight=0.6):
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)
    rel, picked = (score - score.min()) / (score.max() - score.min()), []
    while len(picked) < k:
        value = {i: weight * rel[i] - (1 - weight) * max([unit[i] @ unit[j] for j in picked], default=0.0) for i in range(len(v)) if i not in picked}
        picked.append(max(value, key=lambda i: (round(value[i], 9), -i)))
    return picked


def test_mmr_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    v, score = rng.normal(size=(30, 8)), np.sort(rng.random(30))[::-1]
    rows = [(1, i, i + 1, float(score[i]), [float(x) for x in v[i]]) for i in range(30)]
    frame = spark.createDataFrame(rows, "user_id long, paper_id long, rank int, score double, embedding array<double>")
    assert [r["paper_id"] for r in ranking.mmr(frame, 8).orderBy("mmr_rank").collect()] == greedy(v, score, 8)
    assert [r["paper_id"] for r in ranking.mmr(frame.where("rank <= 5"), 8).orderBy("mmr_rank").collect()] == [0, 1, 2, 3, 4]


def blobs(counts, spread=0.05, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(counts), dim))
    return np.concatenate([c + spread * rng.normal(size=(n, dim)) for c, n in zip(centres, counts, strict=True)])


def test_clusters_of_separate_topics():
    found = clustering.cluster_one(list(range(15)), blobs([6, 5, 4]))
    assert sorted(sorted(c["paper_ids"]) for c in found) == [list(range(6)), list(range(6, 11)), list(range(11, 15))]
    assert all(c["medoid_paper_id"] in c["paper_ids"] for c in found)
    assert [c["importance"] for c in found] == sorted((c["importance"] for c in found), reverse=True)
    assert len(clustering.cluster_one([1, 2, 3], blobs([3]))) == 1
    assert len(clustering.cluster_one(list(range(20)), np.random.default_rng(1).normal(size=(20, 8)))) <= clustering.MAX_CLUSTERS


def test_ward_heights_by_variance():
    points = np.random.default_rng(2).normal(size=(12, 4))
    merges, members = clustering.ward_merges(points), {i: [i] for i in range(12)}
    for step, (a, b, height) in enumerate(merges):
        x, y = points[members[a]], points[members[b]]
        assert height == pytest.approx(np.sqrt(2 * len(x) * len(y) / (len(x) + len(y))) * np.linalg.norm(x.mean(0) - y.mean(0)))
        members[12 + step] = members.pop(a) + members.pop(b)


def test_matching_and_stable_numbers():
    from itertools import permutations

    cost = np.random.default_rng(4).random((4, 6))
    best = min(sum(cost[i, p[i]] for i in range(4)) for p in permutations(range(6), 4))
    assert sum(cost[a, b] for a, b in clustering.best_matching(cost)) == pytest.approx(best)
    assert sum(cost.T[a, b] for a, b in clustering.best_matching(cost.T)) == pytest.approx(best)
    e = np.eye(4)
    assert clustering.stable_numbers([(0, e[1]), (1, e[0]), (2, e[2])], [(0, e[0]), (5, e[1])]) == [5, 0, 1]


def test_users_share_batches_and_are_whole(spark):
    rng = np.random.default_rng(5)
    sizes = [9, 1, 4, 20, 7, 13, None]
    rows = [(u if n else None, i, 100 * u + i, rng.normal(size=6).tolist()) for u, n in enumerate(sizes) for i in range(n or 6)]
    saved = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "user_id long, pos int, paper_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = clustering.user_clusters(saved)
        got = sorted((r["user_id"] if r["user_id"] is not None else -1, r["cluster_idx"], r["medoid_paper_id"], tuple(r["paper_ids"]), round(r["importance"], 9)) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = []
    for u, n in enumerate(sizes):
        own = [r for r in rows if r[2] // 100 == u]
        expected += [(u if n else -1, c["cluster_idx"], c["medoid_paper_id"], tuple(c["paper_ids"]), round(c["importance"], 9)) for c in clustering.cluster_one([r[2] for r in own], np.array([r[3] for r in own]))]
    assert got == sorted(expected)
    # A call of Python for each user costs more than the clusters.
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_stable_numbers_do_not_hang_on_the_order_of_rows(spark):
    e = np.eye(6).tolist()
    new = [(1, i, 10 + i, e[i], [10 + i], 5.0 - i) for i in range(4)]
    old = spark.createDataFrame([(1, 3, e[1]), (2, 0, e[0])], "user_id long, cluster_idx int, medoid_embedding array<double>")
    for rows in (new, new[::-1]):
        found = clustering.stabilise(spark.createDataFrame(rows, clustering.CLUSTERS).coalesce(1), old)
        assert {r["medoid_paper_id"]: r["cluster_idx"] for r in found.collect()} == {10: 0, 11: 3, 12: 1, 13: 2}
        assert "CoGroup" not in found._jdf.queryExecution().toString()


def test_upsert_merge_and_replace(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (None, "x", 9), (3, "d", 2)], "k long, v string, version int")
    assert {r["k"]: r["v"] for r in tables.upsert(old, new, "k", "version").collect()} == {1: "a", 2: "c", 3: "d"}
    assert {(r["k"], r["v"], r["version"]) for r in tables.merge_columns(old, new.where("k > 0"), ["k"], ["v"]).collect()} == {(1, "a", 1), (2, "c", 1), (3, "d", None)}
    assert sorted((r["k"], r["v"]) for r in tables.replace_by_key(old, new.where("k = 2"), "k").collect()) == [(1, "a"), (2, "c")]


def test_sessions_break_at_the_gap(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, 1, 600), (3, 1, 9000)], "id long, user_id long, s long").withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))
    assert sorted(r["n"] for r in evaluation.sessions(rows, 60).collect()) == [1, 2]


@pytest.mark.parametrize("block", [4096, 3])
def test_dense_topk_equals_all_pairs(spark, monkeypatch, block):
    from lumenfold.functions import vectors

    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rng = np.random.default_rng(6)
    v, q = rng.normal(size=(50, 4)), rng.normal(size=(7, 4))
    items = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "paper_id long, embedding array<double>")
    asks = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id long, embedding array<double>")
    bar = spark.createDataFrame([(0, i) for i in range(40)] + [(1, 5)], "query_id long, paper_id long")
    got = {(r["query_id"], r["rank"]): r["paper_id"] for r in vectors.dense_topk(asks, items, 5, exclude=bar).collect()}
    barred = {(0, i) for i in range(40)} | {(1, 5)}
    for i in range(7):
        order = [j for j in np.argsort(-(v @ q[i]), kind="stable") if (i, j) not in barred][:5]
        assert [got[i, n + 1] for n in range(5)] == order


def test_many_queries_meet_all_items_in_a_stream(spark, monkeypatch):
    """No table of pairs of blocks: a task holds its queries' best and items go by.  Copies tie, each query has its own k."""
    from lumenfold.functions import vectors

    monkeypatch.setattr(vectors, "QUERY_BLOCK", 100)
    rng = np.random.default_rng(8)
    v = np.repeat(rng.integers(-3, 4, size=(900, 4)).astype(float), 3, axis=0)
    rows = [(2**60 + 7 * i % 2700, [float(x) for x in r]) for i, r in enumerate(v)]
    items = spark.createDataFrame([*rows, (None, [1.0] * 4), (5, None)], "paper_id long, embedding array<double>")
    asks = [(q, [float(x) for x in rng.integers(-3, 4, size=4)], int(q % 9)) for q in range(1300)]
    bar = [(q, 2**60 + int(i)) for q in range(0, 1300, 4) for i in rng.integers(0, 2700, 300)]
    queries = spark.createDataFrame([*asks, (None, [1.0] * 4, 3)], "query_id long, embedding array<double>, own long")
    found = vectors.dense_topk(queries, items, 7, exclude=spark.createDataFrame(bar, "query_id long, paper_id long"), k_column="own")
    pairs = found.select("query_id", "paper_id", "score", "rank")
    plan = vectors.dense_topk(queries, items, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Product" not in plan
    got, barred = {(r["query_id"], r["rank"]): (r["paper_id"], r["score"]) for r in pairs.collect()}, set(bar)
    expected = {}
    for q, x, own in asks:
        scored = sorted((-round(float(np.dot(x, y)), 9), i) for i, y in rows if (q, i) not in barred)[: min(own, 7)]
        expected |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored)}
    assert got == expected


@pytest.mark.parametrize("alone", [1024, 2])
def test_queries_of_one_vector_share_its_search(spark, monkeypatch, alone):
    """Users whose clusters have the same medoid cost one search; each leaves out what itself has seen, and has its own k."""
    from lumenfold.functions import vectors
    from lumenfold.plans import recommend

    rng = np.random.default_rng(11)
    v = np.repeat(rng.integers(-3, 4, size=(30, 4)).astype(float), 2, axis=0)
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "paper_id long, embedding array<double>")
    medoids = [[1.0, 0.0, 2.0, -1.0], [0.0, 1.0, -1.0, 1.0]]
    rows = [(u, c, m, 1.0 + (u + c) % 3) for u in range(12) for c, m in enumerate(medoids)]
    clusters = spark.createDataFrame(rows, "user_id long, cluster_idx int, medoid_embedding array<double>, importance double")
    seen = [(u, int(i)) for u in range(12) for i in rng.choice(60, u % 5, replace=False)]
    monkeypatch.setattr(vectors, "SHARED_BARRED", alone)
    searched, plain = [], vectors.dense_topk
    monkeypatch.setattr(vectors, "dense_topk", lambda queries, *rest, **more: (searched.append(queries.count()), plain(queries, *rest, **more))[1])
    monkeypatch.setattr(recommend, "OVERSAMPLE", 0.1)
    found = recommend.cluster_candidates(clusters, items, spark.createDataFrame(seen, "user_id long, paper_id long")).collect()
    assert searched == ([2] if alone == 1024 else [2, 2 * sum(u % 5 > 2 for u in range(12))])
    got = {}
    for r in found:
        got.setdefault((r["user_id"], r["cluster_idx"]), []).append((r["rank"], r["paper_id"], r["score"]))
    for u, c, m, _ in rows:
        scored = sorted((-float(v[i] @ m), i) for i in range(60) if (u, i) not in seen)
        own = sorted(got[u, c])
        assert 1 < len(own) < 12 and own == [(n + 1, i, -s) for n, (s, i) in enumerate(scored[: len(own)])]


def test_similarities_of_candidates_go_in_batches(spark):
    rng = np.random.default_rng(12)
    own = [(u, p, p, rng.normal(size=3).tolist(), "2024-01-01") for u in range(4) for p in range(3)] + [(0, 9, 3, None, "2024-01-01"), (3, 9, 3, [0.0, 0.0, 0.0], "2024-01-01")]
    table = spark.createDataFrame(own, "user_id long, paper_id long, position int, embedding array<double>, published string").withColumn("published", F.to_date("published"))
    known = {u: [rng.normal(size=3).tolist() if u != 1 or i else None for i in range(3)] for u in (0, 1, 3)}
    profiles = spark.createDataFrame([(u, *x) for u, x in known.items()], "user_id long, lt array<double>, st array<double>, neg array<double>")
    found = ranking.features(table, profiles, "2024-02-01")
    # A function called for each number of each vector took most of the time.
    assert "zip_with" not in found._jdf.queryExecution().toString()
    got = {(r["user_id"], r["paper_id"]): r for r in found.collect()}
    assert len(got) == len(own)
    for u, p, _, x, _ in own:
        for name, y in zip(("lt_sim", "st_sim", "neg_sim"), known.get(u, [None] * 3), strict=True):
            expected = 0.0 if y is None else None if x is None else np.dot(x, y) / ((np.linalg.norm(x) + 1e-10) * (np.linalg.norm(y) + 1e-10))
            assert got[u, p][name] == (expected if expected is None else pytest.approx(expected, abs=1e-12))


@pytest.mark.parametrize("numbers", [1 << 21, 64])
def test_best_score_of_many_examples(spark, monkeypatch, numbers):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(80, 4))
    items = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "paper_id long, embedding array<double>")
    own = [(q, i, bool((i + q) % 3)) for q in range(12) for i in range(q, 60 if q < 2 else q + 4)] + [(99, 3, False)]
    examples = spark.createDataFrame([(q, i, [float(x) for x in v[i]], s) for q, i, s in own], "query_id long, paper_id long, embedding array<double>, positive boolean")
    monkeypatch.setattr(ranking, "ITEM_BLOCK", 32)
    monkeypatch.setattr(ranking, "EXAMPLE_BLOCK", 16)
    monkeypatch.setattr(ranking, "EXAMPLE_NUMBERS", numbers)
    # Nothing goes through the driver, however many the examples.
    monkeypatch.setattr(type(examples), "toPandas", lambda self: pytest.fail("examples were fetched to the driver"))
    got = {(r["query_id"], r["rank"]): (r["paper_id"], r["score"]) for r in ranking.best_score(examples, items, 5).collect()}
    expected = {}
    for q in range(12):
        good, bad, known = ([i for p, i, s in own if p == q and s], [i for p, i, s in own if p == q and not s], {i for p, i, _ in own if p == q})
        scores = []
        for i in set(range(80)) - known:
            g, b = max(round(float(v[i] @ v[j]), 9) for j in good), max([round(float(v[i] @ v[j]), 9) for j in bad] + [-1.0])
            scores.append((-round(g if g > b else -b * b, 9), i))
        expected |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in expected.items()}
    assert all(abs(got[k][1] - expected[k][1]) < 1e-8 for k in got)


def test_best_score_of_a_repeated_example(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)] + [(None, [9.0, 9.0])], "paper_id long, embedding array<double>")
    examples = spark.createDataFrame([(1, 49, [1.0, 49.0], True)] * 3000 + [(1, 0, [1.0, 0.0], False), (None, 1, [1.0, 1.0], True)], "query_id long, paper_id long, embedding array<double>, positive boolean")
    assert [(r["paper_id"], r["score"]) for r in ranking.best_score(examples, items, 3).orderBy("rank").collect()] == [(48, 2353.0), (47, 2304.0), (46, 2255.0)]


def test_numbers_without_gaps(spark):
    keys = [2**60 + 1, 2**60 + 3, -5, 0, 7, 2**40, 2**40]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    got = {r["k"]: r["n"] for r in ranking.numbered(rows, "k", "n").collect()}
    assert set(got) == set(keys) and sorted(got.values()) == list(range(6))
    assert ranking.numbered(rows.limit(0), "k", "n").count() == 0


def test_factorised_finds_what_like_users_took(spark):
    """Two groups of users, each with its own papers; ids beyond 32 bits.  What a user has not met yet of the own group comes first."""
    big = 2**40
    taken = [(big + u, big + 1000 * (u % 2) + i, 1.0) for u in range(20) for i in range(8) if i != u % 8]
    affinity = spark.createDataFrame([*taken, (None, 1, 1.0), (1, None, 1.0), (big, 5, -1.0)], "user_id long, paper_id long, affinity double")
    got = {}
    for r in ranking.factorised(affinity, 8, 4, 10).collect():
        got.setdefault(r["user_id"], set()).add(r["paper_id"])
    assert got == {big + u: {big + 1000 * (u % 2) + i for i in range(8)} for u in range(20)}


def test_stays_change_weights(spark):
    stays = [None, 0, 1, 9_999, 10_000, 120_000, 120_001]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(stays)], "i int, s long")
    assert [r[0] for r in rows.orderBy("i").select(evaluation.dwell_factor(F.col("s"))).collect()] == [1.0, 1.0, 0.1, 0.1, 1.0, 1.0, 1.5]


def test_exploration_falls_with_what_was_served(spark):
    rows = spark.createDataFrame([(None,), (0,), (1,), (100,), (10**6,)], "n long").coalesce(1)
    assert [round(r[0], 9) for r in rows.select(ranking.decayed_epsilon(F.col("n"))).collect()] == [0.1, 0.1, 0.0999, round(0.1 * 0.999**100, 9), 0.05]


def test_weighted_profile_folds_whole_vectors(spark):
    """Vectors are not laid out a number a row; users of several batches and rows without a user keep their sums."""
    events = spark.range(60_000).selectExpr("id", "CASE WHEN id < 25000 THEN 1 WHEN id % 500 = 0 THEN NULL ELSE id % 7 + 2 END AS user_id", "id % 12000 AS paper_id", "CASE WHEN id % 3 = 0 THEN 'save' ELSE 'not_interested' END AS event_type", "timestamp_ntz'2024-01-31' AS timestamp")
    table = spark.range(11_000).selectExpr("id AS paper_id", "array(cos(id), sin(id), 1D) AS embedding")
    found = evaluation.weighted_profile(events, table, "2024-01-31")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    got = {r["user_id"]: (r["profile"], r["weight"]) for r in found.collect()}
    sums = {}
    for i in range(60_000):
        user = 1 if i < 25_000 else None if i % 500 == 0 else i % 7 + 2
        if i % 12_000 < 11_000:
            total = sums.setdefault(user, [np.zeros(3), 0])
            total[0] = total[0] + (1 if i % 3 == 0 else -1) * np.array([np.cos(i % 12_000), np.sin(i % 12_000), 1.0])
            total[1] += 1
    assert got.keys() == sums.keys()
    for user, (total, n) in sums.items():
        assert got[user][0] == pytest.approx(total / n, abs=1e-9) and got[user][1] == n
