"""URL filters, hard negatives and conversation repair: plain versions, odd inputs, and the SQL of their queries."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import conversations, hardneg, queries, urlfilter

BIG = 2**60


@pytest.mark.parametrize("name", ["op11_filter_urls", "op12_hard_negatives"])
def test_query_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE[name])


# URL filters


def urls(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string")


def test_hosts_paths_and_canonical_urls(spark):
    given = [
        ("HTTP://User@WWW.Example.NET:80/en//a/?b=2&utm_source=x&a=1#top", "user@www.example.net:80", "/en//a/", "example.net/en/a?a=1&b=2"),
        ("https://m.example.net./en/a?a=1&b=2", "m.example.net.", "/en/a", "example.net/en/a?a=1&b=2"),
        ("https://x.org?q#f?g", "x.org", "", "x.org?q"),
        ("https://x.org#f/a", "x.org", "", "x.org"),
        ("a://b://c", "b:", "//c", "b/c"),
        ("no scheme", "", "", None), ("://", "", "", None), ("", "", "", None), (None, "", "", None),
        ("http://Ärzte.example.de/", "Ärzte.example.de", "/", "Ärzte.example.de"),
    ]
    rows = urls(spark, [(i, u) for i, (u, *_) in enumerate(given)])
    got = rows.select("page_id", urlfilter.host(F.col("url")), urlfilter.path(F.col("url")), urlfilter.canonical(F.col("url"))).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(g[1:]) for g in given]


def test_longest_rule_wins(spark):
    rules = [*urlfilter.RULES, ("b.example.net", "/e", "block")]
    given = {"http://a.net/x": "net/", "http://net/": "net/", "http://a.net": None, "http://anet/": None, "http://a.example.net/en/": "example.net/en/", "http://a.example.net/en": "net/",
             "http://b.example.net/en/1": "b.example.net/e", "http://q.org/fr/": "org/fr/", "http://q.org/frank": None, "http://example.com/de/?x": "example.com/de/"}
    judged = urlfilter.judge_urls(urls(spark, [(i, u) for i, u in enumerate(given)]), urls(spark, []).withColumnRenamed("url", "canonical"), rules).collect()
    assert {r["page_id"]: r["rule"] for r in judged} == dict(enumerate(given.values()))
    verdicts = {r + p: v for r, p, v in rules}
    assert all(r["verdict"] == verdicts.get(r["rule"], "allow") for r in judged)


@pytest.mark.parametrize("broadcast_rows", [200_000, 10])
def test_listed_urls_are_found_exactly(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr("lumenfold.llm.common.BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(urlfilter, "small", lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df)
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", 8)  # far too small a filter: many false positives, the same verdicts
    pages = urls(spark, [(i, f"https://h{i % 50}.example.com/p/{i % 900}/") for i in range(3000)] + [(None, "https://h1.example.com/p/1"), (BIG + 1, None)])
    listed = spark.createDataFrame([(f"h{i % 50}.example.com/p/{i}",) for i in range(0, 900, 3)] + [(None,), ("h0.example.com/p/0",)], "canonical string")
    names = {r["canonical"] for r in listed.collect()} - {None}
    got = urlfilter.judge_urls(pages, listed, []).collect()
    assert len(got) == 3002
    assert all(r["listed"] == (r["canonical"] in names) and r["verdict"] == ("block" if r["listed"] else "allow") for r in got)
    bloom, blocks = urlfilter.bloom_filter(listed.where("canonical IS NOT NULL").distinct())
    passed = urlfilter.possibly_listed(listed, bloom, blocks).where("possible").count()
    assert passed == listed.where("canonical IS NOT NULL").count()


def test_false_positives_are_few(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("a.example/"), "id").alias("canonical"))
    bloom, blocks = urlfilter.bloom_filter(listed)
    others = spark.range(20_000).select(F.concat(F.lit("b.example/"), "id").alias("canonical"))
    assert urlfilter.possibly_listed(listed, bloom, blocks).where("possible").count() == 20_000
    assert urlfilter.possibly_listed(others, bloom, blocks).where("possible").count() < 100


def test_url_filter_of_odd_rows(spark):
    empty = spark.createDataFrame([], "canonical string")
    assert urlfilter.judge_urls(urls(spark, []), empty, urlfilter.RULES).count() == 0
    long_url = "https://a.example.net/en/" + "x/" * 100_000
    odd = urls(spark, [(None, None), (BIG + 1, "https://q.org/1"), (BIG + 3, "https://q.org/1"), (1, long_url), (1, long_url)])
    odd = odd.withColumns({c: F.lit("clash") for c in ("host", "rule", "canonical", "listed", "row", "block", "possible", "html")})
    got = sorted(((r["page_id"], r["verdict"]) for r in urlfilter.judge_urls(odd, spark.createDataFrame([("q.org/1",)], "canonical string"), urlfilter.RULES).collect()), key=str)
    assert got == sorted([(None, "allow"), (BIG + 1, "block"), (BIG + 3, "block"), (1, "allow"), (1, "allow")], key=str)
    kept = urlfilter.allowed_pages(odd, spark.createDataFrame([("q.org/1",)], "canonical string"), urlfilter.RULES)
    assert kept.columns == odd.columns and kept.count() == 3 and {r["host"] for r in kept.collect()} == {"clash"}


# Hard negatives


def plain_negatives(rows, k=10):
    rows = [(i, lab, [int((256 * x) // 1) for x in v]) for i, lab, v in rows]
    out = []
    for i, label, v in rows:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(window[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


@pytest.mark.parametrize("cells", [(16384, 2048, 24), (64, 4, 24)])
def test_negatives_equal_plain_version(spark, monkeypatch, cells):
    for name, value in zip(("CELL_ROWS", "CELL_ANCHORS", "CELLS"), cells, strict=True):
        monkeypatch.setattr(hardneg, name, value)
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 32)
    draw = random.Random(1)
    # Quarters: exact as floats, with very many ties; a third of the rows is one vector, labels are few.
    rows = [(i, draw.randrange(3), [0.5, 0.25, 0.75] if i % 3 == 0 else [draw.randrange(-3, 4) / 4 for _ in range(3)]) for i in range(700)]
    rows += [(BIG + 100 - BIG % 100 + i, 1, [0.5, 0.5]) for i in range(3)] + [(BIG + 7, 2, [0.25, 0.5])]
    got = hardneg.hard_negatives(vectors(spark, rows))
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_wide_components_are_scored_exactly(spark):
    rows = [(i, i % 2, [3.0e6 + i, 1.0, -2.0e6]) for i in range(40)] + [(100 + i, i % 2, [2.0e6, 5.0 * i, 1.0]) for i in range(40)]
    assert sorted(map(tuple, hardneg.hard_negatives(vectors(spark, rows)).collect())) == plain_negatives([(i, lab, [float(x) for x in v]) for i, lab, v in rows])


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    assert hardneg.hard_negatives(vectors(spark, [])).count() == 0
    odd = vectors(spark, [(0, None, [1.0]), (None, 1, [1.0]), (100, 1, None), (200, 1, []), (300, 1, [nan]), (400, 1, [inf]), (500, 1, [None]), (600, 1, [1.0]), (600, 1, [1.0])])
    assert hardneg.hard_negatives(odd).count() == 0  # one usable id: no positives
    more = odd.union(vectors(spark, [(1, 1, [1.0]), (2, 2, [0.5]), (2, 2, [0.5]), (3, 2, [0.5, 0.5])])).withColumns({c: F.lit("clash") for c in ("no", "v", "score", "rank")})
    got = sorted(tuple(r) for r in hardneg.hard_negatives(more).collect())
    assert got == sorted([(600, 1, rank, 2, 65536, 32768) for rank in (1, 2)] * 2)
    assert hardneg.relabelled(more).where("vec_id = 0").first()["label"] is None


# Conversations

TURNS = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def rows_after(rows):
    """Damage and order, written anew."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(own, key=key) for c, own in out.items()}


def fault_of(own, i):
    _, role, text = own[i]
    bare = text.strip(" \t\n\x0b\x0c\r")
    if not bare:
        return "blank"
    if any(r[1:] == (role, text) for r in own[:i]):
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def plain_repair(own):
    """The cheapest edits by search over (rows done, roles so far), audits compared as text."""
    faults = [fault_of(own, i) for i in range(len(own))]
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in out)  # an empty role has no initial and stays nowhere
        if i == len(own) and PATTERN.fullmatch(initials):
            return cost, audit, out
        if len(out) > len(own) + 3 or not any(PATTERN.fullmatch(initials + tail) for tail in ("", "a", "ua")):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, (*out, (role, ""))))
        if i < len(own):
            _, role, text = own[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, (*out, (other, text))))
    raise AssertionError("no repair")


def plain_report(rows):
    out = []
    for conv, own in rows_after(rows).items():
        turns = [t for t, *_ in own if t is not None]
        faults = [fault_of(own, i) for i in range(len(own))]
        cost, audit, repaired = plain_repair(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=str)


def invented(n, seed):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "well", " \t", "", None, "a.b", "Ünï? \n", "Yes."]
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", ""]
    return [(None if c == 0 else BIG + c, None if draw.random() < 0.1 else t + draw.randrange(2), draw.choice(roles), draw.choice(texts)) for c in range(n) for t in range(draw.randrange(1, 6))]


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(spark, rows, **limits):
    got = conversations.repair_report(conversations.damaged(spark.createDataFrame(rows, TURNS)), **limits)
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"long_rows": 2}, {"long_rows": 0}])
def test_repairs_equal_plain_search(spark, monkeypatch, limits):
    monkeypatch.setattr(conversations, "STRETCH", 2)
    rows = invented(120, 3)
    assert report(spark, rows, **limits) == plain_report(rows)


def test_registered_repair_equals_plain_search(spark, sf):
    got = queries.QUERIES["op13_repair_conversations"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain_report(rows)


def test_stretches_compose_to_the_whole():
    draw = random.Random(5)
    for n in (1, 2, 3, 7, 60):
        turns = [(draw.choice("suax"), draw.choice(["", "", "", "blank", "truncated"])) for _ in range(n)]
        parts = [conversations.stretch(turns[i : i + 4]) for i in range(0, n, 4)]
        first = {(0, s): best for s, best in conversations.close({0: (0, "")}).items()}
        best = conversations.compose(first, conversations.compose_all(parts))
        assert min(best[0, s] for s in (0, 3) if (0, s) in best) == conversations.cheapest(turns)


def test_one_long_conversation_among_others(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(5000)] + invented(20, 8)
    short, long = report(spark, rows, long_rows=10**6), report(spark, rows, long_rows=1000)
    assert short == long and len(long) == 21
    repair = conversations.Repair(conversations.damaged(spark.createDataFrame(rows, TURNS)), long_rows=1000)
    own = [r for r in repair.rows().where("conv_id = 1").orderBy("place").collect()]
    lines = "\n".join(f"{r['role']}:{r['text']}" for r in own)
    assert hashlib.sha256(lines.encode()).hexdigest() == next(r[-1] for r in long if r[0] == 1)
    assert PATTERN.fullmatch("".join(r["role"][0] for r in own))


def test_repair_of_odd_rows(spark):
    assert report(spark, []) == []
    huge = "word " * 200_000 + "."
    odd = [(None, None, None, None), (7, 1, "user", huge), (7, 1, "user", huge), (7, 2, "assistant", "Ok."), (8, None, "system", "S."), (8, None, "system", "S.")]
    table = spark.createDataFrame(odd, TURNS).withColumns({c: F.lit("clash") for c in ("conv", "fault", "audit", "place", "kind", "copy")})
    got = {r["conv_id"]: r for r in conversations.repair_report(table).collect()}
    assert {c: (r["audit"], r["duplicate"], r["gaps"]) for c, r in got.items()} == {None: ("D", 0, 0), 7: ("KDK", 1, 0), 8: ("DD", 1, 0)}
    gone = spark.createDataFrame([(3, 1, "user", "A.", False)], TURNS + ", present boolean")
    assert tuple(conversations.repair_report(gone).first()) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# Keys


def test_large_keys_beside_a_null_stay_whole(spark):
    from lumenfold.llm import ctph, forest, langid, licenses, packing, sharding

    notice = max(licenses.TEMPLATES["MIT"], key=len)
    rows = [(BIG + 1, notice), (BIG + 3, notice + " one more word"), (BIG + 5, "other words that stand alone here"), (None, notice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    keys = {BIG + 1, BIG + 3, BIG + 5, None}
    assert {r["doc_id"] for r in licenses.scan_licenses(docs).collect()} == keys - {BIG + 5}
    assert {r["doc_id"] for r in packing.pack_documents(docs).collect()} == keys
    assert {r["doc_id"] for r in ctph.edited_fingerprints(docs).collect()} == keys
    found = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(docs).collect()}
    assert found == {BIG + 1: BIG + 1, BIG + 3: BIG + 1, BIG + 5: BIG + 5, None: None}
    assert {r["doc_id"] for r in forest.drop_near_duplicates(docs).collect()} == {BIG + 1, BIG + 5, None}
    assert {r["doc_id"] for r in sharding.shard_documents(docs).collect()} == keys
    labelled = docs.withColumn("lang", F.lit("en"))
    assert {r["doc_id"] for r in langid.identify(docs, langid.fit_language_model(labelled)).collect()} == keys


def test_batch_limits_with_units(spark):
    from lumenfold.llm.common import arrow_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for told, held in (("64m", str(8 << 20)), ("1k", "1024"), ("2mb", str(2 << 20))):
            spark.conf.set(name, told)
            with arrow_batches(spark, 10):
                assert spark.conf.get(name) == held
            assert spark.conf.get(name) == told
    finally:
        spark.conf.set(name, before)
