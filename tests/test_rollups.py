"""Rollups of sketches, and tables read and written by pages."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lumenfold import catalog, catalog_rollups  # noqa: F401
from lumenfold.operators import rollups
from lumenfold.sources import paged
from lumenfold.sources.paged import Bounds, FilePages, read_pages, write_pages

SCHEMA = "key long, name string, share double"


def rows_of(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("key"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), "id")).alias("name"), (F.col("id") / 4).alias("share"))


def keys(df):
    return sorted(r["key"] for r in df.collect())


# --- rollups ---------------------------------------------------------------------------------------------------------


def test_distinct_counts_are_near_the_exact_ones(spark, sf):
    exact = {(r["level"], r["day"], r["category"]): r["members"] for r in catalog.QUERIES["rollup_members_exact"](spark, sf).collect()}
    guess = {(r["level"], r["day"], r["category"]): r["members"] for r in catalog.QUERIES["rollup_members"](spark, sf).collect()}
    assert set(guess) == set(exact) and {g[0] for g in guess} == {0, 1, 2}
    # Four standard errors.
    assert all(abs(guess[g] - n) <= max(1, 4 * 1.04 / math.sqrt(2**rollups.REGISTERS) * n) for g, n in exact.items())


def test_distinct_counts_of_many_users_merge(spark):
    events = spark.range(200_000).select((F.col("id") % 10).alias("day"), F.lit("c").alias("category"), (F.col("id") % 50_000).alias("user_id"), F.lit(1.0).alias("value"))
    found = {(r["level"], r["day"]): r["members"] for r in rollups.rolled(rollups.measured(events, ["day", "category"], "value", "user_id"), ["day", "category"]).collect()}
    assert abs(found[2, None] - 50_000) <= 4 * 1.04 / 64 * 50_000 and abs(found[1, 3] - 5_000) <= 4 * 1.04 / 64 * 5_000


def test_quantiles_are_within_the_stated_error(spark):
    values = [0.0, 0.0, -5.5, -0.001, 1e-9, 3.0, 3.0, 7.25, 1e12, 42.0, 41.9, float("nan"), float("inf"), None]
    events = spark.createDataFrame([(i % 2, "a" if i % 3 else None, v) for i, v in enumerate(values)], "day long, category string, value double")
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {(r["level"], r["day"], r["category"], r["share"]): r["value"] for r in rollups.quantiles(rollups.bucketed(events, ["day", "category"], "value"), ["day", "category"], shares).collect()}
    groups = {}
    for i, v in enumerate(values):
        if v is not None and math.isfinite(v):
            for g in ((0, i % 2, "a" if i % 3 else None), (1, i % 2, None), (2, None, None)):
                groups.setdefault(g, []).append(v)
    assert {g[:3] for g in got} == set(groups)
    for g, own in groups.items():
        for s in shares:
            exact = sorted(own)[max(1, math.ceil(s * len(own))) - 1]
            assert abs(got[*g, s] - exact) <= (rollups.ACCURACY + 1e-9) * abs(exact)


def test_late_events_refresh_their_days_alone(spark, tmp_path):
    rows = [(d, c, u, float(d * 10 + u)) for d in range(4) for c in ("a", "b") for u in range(5)]
    late = [(1, "a", 77, 500.0), (1, "new", 78, -2.0)]
    frame = lambda data: spark.createDataFrame(data, "day int, category string, user_id long, value double")
    rollups.refresh(frame(rows), str(tmp_path / "r"), "day", ["category"], "value", "user_id")
    kept = {p: os.path.getmtime(p) for p in map(str, (tmp_path / "r" / "measures" / "day=2").glob("*.parquet"))}
    for _ in range(2):
        rollups.refresh(frame([r for r in rows if r[0] == 1] + late), str(tmp_path / "r"), "day", ["category"], "value", "user_id")
    rollups.refresh(frame(rows + late), str(tmp_path / "once"), "day", ["category"], "value", "user_id")
    assert all(os.path.getmtime(p) == at for p, at in kept.items()) and kept
    by = ["day", "category"]
    shape = lambda at: (rollups.stored(spark, str(at))[0], rollups.stored(spark, str(at))[1])
    both = [(sorted(map(str, rollups.rolled(m, by).collect())), sorted(map(str, rollups.quantiles(b, by, [0.5]).collect()))) for m, b in map(shape, (tmp_path / "r", tmp_path / "once"))]
    assert both[0] == both[1]


def test_rollups_of_nothing(spark):
    empty = spark.createDataFrame([], "day int, category string, user_id long, value double")
    assert rollups.quantiles(rollups.bucketed(empty, ["day", "category"], "value"), ["day", "category"], [0.5]).count() == 0
    assert [(r["level"], r["n"]) for r in rollups.rolled(rollups.measured(empty, ["day", "category"], "value", "user_id"), ["day", "category"]).collect()] in ([], [(2, None)])


# --- pages -----------------------------------------------------------------------------------------------------------


def test_pages_survive_and_are_read_once(spark, tmp_path):
    pages = write_pages(rows_of(spark, 0, 1000), str(tmp_path / "p"), "key", page_rows=37)
    back = read_pages(spark, pages, SCHEMA, "key", page_rows=10)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows_of(spark, 0, 1000).collect()), key=lambda r: r[0])
    reply = pages.page(pages.parts()[0][0], Bounds(), 2)
    assert reply["rows"][1] == [{"type": "integer", "value": "1"}, {"type": "text", "value": "n1"}, {"type": "float", "value": "0.25"}]
    assert reply["rows"][0][1] == {"type": "null"} and reply["more"]
    # Columns that the service has not are null; others may be left out.
    assert {tuple(r) for r in read_pages(spark, pages, "key long, other string", "key").where("key < 2").collect()} == {(0, None), (1, None)}


def counting(path, before_page):
    """Pages whose service calls ``before_page(part, bounds)`` first.  The class is local, so tasks get it by value."""

    class Watched(FilePages):
        def page(self, part, bounds, limit):
            before_page(part, bounds)
            return super().page(part, bounds, limit)

        def __getstate__(self):
            return {**self.__dict__, "_indexes": {}}

    return Watched(path)


@pytest.mark.parametrize("condition", ["key = 500", "key > 990", "key >= 990 AND key < 995", "key IN (3, 998)", "key = 5000", "key < 4 OR name = 'n999'", "name = 'n7'", "key <=> 8", "key > 10 AND key < 5"])
def test_filters_of_the_key_reach_the_service(spark, tmp_path, condition):
    write_pages(rows_of(spark, 0, 1000), str(tmp_path / "p"), "key", page_rows=50)
    log = tmp_path / "log"
    log.touch()
    name = str(log)

    def note(part, bounds):
        with open(name, "a") as f:
            f.write(f"{part} {bounds}\n")

    found = keys(read_pages(spark, counting(str(tmp_path / "p"), note), SCHEMA, "key", page_rows=50).where(condition))
    assert found == keys(rows_of(spark, 0, 1000).where(condition))
    asked = len(log.read_text().splitlines())
    if condition.startswith("key") and " OR " not in condition and " IN " not in condition:
        assert asked <= 2
    else:
        assert asked >= 20


@pytest.mark.parametrize("lasting", [False, True])
def test_broken_pages_are_asked_for_again(spark, tmp_path, lasting):
    write_pages(rows_of(spark, 0, 300), str(tmp_path / "p"), "key", page_rows=20)
    (tmp_path / "marks").mkdir()
    marks = str(tmp_path / "marks")

    def broken(part, bounds):
        mark = f"{marks}/{part}-{bounds.low}"
        if lasting or not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError("broken")

    rows = read_pages(spark, counting(str(tmp_path / "p"), broken), SCHEMA, "key", page_rows=20, tries=2, wait=0.001)
    if lasting:
        with pytest.raises(Exception, match="broken"):
            rows.collect()
    else:
        assert keys(rows) == list(range(300))


def test_a_failed_write_changes_nothing(spark, tmp_path):
    at = str(tmp_path / "p")
    pages = write_pages(rows_of(spark, 0, 100), at, "key", page_rows=10)
    for bad in (rows_of(spark, 100, 200).union(rows_of(spark, 150, 151)), rows_of(spark, 100, 200).union(spark.createDataFrame([(None, "x", 0.0)], SCHEMA))):
        with pytest.raises(Exception, match="unique and not null"):
            write_pages(bad, at, "key", page_rows=10)
        assert keys(read_pages(spark, pages, SCHEMA, "key")) == list(range(100))
    write_pages(rows_of(spark, 100, 200), at, "key", page_rows=10)
    assert keys(read_pages(spark, pages, SCHEMA, "key")) == list(range(200))
    write_pages(rows_of(spark, 7, 9), at, "key", mode="overwrite")
    assert keys(read_pages(spark, pages, SCHEMA, "key")) == [7, 8]


def test_a_repeated_commit_changes_nothing(tmp_path):
    pages = FilePages(str(tmp_path / "p"))
    pages.commit("a", [["index-x.json", 1, 2]], False)
    before = pages.manifest()
    pages.commit("a", [["index-x.json", 1, 2]], False)
    assert pages.manifest() == before and before["version"] == 1
    pages.commit("b", [], True)
    assert pages.manifest()["parts"] == []


def test_pages_of_nothing_and_of_text_keys(spark, tmp_path):
    pages = write_pages(rows_of(spark, 0, 0), str(tmp_path / "none"), "key")
    assert read_pages(spark, pages, SCHEMA, "key").count() == 0
    words = spark.createDataFrame([("é", 1), ("a\n", 2), ("𝒜", 3), ("z", 4), ("", 5), ("", 6)], "key string, n int")
    with pytest.raises(Exception, match="unique"):
        write_pages(words, str(tmp_path / "twice"), "key")
    pages = write_pages(words.where("n < 6"), str(tmp_path / "words"), "key", page_rows=2)
    assert {(r["key"], r["n"]) for r in read_pages(spark, pages, words.schema, "key", page_rows=1).collect()} == {("é", 1), ("a\n", 2), ("𝒜", 3), ("z", 4), ("", 5)}


def test_cells(spark):
    for value in (None, 0, -(2**60) - 1, 2**60 + 3, 0.1, float("inf"), "", "text", " "):
        assert paged.decode_cell(json.loads(json.dumps(paged.encode_cell(value)))) == value
    with pytest.raises(TypeError):
        paged.encode_cell(True)
