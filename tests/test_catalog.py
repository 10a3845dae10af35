"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from lumenfold import catalog, catalog_index, catalog_learning, catalog_rollups, catalog_streams  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(name, same_rows):
    same_rows(catalog.QUERIES[name], catalog.ORACLE[name])


def test_stream_state_equals_batch(spark, sf):
    batch = {r["user_id"]: (r["positives"], r["negatives"]) for r in catalog.QUERIES["user_state"](spark, sf).collect()}
    stream = {r["user_id"]: (r["positives"], r["negatives"]) for r in catalog.QUERIES["stream_user_state"](spark, sf).collect()}
    assert stream == batch


def test_streams_are_written_by_tasks(spark, sf):
    for name in ("stream_user_state", "stream_window_counts", "stream_distinct", "stream_profile_negative"):
        files = catalog.QUERIES[name](spark, sf).inputFiles()
        assert files and all(f.endswith(".parquet") and "/lumenfold/" in f for f in files)


def test_interests_are_searched_once(spark, sf):
    assert "MapInArrow" not in catalog.QUERIES["multi_interest_rrf"](spark, sf)._jdf.queryExecution().toString()


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
