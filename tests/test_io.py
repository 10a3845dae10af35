"""Formats, sinks, the vector codec and the pluggable steps of search."""

import pytest
from pyspark.sql import functions as F

from lumenfold.plans.search import encode, rewrite_queries
from lumenfold.sources import io


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_append_and_read(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    for _ in range(2):
        io.append(rows, str(tmp_path / fmt), fmt)
    back = io.read_table(spark, str(tmp_path / fmt), fmt, rows.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(1, "a"), (2, None)] * 2, key=str)
    with pytest.raises(ValueError):
        io.read_table(spark, "x", "csv")


def test_replace_partitions_and_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "")], "id long, name string")
    io.replace_partitions(rows, str(tmp_path / "t"), ["id"])
    io.replace_partitions(spark.createDataFrame([(2, "c")], rows.schema), str(tmp_path / "t"), ["id"])
    assert {r["id"]: r["name"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1: "a", 2: "c", 3: ""}
    io.export_ids(rows, "name", str(tmp_path / "ids"))
    assert sorted(r[0] for r in io.read_table(spark, str(tmp_path / "ids"), "text").collect()) == ["a", "b"]


def test_vectors_survive_storage(spark):
    rows = spark.createDataFrame([([0.5, -1.25],), (None,)], "v array<float>")
    back = rows.withColumn("b", io.pack_vector(F.col("v"))).withColumn("w", io.unpack_vector(F.col("b"))).collect()
    assert back[0]["w"] == [0.5, -1.25] and len(back[0]["b"]) == 8 and back[1]["w"] is None


def test_rewriting_and_encoding(spark):
    rows = spark.createDataFrame([(1, "  cats "), (2, ""), (3, "one two three four five six seven words here")], "query_id long, text string")
    out = {r["query_id"]: r["query"] for r in rewrite_queries(rows, lambda q: F.concat(F.lit('"academic '), q, F.lit('"'))).collect()}
    assert out == {1: "academic cats", 2: "", 3: "one two three four five six seven words here"}
    vectors = {r["query_id"]: r["embedding"] for r in encode(rows, lambda texts: [[len(t), 1.0] for t in texts], 2, "query_id").collect()}
    assert vectors[1] == [4.0, 1.0] and vectors[2] == [0.0, 0.0]
