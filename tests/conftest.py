import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="session")
def same_rows(spark, sf, duck):
    """Whether a query's rows are those of its SQL, in any order."""

    def compare(function, sql):
        df = function(spark, sf)
        columns = sorted(df.columns)
        got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        expected = sorted((tuple(normal(r[i]) for i in at) for r in result.fetchall()), key=repr)
        assert got == expected

    return compare
