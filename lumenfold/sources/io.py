"""Reading and writing tables in the formats that Spark brings along, and the vector codec of stored profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json", "text", "xml", "jdbc")


def read_table(spark: SparkSession, source: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table from a path, or from a database with ``fmt='jdbc'`` (``source`` is the table, ``url`` an option).

    Schemas are given, not guessed, except for self-describing formats.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return reader.option("dbtable", source).load()
    if schema is None and fmt in ("csv", "json", "xml"):
        raise ValueError(f"{fmt} needs a schema")
    return (reader.schema(schema) if schema is not None else reader).load(source)


def append(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Append rows, in folders by the columns named (a log by its date, so that old days are not read)."""
    writer = df.write.mode("append").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``df`` has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export_ids(table: DataFrame, column: str, path: str) -> None:
    """Non-empty ids, one on a line."""
    table.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


@F.pandas_udf(T.BinaryType())
def _pack(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _unpack(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))


def pack_vector(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""
    return _pack(vector)


def unpack_vector(blob: Column) -> Column:
    return _unpack(blob)
