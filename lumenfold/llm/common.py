"""Small helpers shared by the training-data operators: reading tables, shared storage, checked broadcasts."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_root, staged  # noqa: F401

#: A side with at most this many narrow rows (a few dozen bytes each) may be broadcast.
BROADCAST_ROWS = 200_000
#: Bytes in a batch of texts or sets handed to Python, about.
BATCH_BYTES = 8 << 20
#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(setting: str) -> int:
    """A setting's number of rows or bytes, which may have a unit, as ``64m``."""
    plain = setting.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(plain[-1:], 0)
    return int(plain[:-1] if unit else plain) << unit


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int = BATCH_BYTES):
    """For jobs run inside: at most so many rows, and about so many bytes, in a batch handed to Python, where rows hold
    whole texts or sets."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name, None) for name in limits}
    try:
        for name, limit in limits.items():
            own = _number(before[name] or "0")
            spark.conf.set(name, str(min(limit, own) if own > 0 else limit))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count proves it small, else as it is.  Meant for staged, narrow tables."""
    return F.broadcast(df) if df.count() <= rows else df


def hex_number(digest: Column, start: int, digits: int) -> Column:
    """``digits`` (at most 15) hexadecimal digits of a digest, from 1-based ``start``, as a long."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def as_text(column: str) -> Column:
    """A key as text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
