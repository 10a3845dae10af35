"""The model's tables, read from Parquet and projected from the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: ``id``, ``user_id``, ``paper_id``, ``event_type``, ``timestamp``."""
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'not_interested' WHEN 'signup' THEN 'onboarding' ELSE event_type END")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("paper_id"), kind.alias("event_type"), F.col("ts").alias("timestamp")
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata rows: ids of the form YYMM.NNNNN made from the key, category from the source; the first sentence is the title,
    the whole text the abstract."""
    yy, mm = F.expr("lpad(7 + doc_id % 18, 2, '0')"), F.expr("lpad(1 + doc_id % 12, 2, '0')")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("paper_id"),
        F.concat(yy, mm, F.lit("."), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("arxiv_id"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
        F.expr("concat('Author ', doc_id % 7, ', , Author ', doc_id % 5, ',Author ', doc_id % 3)").alias("authors"),
        F.concat_ws(" ", "source", "lang").alias("categories"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("primary_topic"),
        F.concat(F.lit("20"), yy, F.lit("-"), mm, F.lit("-01")).alias("update_date"),
        F.col("text").alias("abstract_preview"),
        (F.col("n_chars") % 1000).cast("int").alias("citation_count"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paper_id``, ``embedding`` (doubles), ``label``."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


#: The same tables in the oracle's dialect, as common table expressions.
SQL = {
    "interactions": """interactions AS (SELECT event_id AS id, user_id, (props->>'$.k')::BIGINT AS paper_id,
        CASE event_type WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'not_interested' WHEN 'signup' THEN 'onboarding' ELSE event_type END AS event_type,
        ts AS timestamp FROM events)""",
    "papers": """papers AS (SELECT doc_id AS paper_id,
        lpad((7 + doc_id % 18)::VARCHAR, 2, '0') || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '.' || lpad(doc_id::VARCHAR, 5, '0') AS arxiv_id,
        split_part(text, '.', 1) AS title, 'Author ' || doc_id % 7 || ', , Author ' || doc_id % 5 || ',Author ' || doc_id % 3 AS authors,
        concat_ws(' ', source, lang) AS categories, CASE WHEN doc_id % 5 <> 0 THEN source END AS primary_topic,
        '20' || lpad((7 + doc_id % 18)::VARCHAR, 2, '0') || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '-01' AS update_date,
        text AS abstract_preview, (n_chars % 1000)::INT AS citation_count FROM documents)""",
    "vectors": "vectors AS (SELECT vec_id AS paper_id, embedding::DOUBLE[] AS embedding, label FROM embeddings)",
}


def with_tables(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` after the definitions of the tables named."""
    tail = sql.strip()
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
    return f"{head},\n{tail[5:]}" if tail.upper().startswith("WITH ") else f"{head}\n{tail}"
