"""Relational building blocks: lookups with fallback, flags, set operations, upserts, merges and replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..schemas import taxonomy


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for; the planner sends the smaller side where its measured size allows."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def enrich(ranked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Ranked rows with the table's columns; rows without a match go, ranks stay."""
    return ranked.join(table, key)


def with_fallback(keys: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``first`` for the keys, and of ``second`` for those that it lacks."""
    hit = lookup(first, keys, key)
    missing = keys.select(key).distinct().join(first, key, "left_anti")
    return hit.unionByName(lookup(second, missing, key))


def write_back(keys: DataFrame, cache: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """The cache after a read through it: its rows, and those of ``remote`` for the keys that it lacked."""
    missing = keys.select(key).distinct().join(cache, key, "left_anti")
    return cache.unionByName(lookup(remote, missing, key))


def clean_corpus(raw: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Rows with a key and with some text left, white space made single; the first (by its texts) of each key."""
    plain = raw.where(F.col(key).isNotNull() & (F.trim(key) != "")).withColumns({c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) for c in texts})
    filled = plain.where(F.concat(*texts) != "")
    return filled.groupBy(key).agg(F.min(F.struct(*texts, *[c for c in raw.columns if c not in (key, *texts)])).alias("r")).select(key, "r.*")


def build_papers(metadata: DataFrame, citations: DataFrame) -> DataFrame:
    """Metadata rows (``id``) with ``citation_count`` and ``influential_citations`` (0 without any), one row for each id.

    ``citations`` has ``arxiv_id_clean``; of repeated rows there the highest counts stand.
    """
    counts = ("citation_count", "influential_citations")
    cited = citations.groupBy(F.col("arxiv_id_clean").alias("id")).agg(*[F.max(F.col(c).try_cast("int")).alias(c) for c in counts])
    rest = [c for c in metadata.columns if c != "id"]
    once = metadata.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*")
    return once.join(cited, "id", "left").select("id", *rest, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def collection_stats(items: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: ``points``, ``ids`` (distinct), ``dims`` (distinct), ``missing`` (rows without a vector)."""
    return items.agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("paper_id").alias("ids"), F.count_distinct(F.size(vector)).alias("dims"), F.count_if(F.col(vector).isNull()).alias("missing")
    )


def flagged(rows: DataFrame, marks: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """A boolean column per mark: whether the row's keys are in the marked set."""
    for name, marked in marks.items():
        rows = rows.join(marked.select(*keys).distinct().withColumn(f"__{name}", F.lit(True)), keys, "left")
        rows = rows.withColumn(name, F.coalesce(f"__{name}", F.lit(False))).drop(f"__{name}")
    return rows


def paper_projection(papers: DataFrame) -> DataFrame:
    """Metadata rows in the shape that pages show."""
    named = papers.where((F.col("arxiv_id").isNotNull()) & (F.col("arxiv_id") != ""))
    return named.select(
        "paper_id", "arxiv_id",
        scalars.one_line(F.col("title")).alias("title"), scalars.one_line(F.col("abstract_preview")).alias("abstract"),
        scalars.authors_list(F.col("authors")).alias("authors"), scalars.category(F.col("primary_topic"), F.col("categories")).alias("category"),
        F.coalesce("update_date", F.lit("")).alias("published"), scalars.year_of(F.col("update_date")).alias("year"), scalars.safe_int(F.col("citation_count")).alias("citations"),
    )


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Last writer wins: of all rows with a key, that of the highest version; changes without a key are skipped."""
    every = table.unionByName(changes.where(F.col(key).isNotNull()))
    return every.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))).where("__n = 1").drop("__n")


def merge_columns(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``table`` with ``columns`` taken from ``changes`` where it has the key; new keys are added, other columns stay."""
    joined = table.alias("t").join(changes.alias("c"), keys, "full_outer")
    value = lambda c: F.coalesce(f"c.{c}", f"t.{c}") if c in columns else F.col(f"t.{c}")
    return joined.select(*keys, *[value(c).alias(c) for c in table.columns if c not in keys])


def replace_by_key(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``fresh`` in place of all rows whose key it has."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def event_rows(raw: DataFrame) -> DataFrame:
    """Raw form values as event rows: empty strings and position 0 are null, cluster numbers are parsed."""
    empty = lambda c: F.nullif(c, F.lit("")).alias(c)
    return raw.select(
        "user_id", "paper_id", "event_type", empty("source"), F.nullif(F.col("position"), F.lit(0)).alias("position"), empty("query_id"), empty("ranker_version"), empty("candidate_source"),
        F.nullif(F.col("cluster_id"), F.lit("")).try_cast("int").alias("cluster_id"),
    )


def category_codes(groups: DataFrame) -> DataFrame:
    """``user_id``, ``code`` of the groups that users selected (``user_id``, ``group_key``); unknown groups give none."""
    return groups.join(F.broadcast(taxonomy(groups.sparkSession)), "group_key").select("user_id", F.explode("codes").alias("code")).distinct()


def valid_groups(selected):
    """A list of group keys without unknown ones; order and repeats stay."""
    from ..schemas import CATEGORY_GROUPS

    return F.filter(selected, lambda k: k.isin(list(CATEGORY_GROUPS)))


def trending(papers: DataFrame, codes: list[str], n: int) -> DataFrame:
    """The most cited papers of the categories, newer ones first among equals."""
    own = papers.where(F.col("primary_topic").isin(codes) & (F.col("citation_count") > 0))
    return own.orderBy(F.desc("citation_count"), F.desc("update_date"), "arxiv_id").limit(n)
