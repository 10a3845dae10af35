"""The registered queries of the library, each over whole tables, with the same result in plain SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars, sparse, vectors
from .functions.postings import PostingIndex, build_postings
from .operators import clustering, evaluation, fusion, ranking, state, tables
from .plans.recommend import multi_interest, profile_table, recommend
from .plans.search import hybrid_search, search, seed_papers
from .schemas import CATEGORY_GROUPS
from .sources.staging import shared_root, staged
from .sources.tables import SQL, interactions, papers, read, vectors as vector_table, with_tables
from .streaming.state import stream_distinct, stream_profile, stream_user_state, stream_window_counts

#: The day and the month (year * 12 + month) for which everything is computed.
AS_OF, AS_OF_MONTH = "2024-01-31", 2024 * 12 + 1

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_NAMED = "named AS (SELECT *, coalesce(nullif(primary_topic, ''), split_part(trim(categories), ' ', 1), '') AS category, update_date AS published FROM papers)"
_DOT = "round(list_dot_product({}, {}), 9)"


def query(name: str, sql: str | None = None, *names: str, recursive: bool = False):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = with_tables(sql, *names, recursive=recursive) if names else sql
        return function

    return register


def named(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with their category and publication day."""
    return papers(spark, sf).withColumns({"category": scalars.category(F.col("primary_topic"), F.col("categories")), "published": F.col("update_date")})


def joined(items) -> F.Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


# --- scans and lookups -----------------------------------------------------------------------------------------------


@query("recent_interactions", """
    SELECT user_id, id, paper_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC)::INT AS rank
    FROM interactions WHERE event_type IN ('save', 'not_interested') QUALIFY rank <= 50""", "interactions")  # fmt: skip
def recent_interactions(spark, sf):
    return state.recent(interactions(spark, sf), 50, ["save", "not_interested"]).select("user_id", "id", "paper_id", "event_type", "rank")


@query("point_lookup", "SELECT paper_id, arxiv_id, title FROM papers WHERE paper_id = 42", "papers")
def point_lookup(spark, sf):
    return papers(spark, sf).where("paper_id = 42").select("paper_id", "arxiv_id", "title")


@query("id_map_batch", "SELECT paper_id, arxiv_id FROM papers WHERE paper_id IN (SELECT paper_id FROM interactions)", "papers", "interactions")
def id_map_batch(spark, sf):
    return tables.lookup(papers(spark, sf).select("paper_id", "arxiv_id"), interactions(spark, sf), "paper_id")


@query("metadata_batch", f"""WITH {_NAMED} SELECT paper_id, category, published, citation_count FROM named
    WHERE paper_id IN (SELECT vec_id FROM embeddings)""", "papers")  # fmt: skip
def metadata_batch(spark, sf):
    return tables.lookup(named(spark, sf), vector_table(spark, sf), "paper_id").select("paper_id", "category", "published", "citation_count")


@query("vectors_for_ids", """
    SELECT DISTINCT i.user_id, i.paper_id, v.label, round(v.embedding[1], 6) AS first FROM interactions i JOIN vectors v USING (paper_id)
    WHERE event_type = 'save'""", "interactions", "vectors")  # fmt: skip
def vectors_for_ids(spark, sf):
    saves = interactions(spark, sf).where("event_type = 'save'").select("user_id", "paper_id").distinct()
    return saves.join(vector_table(spark, sf), "paper_id").select("user_id", "paper_id", "label", F.round(F.col("embedding")[0], 6).alias("first"))


@query("export_ids", "SELECT arxiv_id, count(*) OVER () AS n FROM papers WHERE arxiv_id <> ''", "papers")
def export_ids(spark, sf):
    ids = papers(spark, sf).where("arxiv_id <> ''").select("arxiv_id")
    return ids.join(F.broadcast(ids.agg(F.count(F.lit(1)).alias("n"))))


@query("recent_year_scan", """
    SELECT arxiv_id, update_date FROM papers WHERE substr(update_date, 1, 4)::INT >= 2023 ORDER BY update_date DESC, arxiv_id LIMIT 10""", "papers")  # fmt: skip
def recent_year_scan(spark, sf):
    own = papers(spark, sf).where(scalars.year_of(F.col("update_date")) >= 2023)
    return own.orderBy(F.desc("update_date"), "arxiv_id").limit(10).select("arxiv_id", "update_date")


_BM25_SQL = r"""tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL),
    sized AS (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS size, count(*) OVER (PARTITION BY term) AS df FROM tf),
    totals AS (SELECT count(*) AS items, avg(size) AS mean FROM (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY doc_id)),
    relevance AS (SELECT query_id, doc_id, round(sum(ln(1 + (items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)))), 9) AS score
      FROM words JOIN sized USING (term), totals GROUP BY ALL),
    by_words AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM relevance QUALIFY rank <= 10)"""


@query("keyword_search", rf"""
    WITH words AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS term FROM benchmark), {_BM25_SQL}
    SELECT query_id, doc_id, score, rank FROM by_words""")  # fmt: skip
def keyword_search(spark, sf):
    """Keyword relevance over all words stands in for the remote service's, which has no local definition."""
    asked = sparse.term_counts(read(spark, sf, "benchmark"), "item_id").withColumnRenamed("item_id", "query_id")
    return _postings(spark, sf).keyword_search(asked, 10, item="doc_id")


@query("cache_fallback", """
    WITH cache AS (SELECT paper_id, title, 'cache' AS origin FROM papers WHERE paper_id % 3 = 0), remote AS (SELECT paper_id, title, 'remote' AS origin FROM papers),
    wanted AS (SELECT DISTINCT paper_id FROM interactions)
    SELECT paper_id, coalesce(c.title, r.title) AS title, coalesce(c.origin, r.origin) AS origin FROM wanted LEFT JOIN cache c USING (paper_id) LEFT JOIN remote r USING (paper_id)
    WHERE coalesce(c.origin, r.origin) IS NOT NULL""", "papers", "interactions")  # fmt: skip
def cache_fallback(spark, sf):
    remote = papers(spark, sf).select("paper_id", "title").withColumn("origin", F.lit("remote"))
    cache = remote.where("paper_id % 3 = 0").withColumn("origin", F.lit("cache"))
    return tables.with_fallback(interactions(spark, sf), cache, remote, "paper_id")


@query("cache_write_back", """
    WITH cache AS (SELECT paper_id, title, 'cache' AS origin FROM papers WHERE paper_id % 3 = 0)
    SELECT * FROM cache UNION ALL SELECT paper_id, title, 'remote' FROM papers WHERE paper_id IN (SELECT paper_id FROM interactions) AND paper_id NOT IN (SELECT paper_id FROM cache)""", "papers", "interactions")  # fmt: skip
def cache_write_back(spark, sf):
    remote = papers(spark, sf).select("paper_id", "title").withColumn("origin", F.lit("remote"))
    return tables.write_back(interactions(spark, sf), remote.where("paper_id % 3 = 0").withColumn("origin", F.lit("cache")), remote, "paper_id")


@query("collection_stats", "SELECT count(*) AS points, count(DISTINCT paper_id) AS ids, count(DISTINCT len(embedding)) AS dims, count(*) - count(embedding) AS missing FROM vectors", "vectors")
def collection_stats(spark, sf):
    return tables.collection_stats(vector_table(spark, sf))


@query("id_resolution", """
    WITH wanted AS (SELECT DISTINCT paper_id FROM interactions), known AS (SELECT doc_id AS paper_id, doc_id * 10 AS point FROM documents WHERE doc_id % 2 = 0),
    scrolled AS (SELECT vec_id AS paper_id, vec_id * 10 AS point FROM embeddings)
    SELECT w.paper_id, coalesce(k.point, s.point) AS point, k.point IS NULL AS fresh FROM wanted w LEFT JOIN known k USING (paper_id) LEFT JOIN scrolled s USING (paper_id)
    WHERE coalesce(k.point, s.point) IS NOT NULL""", "interactions")  # fmt: skip
def id_resolution(spark, sf):
    known = papers(spark, sf).where("paper_id % 2 = 0").select("paper_id", (F.col("paper_id") * 10).alias("point"), F.lit(False).alias("fresh"))
    scrolled = vector_table(spark, sf).select("paper_id", (F.col("paper_id") * 10).alias("point"), F.lit(True).alias("fresh"))
    return tables.with_fallback(interactions(spark, sf), known, scrolled, "paper_id")


@query("build_papers", """
    SELECT p.paper_id, p.arxiv_id, length(p.abstract_preview) AS preview_chars, coalesce(c.quality, 0) AS citations FROM papers p
    LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) c ON c.doc_id = p.paper_id""", "papers")  # fmt: skip
def build_papers(spark, sf):
    cited = read(spark, sf, "labels").groupBy(F.col("doc_id").alias("paper_id")).agg(F.max("quality").alias("quality"))
    return papers(spark, sf).join(cited, "paper_id", "left").select("paper_id", "arxiv_id", F.length("abstract_preview").cast("long").alias("preview_chars"), F.coalesce("quality", F.lit(0)).alias("citations"))


@query("clean_corpus", r"""
    WITH c AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'p' || doc_id // 8 ELSE 'q' || doc_id END AS id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS body FROM documents WHERE doc_id % 7 <> 0)
    SELECT id, min(body) AS body FROM c WHERE body <> '' GROUP BY id""")  # fmt: skip
def clean_corpus(spark, sf):
    key = F.expr("CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 4 = 0 THEN concat('p', doc_id div 8) ELSE concat('q', doc_id) END")
    return tables.clean_corpus(read(spark, sf, "documents").select(key.alias("id"), F.col("text").alias("body")), "id", ["body"])


@query("papers_build", """
    WITH m AS (SELECT 'a' || doc_id // 2 AS id, min(source) AS source FROM documents GROUP BY ALL), c AS (SELECT 'a' || doc_id // 3 AS id, max(quality + 5 * toxic) AS n, max(toxic) AS i FROM labels GROUP BY ALL)
    SELECT id, source, coalesce(n, 0)::INT AS citation_count, coalesce(i, 0)::INT AS influential_citations FROM m LEFT JOIN c USING (id)""")  # fmt: skip
def papers_build(spark, sf):
    metadata = read(spark, sf, "documents").select(F.expr("concat('a', doc_id div 2)").alias("id"), "source")
    counts = [F.expr("cast(quality + 5 * toxic as string)").alias("citation_count"), F.expr("cast(toxic as string)").alias("influential_citations")]
    return tables.build_papers(metadata, read(spark, sf, "labels").select(F.expr("concat('a', doc_id div 3)").alias("arxiv_id_clean"), *counts))


# --- sinks -----------------------------------------------------------------------------------------------------------


@query("event_ingest", """
    SELECT user_id, paper_id, event_type, nullif(CASE WHEN id % 3 = 0 THEN '' ELSE 'search' END, '') AS source, nullif((id % 5)::INT, 0) AS position, NULL::VARCHAR AS query_id,
      nullif('v' || id % 2, '') AS ranker_version, NULL::VARCHAR AS candidate_source, CASE WHEN id % 4 = 0 THEN NULL ELSE (id % 4)::INT - 1 END AS cluster_id FROM interactions""", "interactions")  # fmt: skip
def event_ingest(spark, sf):
    raw = interactions(spark, sf).select(
        "user_id", "paper_id", "event_type", F.expr("if(id % 3 = 0, '', 'search')").alias("source"), (F.col("id") % 5).cast("int").alias("position"), F.lit("").alias("query_id"),
        F.expr("concat('v', id % 2)").alias("ranker_version"), F.lit("").alias("candidate_source"), F.expr("if(id % 4 = 0, '', cast(id % 4 - 1 as string))").alias("cluster_id"),
    )
    return tables.event_rows(raw)


@query("upsert_latest", """
    WITH every AS (SELECT paper_id, event_type, id AS version FROM interactions WHERE event_type = 'view' UNION ALL SELECT paper_id, event_type, id FROM interactions WHERE event_type = 'click')
    SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY version DESC) = 1""", "interactions")  # fmt: skip
def upsert_latest(spark, sf):
    log = interactions(spark, sf).select("paper_id", "event_type", F.col("id").alias("version"))
    return tables.upsert(log.where("event_type = 'view'"), log.where("event_type = 'click'"), "paper_id", "version")


@query("merge_profile", """
    WITH old AS (SELECT user_id, count(*) AS n, min(timestamp) AS created FROM interactions WHERE event_type = 'save' GROUP BY user_id),
    new AS (SELECT user_id, count(*) AS n, min(timestamp) AS created FROM interactions WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY user_id)
    SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(w.n, o.n) AS n, o.created FROM old o FULL JOIN new w ON o.user_id = w.user_id""", "interactions")  # fmt: skip
def merge_profile(spark, sf):
    log = interactions(spark, sf)
    count = lambda t: t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("created"))
    return tables.merge_columns(count(log.where("event_type = 'save'")), count(log.where("event_type = 'click' AND user_id % 2 = 0")), ["user_id"], ["n"])


@query("replace_by_key", """
    SELECT user_id, paper_id FROM interactions WHERE event_type = 'save' AND user_id NOT IN (SELECT user_id FROM interactions WHERE event_type = 'view' AND user_id % 3 = 0)
    UNION ALL SELECT user_id, paper_id FROM interactions WHERE event_type = 'view' AND user_id % 3 = 0""", "interactions")  # fmt: skip
def replace_by_key(spark, sf):
    log = interactions(spark, sf)
    return tables.replace_by_key(log.where("event_type = 'save'").select("user_id", "paper_id"), log.where("event_type = 'view' AND user_id % 3 = 0").select("user_id", "paper_id"), "user_id")


# --- projections and scalar functions --------------------------------------------------------------------------------


@query("paper_projection", f"""
    WITH {_NAMED} SELECT paper_id, arxiv_id, replace(title, chr(10), ' ') AS title, replace(abstract_preview, chr(10), ' ') AS abstract,
      array_to_string(list_filter(list_transform(string_split(authors, ','), lambda a: trim(a)), lambda a: a <> '')[1:5], '|') AS authors,
      category, update_date AS published, substr(update_date, 1, 4)::INT AS year, citation_count AS citations FROM named""", "papers")  # fmt: skip
def paper_projection(spark, sf):
    return tables.paper_projection(papers(spark, sf)).withColumn("authors", F.array_join("authors", "|"))


@query("normalise_id", """
    WITH raw AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'arxiv:2301.0' || doc_id || 'v2' WHEN 1 THEN 'https://arxiv.org/abs/1706.03762v' || doc_id % 9 WHEN 2 THEN ' 2401.1' || doc_id || ' '
      WHEN 3 THEN 'hep-th/9901001v1' WHEN 4 THEN 'arXiv:1706.03762' ELSE '  /v/ ' END AS raw FROM documents)
    SELECT doc_id, CASE WHEN regexp_extract(trim(raw), '(?:arxiv:|https?://arxiv\\.org/abs/)?([^\\s/v]+(?:v\\d+)?)', 1) <> ''
      THEN regexp_replace(regexp_extract(trim(raw), '(?:arxiv:|https?://arxiv\\.org/abs/)?([^\\s/v]+(?:v\\d+)?)', 1), 'v\\d+$', '') ELSE trim(raw) END AS id FROM raw""")  # fmt: skip
def normalise_id(spark, sf):
    raw = F.expr("""CASE doc_id % 6 WHEN 0 THEN concat('arxiv:2301.0', doc_id, 'v2') WHEN 1 THEN concat('https://arxiv.org/abs/1706.03762v', doc_id % 9)
        WHEN 2 THEN concat(' 2401.1', doc_id, ' ') WHEN 3 THEN 'hep-th/9901001v1' WHEN 4 THEN 'arXiv:1706.03762' ELSE '  /v/ ' END""")
    return read(spark, sf, "documents").select("doc_id", scalars.normalise_id(raw).alias("id"))


@query("id_recency", f"""
    WITH raw AS (SELECT paper_id, CASE WHEN paper_id % 7 = 0 THEN 'math/0301001' ELSE arxiv_id END AS a FROM papers)
    SELECT paper_id, round(CASE WHEN regexp_matches(a, '^\\d{{4}}\\.') THEN greatest(0.0, 1.0 - greatest(0, {AS_OF_MONTH} - ((2000 + substr(a, 1, 2)::INT) * 12 + substr(a, 3, 2)::INT)) / 120.0) ELSE 0.5 END, 9) AS recency
    FROM raw""", "papers")  # fmt: skip
def id_recency(spark, sf):
    raw = F.expr("if(paper_id % 7 = 0, 'math/0301001', arxiv_id)")
    return papers(spark, sf).select("paper_id", F.round(scalars.id_recency(raw, AS_OF_MONTH), 9).alias("recency"))


@query("age_days", f"""
    SELECT paper_id, CASE WHEN paper_id % 9 = 0 THEN 365 ELSE date_diff('day', update_date::DATE, DATE '{AS_OF}') END::INT AS age,
      round(exp(-0.002 * CASE WHEN paper_id % 9 = 0 THEN 365 ELSE date_diff('day', update_date::DATE, DATE '{AS_OF}') END), 9) AS decay FROM papers""", "papers")  # fmt: skip
def age_days(spark, sf):
    age = scalars.age_days(F.expr("if(paper_id % 9 = 0, 'soon', update_date)"), AS_OF)
    return papers(spark, sf).select("paper_id", age.alias("age"), F.round(F.exp(-ranking.DECAY * age), 9).alias("decay"))


@query("authors_json", """
    SELECT paper_id, array_to_string(list_filter(list_transform(string_split(authors, ','), lambda a: trim(a)), lambda a: a <> '')[1:5], '|') AS authors FROM papers""", "papers")  # fmt: skip
def authors_json(spark, sf):
    return papers(spark, sf).select("paper_id", F.array_join(scalars.authors_list(F.col("authors")), "|").alias("authors"))


@query("author_display", """
    WITH a AS (SELECT paper_id, list_filter(list_transform(string_split(authors || ', Else', ','), lambda a: trim(a)), lambda a: a <> '')[1:5] AS l FROM papers)
    SELECT paper_id, array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ' et al.' ELSE '' END AS shown FROM a""", "papers")  # fmt: skip
def author_display(spark, sf):
    return papers(spark, sf).select("paper_id", scalars.author_display(scalars.authors_list(F.concat("authors", F.lit(", Else")))).alias("shown"))


@query("looks_academic", """
    SELECT item_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) > 6
      AND len(regexp_extract_all(text, '(?i)(?:\\d{4}\\.\\d{4,5}|[A-Z]{2,}|transformer|attention|neural|network|\\b(?:et\\s+al|arxiv)\\b)')) >= 2 AS academic FROM benchmark""")  # fmt: skip
def looks_academic(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", scalars.looks_academic(F.col("text")).alias("academic"))


@query("accept_rewrite", """
    WITH r AS (SELECT item_id, text, CASE item_id % 4 WHEN 0 THEN '"' || substr(text, 1, 30) || '"' WHEN 1 THEN '''' || substr(text, 1, 20) || '''' WHEN 2 THEN ' ' ELSE repeat('x', 201) END AS r FROM benchmark),
    c AS (SELECT *, trim(trim(trim(trim(r), '"'), '''')) AS c FROM r) SELECT item_id, CASE WHEN c <> '' AND length(c) <= 200 THEN c ELSE text END AS query FROM c""")  # fmt: skip
def accept_rewrite(spark, sf):
    r = F.expr("""CASE item_id % 4 WHEN 0 THEN concat('"', substr(text, 1, 30), '"') WHEN 1 THEN concat("'", substr(text, 1, 20), "'") WHEN 2 THEN ' ' ELSE repeat('x', 201) END""")
    return read(spark, sf, "benchmark").select("item_id", scalars.accept_rewrite(r, F.col("text")).alias("query"))


@query("json_list", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id::VARCHAR || ',b' ELSE '' END AS items FROM events""")  # fmt: skip
def json_list(spark, sf):
    raw = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('["', user_id, '", "b"]') WHEN 1 THEN props WHEN 2 THEN 'no json' END""")
    return read(spark, sf, "events").select("event_id", F.array_join(scalars.json_list(raw), ",").alias("items"))


@query("decode_cells", "SELECT event_id, user_id::VARCHAR AS a, CASE WHEN event_id % 2 = 0 THEN event_type END AS b FROM events")
def decode_cells(spark, sf):
    cells = F.expr("""concat('[{"type":"integer","value":"', user_id, '"},', if(event_id % 2 = 0, concat('{"type":"text","value":"', event_type, '"}'), '{"type":"null"}'), ']')""")
    return read(spark, sf, "events").withColumn("cells", scalars.decode_cells(cells)).select("event_id", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("parse_atom", """
    SELECT vec_id, '2301.' || lpad(vec_id::VARCHAR, 5, '0') AS arxiv_id, 'Title ' || label AS title, 'A B' AS abstract, 'Ann|Bob' AS authors, 'cs.CL' AS category, '2023-01-05' AS published FROM embeddings""")  # fmt: skip
def parse_atom(spark, sf):
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2301."), F.lpad(F.col("vec_id").cast("string"), 5, "0"), F.lit("v1</id><title>Title "), F.col("label").cast("string"),
        F.lit('</title><summary> A\nB </summary><published>2023-01-05T00:00:00Z</published><author><name>Ann</name></author><author><name>Bob</name></author><category term="cs.CL"/><category term="cs.LG"/></entry>'),
    )
    parsed = read(spark, sf, "embeddings").select("vec_id", scalars.parse_entry(entry).alias("e"))
    return parsed.select("vec_id", "e.arxiv_id", "e.title", "e.abstract", F.array_join("e.authors", "|").alias("authors"), "e.category", "e.published")


_CODES = sorted(c for _, codes in CATEGORY_GROUPS.values() for c in codes)
_CLASS_SQL = """CASE WHEN starts_with(code, 'cs.') THEN 'cs' WHEN starts_with(code, 'hep') OR starts_with(code, 'physics') OR starts_with(code, 'astro') OR starts_with(code, 'quant') OR starts_with(code, 'cond-mat')
    THEN 'physics' WHEN starts_with(code, 'math') OR starts_with(code, 'stat') THEN 'math' WHEN starts_with(code, 'q-bio') THEN 'bio' WHEN starts_with(code, 'econ') THEN 'econ' WHEN starts_with(code, 'eess') THEN 'eess' ELSE 'other' END"""


@query("category_class", f"SELECT doc_id, {_CLASS_SQL} AS class FROM (SELECT doc_id, ({_CODES!r})[(doc_id % {len(_CODES)})::INT + 1] AS code FROM documents)")
def category_class(spark, sf):
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("doc_id") % len(_CODES) + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", scalars.category_class(code).alias("class"))


# --- state -----------------------------------------------------------------------------------------------------------

_STATE_SQL = """
    WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS back FROM interactions WHERE event_type IN ('save', 'not_interested') QUALIFY back <= 70),
    own AS (SELECT user_id, paper_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY back DESC) AS rn FROM last),
    s(user_id, rn, p, n) AS (
      SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM own UNION ALL
      SELECT s.user_id, e.rn,
        CASE WHEN e.event_type <> 'save' THEN list_filter(p, lambda x: x <> e.paper_id) WHEN list_contains(p, e.paper_id) THEN p ELSE list_prepend(e.paper_id, p)[1:20] END,
        CASE WHEN e.event_type = 'save' THEN list_filter(n, lambda x: x <> e.paper_id) WHEN list_contains(n, e.paper_id) THEN n ELSE list_prepend(e.paper_id, n)[1:50] END
      FROM s JOIN own e ON e.user_id = s.user_id AND e.rn = s.rn + 1),
    user_state AS (SELECT user_id, p, n FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)"""


@query("user_state", _STATE_SQL + " SELECT user_id, array_to_string(p, ',') AS positives, array_to_string(n, ',') AS negatives FROM user_state", "interactions", recursive=True)
def user_state(spark, sf):
    return state.user_state(interactions(spark, sf)).select("user_id", joined(F.col("positives")).alias("positives"), joined(F.col("negatives")).alias("negatives"))


@query("all_seen", _STATE_SQL + " SELECT user_id, unnest(list_distinct(list_concat(p, n))) AS paper_id FROM user_state", "interactions", recursive=True)
def all_seen(spark, sf):
    return state.all_seen(state.user_state(interactions(spark, sf)))


def _ewma_sql(event: str, alpha: float) -> str:
    return f"""
    WITH own AS (SELECT user_id, embedding, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, id) AS rn FROM interactions JOIN vectors USING (paper_id) WHERE event_type = '{event}'),
    s(user_id, rn, v) AS (
      SELECT user_id, rn, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) FROM own WHERE rn = 1 UNION ALL
      SELECT user_id, rn, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) FROM (
        SELECT s.user_id, e.rn, list_transform(range(1, len(v) + 1), lambda i: (1 - {alpha}::DOUBLE) * v[i] + {alpha}::DOUBLE * e.embedding[i]) AS b FROM s JOIN own e ON e.user_id = s.user_id AND e.rn = s.rn + 1))
    SELECT user_id, rn AS n, round(v[1], 6) AS first, round(v[len(v)], 6) AS last FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1"""


for _kind, _event in (("long_term", "save"), ("short_term", "save"), ("negative", "not_interested")):

    @query(f"ewma_{_kind}", _ewma_sql(_event, state.ALPHA[_kind]), "interactions", "vectors", recursive=True)
    def ewma(spark, sf, kind=_kind):
        found = state.ewma_profile(interactions(spark, sf), vector_table(spark, sf), kind)
        return found.select("user_id", "n", F.round(F.col("profile")[0], 6).alias("first"), F.round(F.element_at("profile", -1), 6).alias("last"))


_SUPPRESSED = f"""suppressed AS (SELECT user_id, category, count(*) AS n FROM interactions JOIN named USING (paper_id)
    WHERE event_type = 'not_interested' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND category <> '' GROUP BY ALL HAVING count(*) >= 3)"""


@query("suppressed_categories", f"WITH {_NAMED}, {_SUPPRESSED} SELECT * FROM suppressed", "interactions", "papers")
def suppressed_categories(spark, sf):
    return state.suppressed_categories(interactions(spark, sf), named(spark, sf), AS_OF)


@query("suppression_filter", f"""
    WITH {_NAMED}, {_SUPPRESSED}, c AS (SELECT DISTINCT user_id, paper_id, category FROM interactions JOIN named USING (paper_id) WHERE event_type = 'view'),
    m AS (SELECT c.*, s.n IS NOT NULL AS bad, sum((s.n IS NULL)::INT) OVER (PARTITION BY c.user_id) AS good FROM c LEFT JOIN suppressed s USING (user_id, category))
    SELECT user_id, paper_id, category FROM m WHERE NOT bad OR good = 0""", "interactions", "papers")  # fmt: skip
def suppression_filter(spark, sf):
    log, meta = interactions(spark, sf), named(spark, sf)
    seen = log.where("event_type = 'view'").join(meta, "paper_id").select("user_id", "paper_id", "category").distinct()
    return ranking.drop_suppressed(seen, state.suppressed_categories(log, meta, AS_OF)).select("user_id", "paper_id", "category")


@query("tier_assignment", _STATE_SQL + """,
    prof AS (SELECT user_id, count(*) AS n FROM interactions JOIN vectors USING (paper_id) WHERE event_type = 'save' GROUP BY user_id)
    SELECT user_id, CASE WHEN len(p) >= 5 THEN 1 WHEN coalesce(prof.n, 0) >= 3 THEN 2 WHEN len(p) >= 1 THEN 3 ELSE 0 END AS tier FROM user_state LEFT JOIN prof USING (user_id)""", "interactions", "vectors", recursive=True)  # fmt: skip
def tier_assignment(spark, sf):
    log = interactions(spark, sf)
    return state.tiers(state.user_state(log), state.ewma_profile(log, vector_table(spark, sf), "long_term"))


@query("onboarding_status", """
    WITH u AS (SELECT c_custkey AS user_id FROM customer), o AS (SELECT c_custkey AS user_id, c_custkey % 4 = 0 AS completed FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT DISTINCT user_id FROM interactions WHERE event_type = 'save')
    SELECT u.user_id, CASE WHEN coalesce(completed, false) OR a.user_id IS NOT NULL THEN 'complete' WHEN completed IS NOT NULL THEN 'in_progress' ELSE 'new' END AS status
    FROM u LEFT JOIN o USING (user_id) LEFT JOIN a ON a.user_id = u.user_id""", "interactions")  # fmt: skip
def onboarding_status(spark, sf):
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    rows = users.where("user_id % 2 = 0").withColumn("completed", F.col("user_id") % 4 == 0)
    return state.onboarding_status(users, rows, interactions(spark, sf).where("event_type = 'save'"))


_GROUP_KEYS = [*CATEGORY_GROUPS, "unknown"]


@query("category_filter", f"""
    WITH t AS (SELECT unnest({list(CATEGORY_GROUPS)!r}) AS k, unnest({[c for _, c in CATEGORY_GROUPS.values()]!r}) AS codes),
    g AS (SELECT DISTINCT user_id, ({_GROUP_KEYS!r})[(paper_id % {len(_GROUP_KEYS)})::INT + 1] AS k FROM interactions WHERE event_type = 'click')
    SELECT DISTINCT user_id, unnest(codes) AS code FROM g JOIN t USING (k)""", "interactions")  # fmt: skip
def category_filter(spark, sf):
    key = F.element_at(F.array(*[F.lit(k) for k in _GROUP_KEYS]), (F.col("paper_id") % len(_GROUP_KEYS) + 1).cast("int"))
    return tables.category_codes(interactions(spark, sf).where("event_type = 'click'").select("user_id", key.alias("group_key")).distinct())


@query("onboarding_valid", f"""
    SELECT user_id, string_agg(k, ',' ORDER BY id) AS keys FROM (SELECT user_id, id, ({_GROUP_KEYS!r})[(paper_id % {len(_GROUP_KEYS)})::INT + 1] AS k FROM interactions) WHERE k <> 'unknown' GROUP BY user_id""", "interactions")  # fmt: skip
def onboarding_valid(spark, sf):
    key = F.element_at(F.array(*[F.lit(k) for k in _GROUP_KEYS]), (F.col("paper_id") % len(_GROUP_KEYS) + 1).cast("int"))
    picked = interactions(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("id", key.alias("k")))).alias("p"))
    return picked.select("user_id", F.array_join(tables.valid_groups(F.transform("p", lambda x: x["k"])), ",").alias("keys"))


# --- sets and flags --------------------------------------------------------------------------------------------------


@query("flag_membership", """
    SELECT DISTINCT v.user_id, v.paper_id, EXISTS (FROM interactions s WHERE s.event_type = 'save' AND s.user_id = v.user_id AND s.paper_id = v.paper_id) AS saved,
      EXISTS (FROM interactions s WHERE s.event_type = 'not_interested' AND s.user_id = v.user_id AND s.paper_id = v.paper_id) AS dismissed FROM interactions v WHERE event_type = 'view'""", "interactions")  # fmt: skip
def flag_membership(spark, sf):
    log = interactions(spark, sf)
    rows = log.where("event_type = 'view'").select("user_id", "paper_id").distinct()
    return tables.flagged(rows, {"saved": log.where("event_type = 'save'"), "dismissed": log.where("event_type = 'not_interested'")}, ["user_id", "paper_id"])


@query("missing_ids", "SELECT DISTINCT paper_id FROM interactions WHERE paper_id NOT IN (SELECT paper_id FROM papers WHERE paper_id % 3 = 0)", "interactions", "papers")
def missing_ids(spark, sf):
    return interactions(spark, sf).select("paper_id").distinct().join(papers(spark, sf).where("paper_id % 3 = 0"), "paper_id", "left_anti")


@query("valid_candidates", "SELECT vec_id AS paper_id FROM embeddings INTERSECT SELECT paper_id FROM papers WHERE citation_count > 100", "papers")
def valid_candidates(spark, sf):
    return vector_table(spark, sf).select("paper_id").intersect(papers(spark, sf).where("citation_count > 100").select("paper_id"))


@query("ordered_distinct", "SELECT user_id, paper_id, id FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id, paper_id ORDER BY id) = 1", "interactions")
def ordered_distinct(spark, sf):
    return fusion.ordered_distinct(interactions(spark, sf).select("user_id", "paper_id", "id"), "user_id", "paper_id", "id")


@query("ordered_enrich", f"""
    WITH {_NAMED}, r AS (SELECT user_id, paper_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC)::INT AS rank FROM interactions QUALIFY rank <= 20)
    SELECT user_id, rank, paper_id, category, citation_count FROM r JOIN named USING (paper_id)""", "interactions", "papers")  # fmt: skip
def ordered_enrich(spark, sf):
    return tables.enrich(state.recent(interactions(spark, sf), 20), named(spark, sf), "paper_id").select("user_id", "rank", "paper_id", "category", "citation_count")


@query("attach_tags", "SELECT user_id, paper_id, true AS saved, 'heuristic_v1' AS ranker_version FROM interactions WHERE event_type = 'save'", "interactions")
def attach_tags(spark, sf):
    return interactions(spark, sf).where("event_type = 'save'").select("user_id", "paper_id", F.lit(True).alias("saved"), F.lit("heuristic_v1").alias("ranker_version"))


@query("trending", "SELECT paper_id, citation_count, update_date FROM papers WHERE primary_topic IN ('src1', 'src2', 'src3') AND citation_count > 0 ORDER BY citation_count DESC, update_date DESC, arxiv_id LIMIT 10", "papers")
def trending(spark, sf):
    return tables.trending(papers(spark, sf), ["src1", "src2", "src3"], 10).select("paper_id", "citation_count", "update_date")


@query("saved_papers", _STATE_SQL + f""", {_NAMED}, pos AS (SELECT user_id, unnest(p) AS paper_id, generate_subscripts(p, 1) - 1 AS pos FROM user_state)
    SELECT user_id, pos::INT AS pos, paper_id, category FROM pos JOIN named USING (paper_id)""", "interactions", "papers", recursive=True)  # fmt: skip
def saved_papers(spark, sf):
    return tables.enrich(state.exploded(state.user_state(interactions(spark, sf)), "positives"), named(spark, sf), "paper_id").select("user_id", "pos", "paper_id", "category")


# --- vectors and retrieval -------------------------------------------------------------------------------------------


@query("l2_normalise", "SELECT paper_id, round((embedding[1] * 3) / sqrt(list_dot_product(list_transform(embedding, lambda x: x * 3), list_transform(embedding, lambda x: x * 3))), 9) AS first FROM vectors", "vectors")
def l2_normalise(spark, sf):
    return vector_table(spark, sf).select("paper_id", F.round(vectors.l2_normalise(F.transform("embedding", lambda x: x * 3))[0], 9).alias("first"))


@query("centroid_by_label", """
    WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vectors), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL)
    SELECT label, round(sum(m * m), 6) AS square, round(max(m) FILTER (i = 1), 6) AS first FROM m GROUP BY label""", "vectors")  # fmt: skip
def centroid_by_label(spark, sf):
    c = vectors.centroid(vector_table(spark, sf), "label")
    return c.select("label", F.round(vectors.dot(F.col("centroid"), F.col("centroid")), 6).alias("square"), F.round(F.col("centroid")[0], 6).alias("first"))


_DENSE_SQL = """SELECT q.paper_id AS query_id, v.paper_id, round(list_dot_product(q.embedding, v.embedding), 9) AS score,
      row_number() OVER (PARTITION BY q.paper_id ORDER BY round(list_dot_product(q.embedding, v.embedding), 9) DESC, v.paper_id)::INT AS rank FROM vectors q, vectors v"""
#: A benchmark item asks with the vector whose id is the item's modulo the number of vectors.
_ITEM_DENSE_SQL = f"SELECT item_id AS query_id, d.paper_id, d.score, d.rank FROM benchmark JOIN ({_DENSE_SQL}) d ON d.query_id = item_id % (SELECT count(*) FROM vectors)"


def _query_vectors(spark, sf):
    """Every vector is a query against all."""
    return vector_table(spark, sf).select(F.col("paper_id").alias("query_id"), "embedding")


def _item_vectors(spark, sf):
    items = vector_table(spark, sf)
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(F.broadcast(items.agg(F.count(F.lit(1)).alias("n"))))
    return asked.join(items, F.col("query_id") % F.col("n") == F.col("paper_id")).select("query_id", "embedding")


@query("dense_topk", f"SELECT query_id, paper_id, rank, score FROM ({_DENSE_SQL}) WHERE rank <= 50", "vectors")
def dense_topk(spark, sf):
    return vectors.dense_topk(_query_vectors(spark, sf), vector_table(spark, sf), 50).select("query_id", "paper_id", "rank", "score")


@query("exclude_seen", f"""
    WITH r AS ({_DENSE_SQL}), keep AS (SELECT * FROM r WHERE rank <= 40 AND NOT EXISTS (FROM interactions i WHERE i.user_id = r.query_id AND i.paper_id = r.paper_id))
    SELECT * FROM (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM keep) WHERE rank <= 20""", "vectors", "interactions")  # fmt: skip
def exclude_seen(spark, sf):
    ranked = vectors.dense_topk(_query_vectors(spark, sf), vector_table(spark, sf), 40)
    seen = interactions(spark, sf).select(F.col("user_id").alias("query_id"), "paper_id").distinct()
    return fusion.exclude_seen(ranked, seen, 20).select("query_id", "paper_id", "rank")


_TERMS = r"""{name} AS (SELECT {key} AS {alias}, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {key})) AS weight FROM (
      SELECT {key}, term, count(*)::DOUBLE AS tf FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM {table}) GROUP BY ALL))"""
_SPARSE_SQL = (
    _TERMS.format(name="postings", key="doc_id", alias="paper_id", table="documents") + ", " + _TERMS.format(name="asked", key="item_id", alias="query_id", table="benchmark")
    + """, sparse AS (SELECT query_id, paper_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id)::INT AS rank FROM (
      SELECT query_id, paper_id, round(sum(p.weight * a.weight), 9) AS score FROM postings p JOIN asked a USING (term) GROUP BY ALL))"""
)


def _asked_terms(spark, sf):
    return sparse.term_vectors(read(spark, sf, "benchmark"), "item_id").withColumnRenamed("item_id", "query_id")


def _postings(spark, sf):
    """An index over all documents, for the call; a service would keep it."""
    return PostingIndex(spark, build_postings(sparse.term_counts(read(spark, sf, "documents"), "doc_id"), "doc_id"))


def _sparse(spark, sf, k):
    return _postings(spark, sf).search(_asked_terms(spark, sf), k)


@query("sparse_topk", f"WITH {_SPARSE_SQL} SELECT query_id, paper_id, score, rank FROM sparse WHERE rank <= 50")
def sparse_topk(spark, sf):
    """By a scan of all documents."""
    items = sparse.term_vectors(read(spark, sf, "documents"), "doc_id").withColumnRenamed("doc_id", "paper_id")
    return sparse.sparse_topk(_asked_terms(spark, sf), items, 50).select("query_id", "paper_id", "score", "rank")


@query("sparse_topk_index", f"WITH {_SPARSE_SQL} SELECT query_id, paper_id, score, rank FROM sparse WHERE rank <= 50")
def sparse_topk_index(spark, sf):
    """By the stored index of postings."""
    return _sparse(spark, sf, 50)


_RRF_SQL = f"""
    WITH {_SPARSE_SQL}, dense AS ({_ITEM_DENSE_SQL}),
    terms AS (SELECT query_id, paper_id, 1.0::DOUBLE / (60 + rank) AS term, 0 AS l, rank FROM dense WHERE rank <= 60 UNION ALL SELECT query_id, paper_id, 1.0::DOUBLE / (60 + rank), 1, rank FROM sparse WHERE rank <= 60),
    summed AS (SELECT query_id, paper_id, round(sum(term), 12) AS rrf_score, min((l, rank)) AS seen FROM terms GROUP BY ALL),
    fused AS (SELECT query_id, paper_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen)::INT AS fused_rank FROM summed)"""


@query("rrf_fuse", _RRF_SQL + " SELECT query_id, paper_id, round(rrf_score, 9) AS rrf_score, fused_rank FROM fused", "vectors")
def rrf_fuse(spark, sf):
    fused = fusion.rrf([vectors.dense_topk(_item_vectors(spark, sf), vector_table(spark, sf), 60), _sparse(spark, sf, 60)])
    return fused.select("query_id", "paper_id", F.round("rrf_score", 9).alias("rrf_score"), "fused_rank")


_HYBRID_SQL = _RRF_SQL + f""",
    aged AS (SELECT f.*, p.title, min(rrf_score) OVER q AS lo, max(rrf_score) OVER q AS hi,
      greatest(0.0, 1.0 - greatest(0, {AS_OF_MONTH} - ((2000 + substr(arxiv_id, 1, 2)::INT) * 12 + substr(arxiv_id, 3, 2)::INT)) / 120.0::DOUBLE) AS recency
      FROM fused f JOIN papers p USING (paper_id) WINDOW q AS (PARTITION BY query_id)),
    final AS (SELECT *, round(0.8::DOUBLE * ((rrf_score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END) + 0.2::DOUBLE * recency, 9) AS final_score FROM aged),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, fused_rank)::INT AS rank FROM final)"""


@query("recency_rerank", _HYBRID_SQL + " SELECT query_id, paper_id, rank, final_score FROM ranked", "vectors", "papers")
def recency_rerank(spark, sf):
    fused = fusion.rrf([vectors.dense_topk(_item_vectors(spark, sf), vector_table(spark, sf), 60), _sparse(spark, sf, 60)])
    ranked = fusion.recency_rerank(fused.join(papers(spark, sf).select("paper_id", "arxiv_id"), "paper_id"), AS_OF_MONTH)
    return ranked.select("query_id", "paper_id", "rank", "final_score")


@query("hybrid_search", _HYBRID_SQL + " SELECT query_id, rank, paper_id, final_score, title FROM ranked WHERE rank <= 10", "vectors", "papers")
def hybrid(spark, sf):
    return hybrid_search(_item_vectors(spark, sf), _asked_terms(spark, sf), vector_table(spark, sf), _postings(spark, sf), papers(spark, sf), AS_OF_MONTH)


_REWRITE_SQL = r"""plain AS (SELECT item_id AS query_id, trim(text) AS q FROM benchmark),
    judged AS (SELECT *, len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')) > 6
      AND len(regexp_extract_all(q, '(?i)(?:\d{4}\.\d{4,5}|[A-Z]{2,}|transformer|attention|neural|network|\b(?:et\s+al|arxiv)\b)')) >= 2 AS academic, trim(trim(trim(trim(regexp_replace(q, '^\S+ ', '')), '"'), '''')) AS c FROM plain),
    rewritten AS (SELECT query_id, CASE WHEN q = '' OR academic OR c = '' OR length(c) > 200 THEN q ELSE c END AS text FROM judged),
    able AS (SELECT * FROM rewritten WHERE text <> '' AND length(text) % 5 <> 0),
    words AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM rewritten WHERE text <> '' AND length(text) % 5 = 0)"""
_AXIS_SQL = "SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY round(embedding[length(text) % 64 + 1], 9) DESC, paper_id)::INT AS rank FROM able, vectors"
_SEARCH_SQL = (
    f"WITH {_REWRITE_SQL}, {_BM25_SQL}, "
    + _HYBRID_SQL.strip()[5:]
    .replace(_TERMS.format(name="asked", key="item_id", alias="query_id", table="benchmark"), _TERMS.format(name="asked", key="query_id", alias="query_id", table="able"))
    .replace(_ITEM_DENSE_SQL, _AXIS_SQL)
    + " SELECT query_id, rank, paper_id, 'hybrid' AS origin FROM ranked WHERE rank <= 10 UNION ALL SELECT query_id, rank, doc_id, 'keyword' FROM by_words"
)


def _axis(texts: list[str]) -> list:
    """An encoder for tests: the axis that a text's length names, and nothing for some lengths."""
    return [None if len(t) % 5 == 0 else [float(i == len(t) % 64) for i in range(64)] for t in texts]


def _searched(spark, sf):
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return queries, search(queries, vector_table(spark, sf), texts, papers(spark, sf), _axis, 64, AS_OF_MONTH, lambda q: F.regexp_replace(q, r"^\S+ ", ""))


@query("search_text", _SEARCH_SQL, "vectors", "papers")
def search_text(spark, sf):
    return _searched(spark, sf)[1]


@query("seed_search", f"""WITH found AS ({_SEARCH_SQL}) SELECT query_id, rank, paper_id, title, CASE WHEN paper_id % 3 = 0 THEN 'cache' ELSE 'remote' END AS origin
    FROM (SELECT query_id, rank, paper_id FROM found WHERE rank <= 6) JOIN papers USING (paper_id)""", "vectors", "papers")  # fmt: skip
def seed_search(spark, sf):
    queries, found = _searched(spark, sf)
    remote = papers(spark, sf).select("paper_id", "title").withColumn("origin", F.lit("remote"))
    cache = remote.where("paper_id % 3 = 0").withColumn("origin", F.lit("cache"))
    return seed_papers(queries, found, cache, remote).select("query_id", "rank", "paper_id", "title", "origin")


@query("multi_interest_rrf", f"""
    WITH d AS ({_DENSE_SQL}), t AS (SELECT query_id // 5 AS user_id, paper_id, 1.0::DOUBLE / (60 + rank) AS term, (query_id % 5, rank) AS seen FROM d WHERE rank <= 30),
    f AS (SELECT user_id, paper_id, round(sum(term), 12) AS s, min(seen) AS seen FROM t GROUP BY ALL)
    SELECT user_id AS query_id, paper_id, round(s, 9) AS rrf_score, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, seen)::INT AS fused_rank FROM f QUALIFY fused_rank <= 100""", "vectors")  # fmt: skip
def multi_interest_rrf(spark, sf):
    """Five neighbouring vectors are a user's interests."""
    # Written once, or each interest's list would compute the answers of all.
    found = staged(vectors.dense_topk(_query_vectors(spark, sf), vector_table(spark, sf), 30), "interests")
    lists = [found.where(F.col("query_id") % 5 == i).withColumn("query_id", F.expr("query_id div 5")) for i in range(5)]
    return fusion.rrf(lists).where("fused_rank <= 100").select("query_id", "paper_id", F.round("rrf_score", 9).alias("rrf_score"), "fused_rank")


_BEST_SQL = """
    WITH ex AS (SELECT label % 5 AS query_id, paper_id, embedding, label < 5 AS positive FROM vectors),
    near AS (SELECT e.query_id, v.paper_id, coalesce(max(round(list_dot_product(e.embedding, v.embedding), 9)) FILTER (positive), -2) AS good, coalesce(max(round(list_dot_product(e.embedding, v.embedding), 9)) FILTER (NOT positive), -1) AS bad
      FROM ex e, vectors v GROUP BY ALL),
    scored AS (SELECT query_id, paper_id, round(CASE WHEN good > bad THEN good ELSE -bad * bad END, 9) AS score FROM near n WHERE NOT EXISTS (FROM ex WHERE ex.query_id = n.query_id AND ex.paper_id = n.paper_id))
    SELECT query_id, paper_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id)::INT AS rank FROM scored
    WHERE query_id IN (SELECT query_id FROM ex WHERE positive) QUALIFY rank <= 10"""


@query("best_score_recommend", _BEST_SQL.replace("SELECT label % 5 AS query_id", "SELECT (label % 5)::BIGINT AS query_id"), "vectors")
def best_score_recommend(spark, sf):
    items = vector_table(spark, sf)
    examples = items.select((F.col("label") % 5).cast("long").alias("query_id"), "paper_id", "embedding", (F.col("label") < 5).alias("positive"))
    return ranking.best_score(examples, items, 10)


# --- quotas, ranking, diversity --------------------------------------------------------------------------------------

_IMPORTANCE = """recent20 AS (SELECT user_id, paper_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rank FROM interactions WHERE event_type = 'save' QUALIFY rank <= 20),
    importance AS (SELECT user_id, label AS cluster_idx, round(sum(1.0::DOUBLE / rank), 9) AS importance FROM recent20 JOIN vectors USING (paper_id) GROUP BY ALL)"""


def _importance(spark, sf):
    saves = state.recent(interactions(spark, sf), 20, ["save"]).join(vector_table(spark, sf), "paper_id")
    return saves.groupBy("user_id", F.col("label").alias("cluster_idx")).agg(F.round(F.sum(F.lit(1.0) / F.col("rank")), 9).alias("importance"))


@query("cluster_importance", f"WITH {_IMPORTANCE} SELECT * FROM importance", "interactions", "vectors")
def cluster_importance(spark, sf):
    return _importance(spark, sf)


@query("clusters_by_importance", f"WITH {_IMPORTANCE} SELECT user_id, cluster_idx, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, cluster_idx)::INT AS place FROM importance", "interactions", "vectors")
def clusters_by_importance(spark, sf):
    order = W.partitionBy("user_id").orderBy(F.desc("importance"), "cluster_idx")
    return _importance(spark, sf).select("user_id", "cluster_idx", F.row_number().over(order).alias("place"))


_QUOTA_SQL = f"""
    WITH {_IMPORTANCE}, w AS (SELECT *, sum(importance) OVER u AS total, count(*) OVER u AS n FROM importance WINDOW u AS (PARTITION BY user_id)),
    r AS (SELECT *, round(importance / total * 100, 9) AS raw, greatest(floor(round(importance / total * 100, 9)), 3)::INT AS low FROM w),
    o AS (SELECT *, 100 - sum(low) OVER (PARTITION BY user_id) AS rest, row_number() OVER (PARTITION BY user_id ORDER BY raw % 1 DESC, cluster_idx) AS place FROM r),
    quotas AS (SELECT user_id, cluster_idx, importance, (CASE WHEN n = 1 THEN 100 ELSE low + (place <= rest)::INT END)::INT AS quota FROM o)"""


@query("allocate_quotas", _QUOTA_SQL + " SELECT * FROM quotas", "interactions", "vectors")
def allocate_quotas(spark, sf):
    return fusion.allocate_quotas(_importance(spark, sf))


def _merge_sql() -> str:
    lists = f"""lists AS (SELECT query_id // 4 AS user_id, query_id % 4 + 1 AS list_no, paper_id, rank, 8 - query_id % 4 AS quota FROM ({_DENSE_SQL}) WHERE rank <= 30)"""
    steps = []
    for i in range(1, 5):
        before = f"AND NOT EXISTS (FROM t{i - 1} t WHERE t.user_id = l.user_id AND t.paper_id = l.paper_id)" if i > 1 else ""
        own = f"SELECT user_id, paper_id, list_no, rank FROM lists l WHERE list_no = {i} {before} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) <= quota"
        steps.append(f"t{i} AS ({own})" if i == 1 else f"t{i} AS (SELECT * FROM t{i - 1} UNION ALL ({own}))")
    return f"WITH {lists}, {', '.join(steps)} SELECT user_id, paper_id, list_no, row_number() OVER (PARTITION BY user_id ORDER BY list_no, rank)::INT AS position FROM t4"


def _lists(spark, sf):
    found = vectors.dense_topk(_query_vectors(spark, sf), vector_table(spark, sf), 30)
    return found.select(F.expr("query_id div 4").alias("user_id"), (F.col("query_id") % 4 + 1).alias("list_no"), "paper_id", "rank", (8 - F.col("query_id") % 4).alias("quota"))


@query("merge_quota", _merge_sql(), "vectors")
def merge_quota(spark, sf):
    return fusion.merge_quota(_lists(spark, sf))


@query("cluster_attribution", f"SELECT query_id // 4 AS user_id, paper_id, min(query_id % 4 + 1) AS list_no FROM ({_DENSE_SQL}) WHERE rank <= 30 GROUP BY ALL", "vectors")
def cluster_attribution(spark, sf):
    return fusion.attribution(_lists(spark, sf))


_FEATURES = f"""
    {_NAMED}, c AS (
      SELECT v.label::BIGINT AS user_id, v.paper_id, v.embedding, published, row_number() OVER (PARTITION BY v.label ORDER BY v.paper_id) - 1 AS position FROM vectors v JOIN named USING (paper_id)),
    f AS (SELECT c.user_id, c.paper_id, position, date_diff('day', published::DATE, DATE '{AS_OF}') AS age,
      list_dot_product(c.embedding, o.embedding) / ((sqrt(list_dot_product(c.embedding, c.embedding)) + 1e-10) * (sqrt(list_dot_product(o.embedding, o.embedding)) + 1e-10)) AS lt_sim,
      list_dot_product(c.embedding, n.embedding) / ((sqrt(list_dot_product(c.embedding, c.embedding)) + 1e-10) * (sqrt(list_dot_product(n.embedding, n.embedding)) + 1e-10)) AS neg_sim
      FROM c LEFT JOIN vectors o ON o.paper_id = c.user_id + 1 LEFT JOIN vectors n ON n.paper_id = c.user_id + 20)"""


def _featured(spark, sf):
    items = vector_table(spark, sf)
    meta = named(spark, sf).select("paper_id", "published", "category", "arxiv_id", "citation_count")
    candidates = items.join(meta, "paper_id").select(
        F.col("label").cast("long").alias("user_id"), "paper_id", (F.row_number().over(W.partitionBy("label").orderBy("paper_id")) - 1).alias("position"), "embedding", "published", "category"
    )
    users = items.select(F.col("label").cast("long").alias("user_id")).distinct()
    own = lambda first, name: items.select((F.col("paper_id") - first).alias("user_id"), F.col("embedding").alias(name))
    profiles = users.join(own(1, "lt"), "user_id").join(own(20, "neg"), "user_id").withColumn("st", F.lit(None).cast("array<double>"))
    return ranking.features(candidates, profiles, AS_OF)


@query("rank_features", f"WITH {_FEATURES.strip()} SELECT user_id, paper_id, position::INT AS position, age::INT AS age, round(lt_sim, 6) AS lt_sim, 0.0::DOUBLE AS st_sim, round(neg_sim, 6) AS neg_sim FROM f", "vectors", "papers")
def rank_features(spark, sf):
    f = _featured(spark, sf)
    return f.select("user_id", "paper_id", "position", "age", *[F.round(c, 6).alias(c) for c in ("lt_sim", "st_sim", "neg_sim")])


_SCORED = f"""{_FEATURES.strip()}, scored AS (SELECT user_id, paper_id, position, round(0.4::DOUBLE * lt_sim + 0.15::DOUBLE * exp(-0.002::DOUBLE * age) + 0.1::DOUBLE * (1 - position / (max(position) OVER (PARTITION BY user_id) + 1)::DOUBLE)
    - 0.15::DOUBLE * greatest(neg_sim, 0), 9) AS score FROM f), reranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, position)::INT AS rank FROM scored)"""


@query("heuristic_score", f"WITH {_SCORED} SELECT user_id, paper_id, score FROM scored", "vectors", "papers")
def heuristic_score(spark, sf):
    return ranking.rerank(_featured(spark, sf)).select("user_id", "paper_id", "score")


@query("rerank", f"WITH {_SCORED} SELECT user_id, paper_id, rank FROM reranked", "vectors", "papers")
def rerank(spark, sf):
    return ranking.rerank(_featured(spark, sf)).select("user_id", "paper_id", "rank")


@query("mmr_relevance", f"""WITH {_SCORED} SELECT user_id, paper_id, round(CASE WHEN max(score) OVER u = min(score) OVER u THEN 1.0 ELSE (score - min(score) OVER u) / (max(score) OVER u - min(score) OVER u) END, 6) AS relevance
    FROM scored WINDOW u AS (PARTITION BY user_id)""", "vectors", "papers")  # fmt: skip
def mmr_relevance(spark, sf):
    return ranking.relevance(ranking.rerank(_featured(spark, sf))).select("user_id", "paper_id", F.round("relevance", 6).alias("relevance"))


_MMR_SQL = f"""WITH {_SCORED}, pool AS (SELECT r.*, max(score) OVER u AS hi, min(score) OVER u AS lo, count(*) OVER u AS n, list_transform(embedding, lambda x: x / (sqrt(list_dot_product(embedding, embedding)) + 1e-10)) AS unit
      FROM (SELECT * FROM reranked WHERE rank <= 100) r JOIN vectors USING (paper_id) WINDOW u AS (PARTITION BY user_id)),
    cand AS (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS rel FROM pool WHERE n > 20),
    s(user_id, step, ids, units) AS (SELECT DISTINCT user_id, 0, []::BIGINT[], []::DOUBLE[][] FROM cand UNION ALL
      SELECT user_id, step + 1, list_append(ids, best.p), list_append(units, best.e) FROM (
        SELECT s.user_id, s.step, any_value(s.ids) AS ids, any_value(s.units) AS units,
          max({{'v': round(0.6::DOUBLE * c.rel - 0.4::DOUBLE * coalesce(list_max(list_transform(s.units, lambda e: round(list_dot_product(e, c.unit), 9))), 0), 9), 'r': -c.rank, 'p': c.paper_id, 'e': c.unit}}) AS best
        FROM s JOIN cand c ON c.user_id = s.user_id AND NOT list_contains(s.ids, c.paper_id) WHERE s.step < 20 GROUP BY s.user_id, s.step))
    SELECT user_id, unnest(ids) AS paper_id, generate_subscripts(ids, 1)::INT AS mmr_rank FROM s WHERE step = 20 UNION ALL SELECT user_id, paper_id, rank FROM pool WHERE n <= 20"""


@query("mmr", _MMR_SQL, "vectors", "papers", recursive=True)
def mmr(spark, sf):
    return ranking.mmr(ranking.rerank(_featured(spark, sf)).where("rank <= 100"), 20)


@query("exploration", f"""WITH {_SCORED}, left_ AS (SELECT user_id, paper_id, md5(user_id || '|' || paper_id || '|0') AS draw FROM reranked WHERE rank > 10)
    SELECT user_id, paper_id, row_number() OVER (PARTITION BY user_id ORDER BY draw)::INT AS explore_rank FROM left_ QUALIFY explore_rank <= 2""", "vectors", "papers")  # fmt: skip
def exploration(spark, sf):
    ranked = ranking.rerank(_featured(spark, sf))
    return ranking.explore(ranked.where("rank <= 10"), ranked).select("user_id", "paper_id", "explore_rank")


@query("candidate_tags", """SELECT paper_id, CASE WHEN paper_id % 5 = 0 THEN 'exploration' WHEN label = 9 THEN 'short_term_supplement' WHEN label IS NOT NULL AND label <> 8 THEN 'cluster_' || label ELSE 'tier1_unknown' END AS candidate_source FROM vectors""", "vectors")
def candidate_tags(spark, sf):
    index = F.expr("CASE label WHEN 9 THEN -1 WHEN 8 THEN NULL ELSE label END")
    return vector_table(spark, sf).select("paper_id", scalars.candidate_source(index, F.col("paper_id") % 5 == 0).alias("candidate_source"))


@query("pairwise_similarity", f"""WITH c AS MATERIALIZED (SELECT query_id, d.paper_id, embedding FROM ({_DENSE_SQL}) d JOIN vectors v USING (paper_id) WHERE rank <= 20)
    SELECT x.query_id, x.paper_id AS a, y.paper_id AS b, round(list_dot_product(x.embedding, y.embedding), 6) AS similarity FROM c x JOIN c y USING (query_id) WHERE x.paper_id < y.paper_id""", "vectors")  # fmt: skip
def pairwise_similarity(spark, sf):
    items = vector_table(spark, sf)
    return evaluation.pairwise_similarity(vectors.dense_topk(_query_vectors(spark, sf), items, 20).join(items.select("paper_id", "embedding"), "paper_id"))


def _saved(spark, sf):
    return state.exploded(state.user_state(interactions(spark, sf)), "positives").join(vector_table(spark, sf).select("paper_id", "embedding"), "paper_id")


@query("user_clusters")
def user_clusters(spark, sf):
    found = clustering.user_clusters(_saved(spark, sf))
    return found.select("user_id", "cluster_idx", "medoid_paper_id", joined(F.col("paper_ids")).alias("paper_ids"), F.round("importance", 9).alias("importance"))


@query("stabilize_clusters")
def stabilize_clusters(spark, sf):
    saved = staged(_saved(spark, sf), "saved")
    old = clustering.user_clusters(saved.where("pos >= 3")).select("user_id", "cluster_idx", "medoid_embedding")
    return clustering.stabilise(clustering.user_clusters(saved), old).select("user_id", "cluster_idx", "medoid_paper_id", F.size("paper_ids").alias("n"))


@query("profile_lookup", "SELECT user_id, count(*) AS n FROM interactions JOIN vectors USING (paper_id) WHERE event_type = 'save' AND user_id IN (3, 7, 11) GROUP BY user_id", "interactions", "vectors")
def profile_lookup(spark, sf):
    return profile_table(interactions(spark, sf).where("user_id IN (3, 7, 11)"), vector_table(spark, sf)).where("lt IS NOT NULL").select("user_id", "n")


@query("recommend_multi_interest")
def recommend_multi_interest(spark, sf):
    return multi_interest(interactions(spark, sf), vector_table(spark, sf), named(spark, sf), AS_OF)


@query("recommend")
def recommend_all(spark, sf):
    return recommend(interactions(spark, sf), vector_table(spark, sf), named(spark, sf), ["src1", "src2", "src3"], AS_OF)


# --- evaluation and extensions ---------------------------------------------------------------------------------------


@query("affinity", "SELECT user_id, paper_id, round(sum(CASE event_type WHEN 'save' THEN 1.0 WHEN 'click' THEN 0.3 WHEN 'not_interested' THEN -1.0 ELSE 0 END)::DOUBLE, 9) AS affinity, max(timestamp) AS last FROM interactions GROUP BY ALL", "interactions")
def affinity(spark, sf):
    return evaluation.affinity(interactions(spark, sf))


@query("rates", """SELECT user_id, count(*) FILTER (event_type = 'view') AS views,
    round(CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view')::DOUBLE ELSE 0 END, 9) AS click_rate,
    round(CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN count(*) FILTER (event_type = 'save') / count(*) FILTER (event_type = 'view')::DOUBLE ELSE 0 END, 9) AS save_rate FROM interactions GROUP BY user_id""", "interactions")  # fmt: skip
def rates(spark, sf):
    return evaluation.rates(interactions(spark, sf))


@query("weighted_profile", f"""
    WITH w AS (SELECT user_id, paper_id, CASE event_type WHEN 'save' THEN 1.0 WHEN 'click' THEN 0.3 WHEN 'not_interested' THEN -1.0 END::DOUBLE * pow(0.5::DOUBLE, date_diff('day', timestamp::DATE, DATE '{AS_OF}') / 30.0::DOUBLE) AS w
      FROM interactions WHERE event_type IN ('save', 'click', 'not_interested'))
    SELECT user_id, round(sum(w * embedding[1]) / sum(abs(w)), 6) AS first, round(sum(w * embedding[len(embedding)]) / sum(abs(w)), 6) AS last, round(sum(abs(w)), 6) AS weight FROM w JOIN vectors USING (paper_id) GROUP BY user_id""", "interactions", "vectors")  # fmt: skip
def weighted_profile(spark, sf):
    found = evaluation.weighted_profile(interactions(spark, sf), vector_table(spark, sf), AS_OF)
    return found.select("user_id", F.round(F.col("profile")[0], 6).alias("first"), F.round(F.element_at("profile", -1), 6).alias("last"), F.round("weight", 6).alias("weight"))


@query("dwell_weighted_profile", f"""
    WITH g AS (SELECT *, epoch_ms(lead(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, id)) - epoch_ms(timestamp) AS dwell FROM interactions),
    w AS (SELECT user_id, paper_id, CASE WHEN dwell > 0 AND dwell < 10000 THEN 0.1 WHEN dwell > 120000 THEN 1.5 ELSE 1.0 END::DOUBLE * CASE event_type WHEN 'save' THEN 1.0 WHEN 'click' THEN 0.3 WHEN 'not_interested' THEN -1.0 END::DOUBLE * pow(0.5::DOUBLE, date_diff('day', timestamp::DATE, DATE '{AS_OF}') / 30.0::DOUBLE) AS w
      FROM g WHERE event_type IN ('save', 'click', 'not_interested'))
    SELECT user_id, round(sum(w * embedding[1]) / sum(abs(w)), 6) AS first, round(sum(w * embedding[len(embedding)]) / sum(abs(w)), 6) AS last, round(sum(abs(w)), 6) AS weight FROM w JOIN vectors USING (paper_id) GROUP BY user_id""", "interactions", "vectors")  # fmt: skip
def dwell_weighted_profile(spark, sf):
    """How long a user stayed changes the weights; the stay is the time to the user's next event."""
    found = evaluation.weighted_profile(evaluation.with_dwell(interactions(spark, sf)), vector_table(spark, sf), AS_OF)
    return found.select("user_id", F.round(F.col("profile")[0], 6).alias("first"), F.round(F.element_at("profile", -1), 6).alias("last"), F.round("weight", 6).alias("weight"))


@query("dwell", """
    WITH g AS (SELECT *, least((epoch_us(lead(timestamp) OVER u) - epoch_us(timestamp)) / 1e6::DOUBLE, 1800.0) AS gap, lead(id) OVER u AS after FROM interactions WINDOW u AS (PARTITION BY user_id ORDER BY timestamp, id))
    SELECT user_id, round(avg(gap), 6) AS dwell_seconds FROM g WHERE event_type = 'click' AND after IS NOT NULL GROUP BY user_id""", "interactions")  # fmt: skip
def dwell(spark, sf):
    return evaluation.dwell(interactions(spark, sf))


@query("novelty", f"SELECT query_id, count(*) FILTER (NOT EXISTS (FROM interactions i WHERE i.user_id = d.query_id AND i.paper_id = d.paper_id)) AS novel FROM ({_DENSE_SQL}) d WHERE rank <= 10 GROUP BY query_id", "vectors", "interactions")
def novelty(spark, sf):
    found = vectors.dense_topk(_query_vectors(spark, sf), vector_table(spark, sf), 10)
    return evaluation.novelty(found, interactions(spark, sf).select(F.col("user_id").alias("query_id"), "paper_id"))


_EPSILON_SQL = f"""
    WITH {_SCORED}, beyond AS (SELECT user_id, paper_id AS fresh, row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '|' || paper_id || '|0')) AS e FROM reranked WHERE rank > 20),
    slots AS (SELECT user_id, slot::INT AS slot, ('0x' || substr(md5(user_id || '|' || slot || '|0'), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.3 AS explored FROM (SELECT DISTINCT user_id FROM reranked), range(1, 21) t(slot)),
    counted AS (SELECT *, count(*) FILTER (explored) OVER (PARTITION BY user_id ORDER BY slot) AS e FROM slots),
    filled AS (SELECT c.user_id, slot, explored AND fresh IS NOT NULL AS explored, fresh, slot - count(*) FILTER (explored AND fresh IS NOT NULL) OVER (PARTITION BY c.user_id ORDER BY slot) AS x FROM counted c LEFT JOIN beyond b ON b.user_id = c.user_id AND b.e = c.e)
    SELECT f.user_id, slot, CASE WHEN explored THEN fresh ELSE r.paper_id END AS paper_id, explored FROM filled f LEFT JOIN reranked r ON r.user_id = f.user_id AND r.rank = f.x WHERE explored OR r.paper_id IS NOT NULL"""


@query("epsilon_greedy", _EPSILON_SQL, "vectors", "papers")
def epsilon_greedy(spark, sf):
    return ranking.epsilon_greedy(ranking.rerank(_featured(spark, sf)), 20, 0.3)


@query("epsilon_greedy_decayed", _EPSILON_SQL.replace("WITH ", "WITH served AS (SELECT user_id, count(*) AS lists FROM interactions WHERE event_type = 'view' GROUP BY user_id), ", 1)
    .replace("< 0.3 AS explored FROM (SELECT DISTINCT user_id FROM reranked)", "< greatest(0.05::DOUBLE, 0.3::DOUBLE * pow(0.999::DOUBLE, coalesce(lists, 0))) AS explored FROM (SELECT DISTINCT r.user_id, lists FROM reranked r LEFT JOIN served s ON s.user_id = r.user_id)"), "vectors", "papers", "interactions")
def epsilon_greedy_decayed(spark, sf):
    """Who was served more lists (here, who viewed more) explores less."""
    served = interactions(spark, sf).where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("lists"))
    ranked = ranking.rerank(_featured(spark, sf)).join(served, "user_id", "left")
    return ranking.epsilon_greedy(ranked, 20, ranking.decayed_epsilon(F.col("lists"), 0.3))


@query("learned_rerank")
def learned_rerank(spark, sf):
    featured = _featured(spark, sf)
    labels = read(spark, sf, "labels").groupBy(F.col("doc_id").alias("paper_id")).agg(F.max("quality").alias("label"))
    return ranking.learned_rerank(featured, featured.select("user_id", "paper_id").join(labels, "paper_id")).select("user_id", "paper_id", "rank")


@query("factorised")
def factorised(spark, sf):
    return ranking.factorised(evaluation.affinity(interactions(spark, sf)), 10)


@query("ndcg", f"""
    WITH {_SPARSE_SQL}, rel AS (SELECT query_id, doc_id AS paper_id, quality::DOUBLE AS gain FROM labels, (SELECT DISTINCT query_id FROM asked) WHERE doc_id % 40 = query_id % 40),
    best AS (SELECT query_id, sum(gain / log2(i + 1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, paper_id) AS i FROM rel QUALIFY i <= 10) GROUP BY query_id),
    got AS (SELECT query_id, sum(gain / log2(rank + 1)) AS got FROM sparse JOIN rel USING (query_id, paper_id) WHERE rank <= 10 GROUP BY query_id)
    SELECT query_id, round(CASE WHEN best > 0 THEN coalesce(got, 0) / best ELSE 0 END, 9) AS ndcg, coalesce(got, 0) > 0 AS hit FROM best LEFT JOIN got USING (query_id)""")  # fmt: skip
def ndcg(spark, sf):
    ranked = _sparse(spark, sf, 10)
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"), F.col("quality").cast("double").alias("gain"))
    return evaluation.ndcg(ranked, labels.join(asked, F.col("paper_id") % 40 == F.col("query_id") % 40).select("query_id", "paper_id", "gain"), 10)


@query("time_split", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN epoch_us(timestamp) <= (SELECT quantile_cont(epoch_us(timestamp)::DOUBLE, 0.8) FROM interactions) THEN 'train' ELSE 'test' END AS part FROM interactions) GROUP BY part", "interactions")
def time_split(spark, sf):
    return evaluation.time_split(interactions(spark, sf)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("citation_rerank", f"""WITH d AS (SELECT * FROM ({_DENSE_SQL}) WHERE rank <= 20),
    j AS (SELECT query_id, paper_id, score AS relevance, greatest(0.0, 1.0 - greatest(0, {AS_OF_MONTH} - ((2000 + substr(arxiv_id, 1, 2)::INT) * 12 + substr(arxiv_id, 3, 2)::INT)) / 120.0::DOUBLE) AS recency, ln(1 + citation_count) AS c FROM d JOIN papers USING (paper_id)),
    s AS (SELECT query_id, paper_id, round(0.7::DOUBLE * relevance + 0.25::DOUBLE * recency + 0.05::DOUBLE * CASE WHEN max(c) OVER q > 0 THEN c / max(c) OVER q ELSE 0 END, 12) AS score FROM j WINDOW q AS (PARTITION BY query_id))
    SELECT query_id, paper_id, score FROM s""", "vectors", "papers")  # fmt: skip
def citation_rerank(spark, sf):
    found = vectors.dense_topk(_query_vectors(spark, sf), vector_table(spark, sf), 20).join(papers(spark, sf), "paper_id")
    fused = found.select("query_id", "paper_id", F.col("score").alias("relevance"), scalars.id_recency(F.col("arxiv_id"), AS_OF_MONTH).alias("recency"), F.col("citation_count").alias("citations"))
    return evaluation.citation_rerank(fused).select("query_id", "paper_id", "score")


@query("category_entropy", f"""WITH {_NAMED}, c AS (SELECT query_id, category, count(*) AS n FROM ({_DENSE_SQL}) JOIN named USING (paper_id) WHERE rank <= 50 GROUP BY ALL),
    p AS (SELECT query_id, n / sum(n) OVER (PARTITION BY query_id) AS p FROM c) SELECT query_id, round(-sum(p * ln(p)) + 0.0, 6) AS entropy FROM p GROUP BY query_id""", "vectors", "papers")  # fmt: skip
def category_entropy(spark, sf):
    found = vectors.dense_topk(_query_vectors(spark, sf), vector_table(spark, sf), 50).join(named(spark, sf), "paper_id")
    return evaluation.category_entropy(found).withColumn("entropy", F.round("entropy", 6))


@query("window_counts", "SELECT date_trunc('day', timestamp) AS start, event_type, count(*) AS n FROM interactions GROUP BY ALL", "interactions")
def window_counts(spark, sf):
    return evaluation.window_counts(interactions(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sessions", """WITH f AS (SELECT *, coalesce(timestamp - lag(timestamp) OVER u > INTERVAL 60 MINUTE, true)::INT AS fresh FROM interactions WINDOW u AS (PARTITION BY user_id ORDER BY timestamp, id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY timestamp, id)::BIGINT AS session FROM f) SELECT user_id, session, min(timestamp) AS start, max(timestamp) AS "end", count(*) AS n FROM s GROUP BY user_id, session""", "interactions")  # fmt: skip
def sessions(spark, sf):
    return evaluation.sessions(interactions(spark, sf))


def _drained(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The result of a stream over all that its source holds, written by tasks to shared storage, a folder per batch.

    A batch that is written again replaces its own folder.  In complete mode the last batch is the result.
    """
    root = f"{shared_root(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"
    ids: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batches/number={number}")
        ids.append(number)

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if not ids:
        return spark.createDataFrame([], stream.schema)
    wanted = sorted(set(ids))[-1:] if mode == "complete" else sorted(set(ids))
    return spark.read.schema(stream.schema).parquet(*[f"{root}/batches/number={i}" for i in wanted])


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    batch = read(spark, sf, "events")
    raw = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'not_interested' WHEN 'signup' THEN 'onboarding' ELSE event_type END")
    return raw.select(F.col("event_id").alias("id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("paper_id"), kind.alias("event_type"), F.col("ts").alias("timestamp"))


@query("stream_window_counts", "SELECT date_trunc('day', timestamp) AS start, event_type, count(*) AS n FROM interactions GROUP BY ALL", "interactions")
def stream_windows(spark, sf):
    return _drained(spark, stream_window_counts(_event_stream(spark, sf)), "lumenfold_windows", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _newest(rows: DataFrame, version: str) -> DataFrame:
    """Of a user's rows from several triggers, the last."""
    rest = [c for c in rows.columns if c not in ("user_id", version)]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*rest), version).alias("r"), F.max(version).alias(version)).select("user_id", "r.*", version)


@query("stream_distinct", "SELECT id, user_id, paper_id, event_type FROM interactions", "interactions")
def stream_distinct_events(spark, sf):
    """Every event comes twice, as from a sender that repeats itself."""
    twice = _event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return _drained(spark, stream_distinct(twice), "lumenfold_distinct", "append").select("id", "user_id", "paper_id", "event_type")


for _kind, _event in (("long_term", "save"), ("short_term", "save"), ("negative", "not_interested")):

    @query(f"stream_profile_{_kind}", _ewma_sql(_event, state.ALPHA[_kind]), "interactions", "vectors", recursive=True)
    def stream_profiles(spark, sf, kind=_kind):
        rows = _newest(_drained(spark, stream_profile(_event_stream(spark, sf), vector_table(spark, sf), kind), "lumenfold_profile", "update"), "n")
        return rows.select("user_id", "n", F.round(F.col("profile")[0], 6).alias("first"), F.round(F.element_at("profile", -1), 6).alias("last"))


@query("stream_user_state", ORACLE["user_state"])
def stream_state(spark, sf):
    rows = _newest(_drained(spark, stream_user_state(_event_stream(spark, sf)), "lumenfold_state", "update"), "seen")
    return rows.select("user_id", joined(F.col("positives")).alias("positives"), joined(F.col("negatives")).alias("negatives"))
