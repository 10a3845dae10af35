"""The registered queries of this subpackage, one per operator over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, conversations, ctph, forest, hardneg, langid, licenses, mixing, packing, pii, sharding, topk, urlfilter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return register


_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)))"""
_UTF8 = """flatten(list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: CASE
    WHEN unicode(c) < 128 THEN [unicode(c)]
    WHEN unicode(c) < 2048 THEN [192 + unicode(c) // 64, 128 + unicode(c) % 64]
    WHEN unicode(c) < 65536 THEN [224 + unicode(c) // 4096, 128 + unicode(c) // 64 % 64, 128 + unicode(c) % 64]
    ELSE [240 + unicode(c) // 262144, 128 + unicode(c) // 4096 % 64, 128 + unicode(c) // 64 % 64, 128 + unicode(c) % 64] END))"""


@query(
    "op1_mix_sources",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             sha256('mix|' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    ranked AS (
      SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM sizes),
    swept AS (
      SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "left",
             (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open, row_number() OVER o AS step
      FROM ranked WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank)),
    levelled AS (
      SELECT *, min(CASE WHEN cap * open >= weight * "left" THEN step END) OVER () AS stop,
             arg_min("left", step) FILTER (cap * open >= weight * "left") OVER () AS l,
             arg_min(open, step) FILTER (cap * open >= weight * "left") OVER () AS o FROM swept),
    targets AS (
      SELECT source, source_size, CASE WHEN stop IS NULL OR step < stop THEN cap::DOUBLE ELSE (weight * l)::DOUBLE / o::DOUBLE END AS target FROM levelled),
    rates AS (
      SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
    drawn AS (
      SELECT s.*, r.source_size, r.target, r.whole, r.rate - r.whole AS fraction,
             list_transform(range(8), lambda j: ('0x' || substr(digest, (1 + 8 * j)::INT, 8))::BIGINT::DOUBLE / 4294967296.0) AS draws
      FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
    tried AS (
      SELECT source, j, abs(min(whole) * min(source_size) + sum(CASE WHEN draws[j + 1] < fraction THEN size ELSE 0 END) - min(target)) AS off
      FROM drawn, range(8) t(j) GROUP BY source, j),
    picks AS (SELECT source, arg_min(j, (off, j)) AS pick FROM tried GROUP BY source)
    SELECT doc_id, size, source_size, target, (whole + (draws[pick + 1] < fraction)::BIGINT) * size AS taken
    FROM drawn d JOIN picks p ON d.source IS NOT DISTINCT FROM p.source""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(table(spark, sf_dir, "documents")).drop("copies")


def _jump_sql(shards: int) -> str:
    return f"""SELECT digest, max(b) AS shard FROM walk{shards} GROUP BY digest"""


def _walk_sql(shards: int) -> str:
    return f"""walk{shards}(digest, key, b, j) AS (
      SELECT DISTINCT digest, ('0x' || substr(digest, 1, 8))::BIGINT::HUGEINT * 4294967296 + ('0x' || substr(digest, 9, 8))::BIGINT, -1::BIGINT, 0::BIGINT FROM rows_
      UNION ALL
      SELECT digest, next, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((next // 8589934592)::BIGINT + 1)::DOUBLE))::BIGINT
      FROM (SELECT digest, (key * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS next, j FROM walk{shards} WHERE j < {shards}))"""


@query(
    "op10_shard_documents",
    f"""
    WITH RECURSIVE {_CRC_TABLE},
    rows_ AS (
      SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 8 AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest,
             xor(list_reduce(list_concat([4294967295::BIGINT], {_UTF8}),
                 lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
      FROM documents, crc_table),
    {_walk_sql(24)}, {_walk_sql(25)}
    SELECT doc_id, size, text_crc32, 'key' AS law, a.shard::INT AS shard,
           row_number() OVER (PARTITION BY a.shard ORDER BY ('0x' || substr(r.digest, 1, 8))::BIGINT * 128 // 4294967296,
               text_crc32 // 1073741824, r.digest, doc_id, text_crc32, size) - 1 AS slot,
           b.shard::INT AS grown_shard
    FROM rows_ r JOIN ({_jump_sql(24)}) a USING (digest) JOIN ({_jump_sql(25)}) b USING (digest)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op2_pseudonymise")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


@query("op8_identify_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = langid.identify(docs.select("doc_id", "text"), langid.fit_language_model(docs))
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op9_pack_documents")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op4_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op6_fingerprint")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op7_extract_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract_main_text(table(spark, sf_dir, "pages"))


@query("op3_scan_licenses")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query(
    "op11_filter_urls",
    rf"""
    WITH parts AS (
      SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split AS (
      SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    named AS (
      SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), '\.?(:(80|443)?)?\z', ''), '^(www|m)\.', '') AS name,
             list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                                   lambda p: p <> '' AND NOT regexp_matches(p, '{urlfilter.TRACKING}'))) AS asked FROM split),
    spelt AS (
      SELECT *, CASE WHEN name <> '' THEN name || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/\z', '')
                       || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical FROM named),
    listed AS (SELECT DISTINCT canonical FROM spelt WHERE regexp_matches(host, '{urlfilter.UNWANTED_HOST}') AND canonical IS NOT NULL),
    rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in urlfilter.RULES)}),
    fitting AS (
      SELECT host, path, arg_max((rule_host || rule_path, rule_verdict), length(rule_host || rule_path)) AS r
      FROM (SELECT DISTINCT host, path FROM spelt) p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY host, path)
    SELECT page_id, s.host, s.path, r[1] AS rule, coalesce(r[2], CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
           s.canonical, l.canonical IS NOT NULL AS listed
    FROM spelt s LEFT JOIN fitting f ON s.host = f.host AND s.path = f.path LEFT JOIN listed l ON s.canonical = l.canonical""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, urlfilter.unwanted_urls(pages), urlfilter.RULES)


@query(
    "op12_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
    positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
           n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
    QUALIFY rank <= 10""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(hardneg.relabelled(table(spark, sf_dir, "embeddings")))


@query("op13_repair_conversations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(table(spark, sf_dir, "conversations")))
