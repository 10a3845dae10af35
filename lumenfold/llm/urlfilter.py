"""URL filtering: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

A listed URL sets one bit in each of the eight words of one block of the filter.  A page's canonical URL looks at its own
block only; the few that may be listed go on to an exact join with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, staged

#: Words of 64 bits in a block, and bits of the filter for each listed URL.
WORDS, BITS_PER_URL = 8, 16
#: Blocks at most (80 bytes each with their number): with longer lists more URLs pass on to the exact join, none is lost.
MAX_BLOCKS = 1 << 18
#: Parts into which the rows of one listed URL are dealt if the listed URLs met are too many to broadcast.
SALTS = 32
# Parameters that name a visit, not a page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|igshid|ref|referrer)(=|\z)"
# Words of a host's name that put its pages on the list of the registered query.
UNWANTED_HOST = r"(^|[.-])(ads|adserver|bet|bets|betting|casino|escort|farm-links|pills|poker|porn|spam|viagra|xxx)([.-]|\z)"
# The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """The part after ``://`` up to a slash, question mark, hash or the end, with A to Z lower-cased; empty for null."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """The part after the host up to a question mark, hash or the end; empty for null."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling for the addresses of a page; null without a host.

    Scheme, user, default ports, a leading ``www.`` or ``m.``, repeated and final slashes, the fragment and tracking
    parameters go; the other parameters are sorted.
    """
    name = F.regexp_replace(F.regexp_replace(host(url), r"^[^@]*@", ""), r"\.?(:(80|443)?)?\z", "")
    name = F.regexp_replace(name, r"^(www|m)\.", "")
    folder = F.regexp_replace(F.regexp_replace(path(url), r"/+", "/"), r"/\z", "")
    asked = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(name != "", F.concat(name, folder, query))


def fitting_rule(rules: list[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest of the few ``rules`` (host, path, verdict) that fits ``host`` and ``path``; else null.

    A rule fits its host and all subdomains, if the path starts with the rule's.  Of equally long ones that with the longer
    host wins, then the first in order of text.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), [-ord(c) for c in r[0] + r[1]])):
        own = (F.col("host") == rule[0]) | F.endswith(F.col("host"), F.lit("." + rule[0]))
        found = F.when(own & F.startswith(F.col("path"), F.lit(rule[1])), F.lit(value(rule))).otherwise(found)
    return found


def _masks(name: Column) -> list[Column]:
    """The bit of each word of a URL's block: six bits of a hash each."""
    h = F.xxhash64(name, F.lit("bits"))
    place = lambda i: F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), place(i)) for i in range(WORDS)]


def _block(name: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(blocks))


def bloom_filter(listed: DataFrame) -> tuple[DataFrame, int]:
    """(``block`` and its ``words``, number of blocks) of the distinct ``canonical`` URLs; blocks without a URL have no row."""
    blocks = min(MAX_BLOCKS, max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS))))
    bits = listed.select(_block(F.col("canonical"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("canonical")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possibly_listed(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (with ``canonical``) and ``possible``: false for those that are surely not listed."""
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col("canonical"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    looked = rows.withColumn("block", _block(F.col("canonical"), blocks)).join(F.broadcast(bloom), "block", "left")
    return looked.select(*rows.columns, (F.col("canonical").isNotNull() & F.coalesce(hit, F.lit(False))).alias("possible"))


def _is_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` and ``listed``: possible hits are joined with the list itself, each URL once, and the result with the rows."""
    bloom, blocks = bloom_filter(listed)
    rows = possibly_listed(rows, bloom, blocks)
    met = staged(rows.where("possible").select("canonical").distinct().join(listed, "canonical", "left_semi"), "listed-met")
    met = met.withColumn("listed", F.lit(True))
    flag = F.coalesce("listed", F.lit(False)).alias("listed")
    columns = [c for c in rows.columns if c != "possible"]
    marked = small(met)
    if marked is not met:
        return rows.join(marked, "canonical", "left").select(*columns, flag)
    dealt = rows.where("possible").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    met = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    found = dealt.join(met, ["canonical", "salt"], "left").select(*columns, flag)
    return found.union(rows.where("NOT possible").select(*columns, F.lit(False)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", carry: bool = False) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, ``canonical``, ``listed`` of every row of ``pages``.

    ``listed`` has canonical URLs in ``canonical`` (nulls and repeated ones count for nothing).  The verdict is that of the
    longest fitting rule, else block for listed URLs and allow for the others.  Null URLs and those without ``://`` have an
    empty host and path, fit no rule and are allowed; an empty list blocks nothing; URLs of any length are looked at whole;
    repeated rows are judged alike, each for itself; rows without a key are judged too; an empty table gives no rows.  Other
    columns are left out whatever their names; with ``carry`` they come back packed in ``row``.
    """
    listed = staged(listed.select("canonical").where("canonical IS NOT NULL").distinct(), "listed-urls")
    extra = [F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")] if carry else []
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), *extra)
    rows = rows.select("key", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"), *(["row"] if carry else []))
    judged = _is_listed(rows, listed).withColumn("rule", fitting_rule(rules, lambda r: r[0] + r[1]))
    verdict = F.coalesce(fitting_rule(rules, lambda r: r[2]), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "canonical", "listed", *(["row"] if carry else []))


def allowed_pages(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with all their columns."""
    judged = judge_urls(pages, listed, rules, url, url, carry=True)
    return judged.where("verdict = 'allow'").select(*[F.col("row").getField(c).alias(c) for c in pages.columns])


def unwanted_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """``canonical`` URLs of the pages whose host's name has an unwanted word: the list of the registered query."""
    return pages.where(host(F.col(url)).rlike(UNWANTED_HOST)).select(canonical(F.col(url)).alias("canonical"))
