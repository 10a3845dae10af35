"""Jump consistent hashing of stable keys to shards, without a ring table.

The published algorithm keeps a 64-bit linear congruential state per key and jumps ahead through the shard numbers;
appending a shard moves only the rows that land in it.  Spark's long arithmetic rejects overflow, so the state is held
as two 32-bit limbs and every product stays below 2**49.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, hex_number

#: Multiplier of the jump hash's congruential generator (fixed by the published algorithm), as 32-bit limbs.
_HIGH, _LOW = divmod(2862933555777941757, 1 << 32)
_MASK = (1 << 32) - 1
#: Steps taken before the check whether any row needs more; about ln(shards) jumps are expected.
_FIRST_STEPS = 40
#: Copies of a row that are spread out again in one task.
_COPIES = 4096


def _times(x: str, constant: int) -> str:
    """SQL: x * constant modulo 2**32, for 32-bit x."""
    return f"((({x} & 65535) * {constant}L + shiftleft((shiftright({x}, 16) * {constant}L) & 65535L, 16)) & {_MASK}L)"


_SUM = f"((s.lo & 65535) * {_LOW}L + shiftleft((shiftright(s.lo, 16) * {_LOW}L) & 65535L, 16) + 1L)"
_NEXT_LOW = f"({_SUM} & {_MASK}L)"
_NEXT_HIGH = (
    f"((shiftright({_SUM}, 32) + shiftright(shiftright(s.lo, 16) * {_LOW}L, 16)"
    f" + {_times('s.hi', _LOW)} + {_times('s.lo', _HIGH)}) & {_MASK}L)"
)


def _jumps(state: str, steps: str, shards: int) -> str:
    return f"""aggregate({steps}, {state}, (s, i) -> if(s.j >= {shards}L, s, named_struct(
        'hi', {_NEXT_HIGH}, 'lo', {_NEXT_LOW}, 'b', s.j,
        'j', cast(floor(cast(s.j + 1 as double) * (2147483648.0D / cast(shiftright({_NEXT_HIGH}, 1) + 1 as double))) as bigint))))"""


def jump_shard(high: str, low: str, shards: int) -> Column:
    """The shard (0 to shards-1) of the key whose 64-bit hash has the given 32-bit limbs (column names)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    begin = f"named_struct('hi', {high}, 'lo', {low}, 'b', -1L, 'j', 0L)"
    first = _jumps(begin, f"sequence(1, {min(shards, _FIRST_STEPS)})", shards)
    if shards <= _FIRST_STEPS:
        return F.expr(f"cast(({first}).b as int)")
    rest = _jumps("r", f"sequence(1, {shards})", shards)
    return F.expr(f"cast(element_at(transform(array({first}), r -> if(r.j >= {shards}L, r.b, ({rest}).b)), 1) as int)")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", blocks: int = 128) -> DataFrame:
    """Place every row in a shard by its key alone, and number the rows of each shard without gaps.

    Returns ``doc_id`` (the key), ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``law`` ('key': key and
    shard count decide), ``shard``, ``slot`` and ``grown_shard`` (the shard if one more were there).

    Slots follow the key's digest within a shard.  A shard is numbered in ``blocks`` ranges of the digest (each again
    in four by text), whose counts then give each range its first slot; so no task ever holds a whole shard.  Equal
    rows are counted before the exchange and spread out again after it, so a key that holds a third of all rows is
    one row there; its copies are spread out in parts that are dealt over the tasks.

    Null key: the empty key.  Null text: no bytes (size 8, checksum 0).  Repeated rows get slots of their own.  An
    empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    distinct = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = (
        distinct.withColumn("digest", F.md5(as_text("doc_id")))
        .withColumns({"high": hex_number(F.col("digest"), 1, 8), "low": hex_number(F.col("digest"), 9, 8)})
        .withColumns(
            {
                "shard": jump_shard("high", "low", shards),
                "block": F.expr(f"cast(shiftright(high * {blocks}L, 32) as int)"),
                "part": F.expr("cast(shiftright(text_crc32, 30) as int)"),
            }
        )
    )
    place = ["shard", "block", "part"]
    in_block = W.partitionBy(*place).orderBy("digest", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    in_shard = W.partitionBy("shard").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)
    first = (
        placed.groupBy(*place)
        .agg(F.sum("copies").alias("n"))
        .select(*place, F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("first_slot"))
    )
    numbered = placed.withColumn("before", F.coalesce(F.sum("copies").over(in_block), F.lit(0))).join(first, place)
    ready = numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("before")).alias("from"),
        (F.col("first_slot") + F.col("before") + F.col("copies") - 1).alias("to"),
        jump_shard("high", "low", shards + 1).alias("grown_shard"),
    )
    # One part for nearly every row; the exchange of these narrow rows is what spreads the parts of a hot one.
    parts = ready.withColumn("from", F.explode(F.expr(f"sequence(`from`, `to`, {_COPIES}L)"))).repartition("shard", "from")
    slots = F.explode(F.expr(f"sequence(`from`, least(`to`, `from` + {_COPIES - 1}L))")).alias("slot")
    return parts.select("doc_id", "size", "text_crc32", "law", "shard", slots, "grown_shard")
