"""Document fingerprints by context-triggered piecewise hashing, and their likeness by edit distance.

A rolling hash of the last seven bytes ends a chunk wherever its low bits are all ones; each chunk gives one character.
The number of bits (the level) follows from the text's length alone, so that a signature has 32 to 64 characters as a
rule, and a fingerprint holds the signatures of two neighbouring levels: ``level:signature:signature``.  Texts whose
lengths differ by up to a factor of two thus always have a level in common.  Where repetitive text has no end for long, chunks end on a fixed grid instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .shingles import _BASE, _BASE_INVERSE, _power_table, mix

WINDOW = 7
CHARACTERS = 64
#: Chunks of so many expected lengths are cut on the grid.
LONG_CHUNK = 8
#: Shortest run that two signatures must share to be alike at all; shorter for signatures of few characters.
COMMON, COMMON_SHORT, SHORT = 4, 2, 12
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PIECE = 1 << 22


def _marks(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of chunks (exclusive) and grid points; for each, up to which level it is an end (-1: on the grid alone); sums.

    The text's end is an end at all levels.
    """
    ends, levels, sums, total, scale = [], [], [], np.uint64(0), np.uint64(1)
    grid = LONG_CHUNK << bits
    for at in range(0, len(data), _PIECE):
        raw = np.frombuffer(data[max(0, at - WINDOW + 1) : at + _PIECE], dtype=np.uint8).astype(np.uint32) + np.uint32(1)
        lead = min(at, WINDOW - 1)
        rolled = np.zeros(len(raw) - lead, dtype=np.uint32)
        for back in range(WINDOW):
            part = raw[max(0, lead - back) : len(raw) - back]
            rolled[len(rolled) - len(part) :] += part * np.uint32(pow(0x01000193, back, 1 << 32))
        rolled = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        rolled ^= rolled >> np.uint32(13)
        low = np.uint32((1 << bits) - 1)
        hit = (rolled & low) == low
        at_grid = np.arange(-at % grid, len(rolled) + 1, grid) - 1
        points = np.union1d(np.flatnonzero(hit), at_grid[at_grid >= 0])
        own = np.cumsum(raw[lead:].astype(np.uint64) * _power_table("up", _BASE, len(rolled))) * scale + total
        ends.append(points + at + 1)
        levels.append(np.where(hit[points], bits + ((rolled[points] >> np.uint32(bits)) & np.uint32(1)).astype(int), -1))
        sums.append(own[points])
        total, scale = own[-1], np.uint64(int(scale) * pow(int(_BASE), len(rolled), 1 << 64) % (1 << 64))
    return np.append(np.concatenate(ends), len(data)), np.append(np.concatenate(levels), bits + 1), np.append(np.concatenate(sums), total)


def _spaced(ends: np.ndarray, least: int) -> np.ndarray:
    """Positions of ends that are at least so far from the one before; only repetitive texts have others."""
    if len(ends) < 2 or np.diff(ends, prepend=0).min() >= least:
        return np.arange(len(ends))
    kept, at = [], 0
    while (i := int(np.searchsorted(ends, at + least))) < len(ends):
        kept.append(i)
        at = int(ends[i])
    if not kept or kept[-1] != len(ends) - 1:
        kept.append(len(ends) - 1)
    return np.array(kept)


def _signature(ends: np.ndarray, levels: np.ndarray, sums: np.ndarray, bits: int) -> str:
    real, grid = levels >= bits, LONG_CHUNK << bits
    known = np.concatenate([[0], ends[real]])
    gap = np.diff(known)[np.minimum(np.searchsorted(known, ends), len(known) - 1) - 1]
    use = real | ((ends % grid == 0) & (gap > grid))
    ends, sums = ends[use], sums[use]
    own = _spaced(ends, max(1, (1 << bits) >> 3))
    ends, sums = ends[own], sums[own]
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends, sums = ends[:-1], sums[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    chunk = np.diff(sums, prepend=np.uint64(0))
    if len(starts) and starts[-1] < _PIECE:
        down = _power_table("down", _BASE_INVERSE, int(starts[-1]) + 1)[starts]
    else:
        down = np.array([pow(int(_BASE_INVERSE), int(s), 1 << 64) for s in starts], dtype=np.uint64)
    return "".join(_ALPHABET[i] for i in (mix(chunk * down) & np.uint64(63)).tolist())


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return "0::"
    bits = max(2, (max(1, len(data) // CHARACTERS) - 1).bit_length())
    marks = _marks(data, bits)
    return f"{bits}:{_signature(*marks, bits)}:{_signature(*marks, bits + 1)}"


def longest_common_subsequence(a: str, b: str) -> int:
    """By bits: one integer holds a row of the table."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    shorter = min(len(a), len(b))
    n = min(COMMON_SHORT if shorter <= SHORT else COMMON, shorter)
    if not n or {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
        return 0.0
    return 2 * longest_common_subsequence(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1: one less the edit distance (insertions and deletions) over both lengths, best of the levels in common."""
    if one == other:
        return 1.0
    (p, *a), (q, *b) = one.split(":"), other.split(":")
    by_level = dict(zip((int(q), int(q) + 1), b, strict=True))
    return max((_alike(s, by_level[i]) for i, s in zip((int(p), int(p) + 1), a, strict=True) if i in by_level), default=0.0)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a ``fingerprint`` column; a null text is fingerprinted as the empty one."""
    kept = [c for c in docs.columns if c != "fingerprint"]

    def add(batches):
        for batch in batches:
            yield batch.assign(fingerprint=[fingerprint(t if isinstance(t, str) else None) for t in batch[text]])

    return docs.select(*kept).mapInPandas(add, docs.select(*kept).schema.add("fingerprint", "string"))


#: What is known of a row beside the one after it.
#: Keys are text there: as numbers a batch with a null would round them.
_PAIRS = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: First characters that order rows under one key, before a hash of the whole text does.
_LEADING = 64
#: Ranges for each of the session's shuffle partitions, as texts differ in length.
_RANGES = 3


def _beside(key: str | None, own: str, mark: str, after: str, after_mark: str) -> tuple:
    """A row of ``_PAIRS`` for a text and the one after it."""
    n = len(own)
    edited = own[: n - n // 2] + after[: n // 2]
    edited_mark = fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return key, n, digest, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after_mark)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document in
    ascending key order; after the last comes the first.  Nulls: a null text is empty; null keys come last.  Rows that
    share a key follow one another in order of their first characters, then of a hash of the text; equal rows are next
    to each other.  A single row is its own next.  An empty table gives none.  ``docs`` should be a stored table: equal
    rows are told apart by where they are read.

    Rows are sorted in ranges of that order, so a key or even a row that is repeated very often fills many ranges.
    Texts are exchanged once; a task streams through its range holding two of them, and hands on its first and last
    text, which meet those of the ranges beside it in a join of one row per range.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = {"leading": F.left("text", F.lit(_LEADING)), "hash": F.xxhash64("text"), "read_at": F.monotonically_increasing_id()}
    order = [F.col("doc_id").asc_nulls_last(), *place]
    parts = _RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumns(place).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    edges = f"{_PAIRS}, part int, edge string, text string"

    def compare(batches):
        part, last, opened = TaskContext.get().partitionId(), None, False  # last: the row that waits for its next
        for batch in batches:
            out = []
            for doc, own in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                mark = fingerprint(own)
                if last is not None:
                    out.append((*_beside(*last, own, mark), part, None, None))
                elif not opened:
                    out.append((doc, None, None, mark, None, None, None, part, "first", own))
                last, opened = (doc, own, mark), True
            yield _frame(out, edges)
        if last is not None:
            doc, own, mark = last
            yield _frame([(doc, None, None, mark, None, None, None, part, "last", own)], edges)

    def join_up(batches):
        for batch in batches:
            columns = zip(*(batch[c].tolist() for c in ("doc_id", "text", "fingerprint", "after", "after_fingerprint")), strict=True)
            yield _frame([_beside(*row) for row in columns], _PAIRS)

    found = staged(ordered.mapInPandas(compare, edges), "ctph-ranges")
    used = sorted(r["part"] for r in found.where("edge = 'first'").select("part").collect())
    done = found.where("edge IS NULL").select(*[c.split()[0] for c in _PAIRS.split(", ")])
    named = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("long"))
    if not used:
        return named(done)
    following = rows.sparkSession.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, next int")
    firsts = found.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fingerprint").alias("after_fingerprint"))
    lasts = found.where("edge = 'last'").select("part", "doc_id", "text", "fingerprint")
    # A row per range; the texts of ranges' edges may be long, so only the range numbers are broadcast.
    meeting = lasts.join(F.broadcast(following), "part").hint("shuffle_merge").join(firsts, "next")
    return named(done.union(meeting.select("doc_id", "text", "fingerprint", "after", "after_fingerprint").mapInPandas(join_up, _PAIRS)))
