"""Repair of conversation structure: the cheapest edits that make roles follow ``(system? (user assistant)+)?``.

A forward Viterbi pass over a conversation's turns keeps, for each of four grammar states, the least (cost, audit string);
every turn's layer is closed by at most two inserts.  Layers compose, so a conversation too long for a task is cut into
stretches, each of which gives the least (cost, audit) from every state to every state; the stretches meet in order.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, small, staged

#: Conversations with more rows, or characters, are repaired in stretches by several tasks.
LONG_ROWS, LONG_CHARS = 1024, 4 << 20
#: Turns whose layers are composed at once.
STRETCH = 256
#: Rows in a batch handed to Python.
BATCH_ROWS = 4096
# Costs of edits, and white space.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
# States: nothing yet, after system, after user, after assistant; the first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = {"su", "ua", "au"}
#: What a row may have wrong.
_FAULTS = ("blank", "duplicate", "truncated")
_SUMMARY = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_REPORT = f"{_SUMMARY}, repaired array<struct<role: string, text: string>>"


def _next(state: int) -> int:
    """Where an inserted or reroled turn leads."""
    return ASSISTANT if state == USER else USER


def _role(state: int) -> str:
    return "assistant" if state == ASSISTANT else "user"


def close(layer: dict) -> dict:
    """``layer`` (state to cost and audit) with what up to two inserts reach from it."""
    for _ in range(2):
        grown = dict(layer)
        for state, (cost, audit) in layer.items():
            at, reached = _next(state), (cost + INSERT, audit + "I")
            if at not in grown or reached < grown[at]:
                grown[at] = reached
        layer = grown
    return layer


@lru_cache(maxsize=256)
def _edits(state: int, initial: str, fault: str) -> list:
    """(next state, cost, letter) of the edits of a row that has a role's ``initial`` and a ``fault``, or an empty one."""
    edits = [(state, DELETE, "D")]
    if fault not in ("blank", "duplicate"):
        cut = CUT if fault == "truncated" else 0
        edits.append((_next(state), REROLE + cut, "R"))
        if (state, initial) in _KEPT:
            edits.append((_KEPT[state, initial], cut, "K"))
    return edits


def advance(layer: dict, initial: str, fault: str) -> dict:
    """The closed layer after one more row."""
    out: dict = {}
    for state, (cost, audit) in layer.items():
        for at, more, letter in _edits(state, initial, fault):
            reached = (cost + more, audit + letter)
            if at not in out or reached < out[at]:
                out[at] = reached
    return close(out)


def stretch(turns: list) -> dict:
    """(from state, to state) to the least (cost, audit) over ``turns``, pairs of initial and fault."""
    out = {}
    for state in range(4):
        layer = reduce(lambda held, turn: advance(held, *turn), turns, {state: (0, "")})
        out |= {(state, at): best for at, best in layer.items()}
    return out


def compose(a: dict, b: dict) -> dict:
    out: dict = {}
    for (start, middle), (cost, audit) in a.items():
        for (entry, end), (more, rest) in b.items():
            if entry == middle:
                reached = (cost + more, audit + rest)
                if (start, end) not in out or reached < out[start, end]:
                    out[start, end] = reached
    return out


def compose_all(parts: list) -> dict:
    """The stretches composed by neighbours, so that audits are copied a few times only."""
    while len(parts) > 1:
        parts = [compose(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def cheapest(turns: list) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of equally cheap ones that with the least audit."""
    layer = reduce(lambda held, turn: advance(held, *turn), turns, close({START: (0, "")}))
    return min(layer[s] for s in (START, ASSISTANT) if s in layer)


class Replay:
    """Applies an audit to the rows it was made for, one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> list:
        """The turns inserted before the next row."""
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.state = _next(self.state)
            self.at += 1
            out.append((_role(self.state), ""))
        return out

    def row(self, role: str, text: str) -> list:
        out, letter = self.inserted(), self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEPT[self.state, role[:1]]
            out.append((role, text))
        elif letter == "R":
            self.state = _next(self.state)
            out.append((_role(self.state), text))
        return out


def damaged(table: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``present`` of the registered query's rows, by a checksum of conversation and turn.

    Nulls in the checksum, roles and texts are one space.  A dropped row stays with ``present`` false, to name its conversation.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = table.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


def _prepared(table: DataFrame) -> DataFrame:
    """The rows in the form that tasks take them: the key as text, so that no batch with a null rounds it."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    present = F.coalesce("present", F.lit(True)) if "present" in table.columns else F.lit(True)
    rows = table.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), present.alias("present"))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", "blank").when(last.isin(".", "!", "?"), "").otherwise("truncated")
    return rows.withColumns({"initial": F.substring("role", 1, 1), "fault": fault, "head": F.substring("text", 1, 64), "digest": F.md5("text")})


#: The order of a conversation's rows; those of one turn by role and text (its first characters, then its digest).
_ORDER = ["conv", "turn", "role", "head", "digest"]


def _report_of(conv, rows: list) -> dict:
    """The report of a conversation whose rows (role, text, initial, fault) all are at hand."""
    seen: set = set()
    turns = []
    for role, text, initial, fault in rows:
        if fault != "blank":
            fault = "duplicate" if (role, text) in seen else fault
            seen.add((role, text))
        turns.append((initial, fault))
    cost, audit = cheapest(turns)
    replay = Replay(audit)
    repaired = [r for role, text, *_ in rows for r in replay.row(role, text)] + replay.inserted()
    illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(turns, turns[1:], strict=False))
    counts = {f: sum(t[1] == f for t in turns) for f in _FAULTS}
    return {"conv": conv, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired": repaired}


def _whole(batches):
    """Reports of the conversations that follow one another in sorted rows."""
    conv, rows, done = None, None, []
    for batch in batches:
        for key, role, text, initial, fault, present in zip(*(batch[c].tolist() for c in ("conv", "role", "text", "initial", "fault", "present")), strict=True):
            if rows is None or key != conv:
                if rows is not None:
                    done.append(_report_of(conv, rows))
                conv, rows = key, []
            if present:
                rows.append((role, text, initial, fault))
        if done:
            yield pd.DataFrame(done)
            done = []
    if rows is not None:
        yield pd.DataFrame([_report_of(conv, rows)])


_STRETCHES = "conv string, part int, blank long, duplicate long, truncated long, illegal long, first string, last string, steps array<int>, costs array<long>, audits array<string>"


def _stretches(batches):
    """One row for each conversation in a sorted partition: its faults, its ends and its composed layers."""
    part, held = TaskContext.get().partitionId(), None

    def flush(pending: list):
        if held["turns"]:
            held["parts"].append(stretch(held["turns"]))
            held["turns"] = []
        if pending is not None and held["parts"]:
            best = compose_all(held["parts"])
            counts = {c: held[c] for c in (*_FAULTS, "illegal", "first", "last")}
            pending.append({"conv": held["conv"], "part": part, **counts, "steps": [s * 4 + e for s, e in best], "costs": [c for c, _ in best.values()], "audits": [a for _, a in best.values()]})

    for batch in batches:
        done: list = []
        for conv, initial, fault in zip(*(batch[c].tolist() for c in ("conv", "initial", "fault")), strict=True):
            if held is None or conv != held["conv"]:
                if held is not None:
                    flush(done)
                held = {"conv": conv, "turns": [], "parts": [], "illegal": 0, "first": initial, "last": None, **dict.fromkeys(_FAULTS, 0)}
            if held["last"] is not None:
                held["illegal"] += held["last"] + initial not in _LEGAL
            held["last"] = initial
            if fault:
                held[fault] += 1
            held["turns"].append((initial, fault))
            if len(held["turns"]) == STRETCH:
                flush(None)
        if done:
            yield pd.DataFrame(done)
    if held is not None:
        done = []
        flush(done)
        yield pd.DataFrame(done)


def _joined(own: pd.DataFrame) -> pd.DataFrame:
    """The report of one conversation from its stretches, a row for each partition at most."""
    own = own.sort_values("part")
    parts = [{divmod(int(s), 4): (int(c), a) for s, c, a in zip(r.steps, r.costs, r.audits, strict=True)} for r in own.itertuples()]
    first = {(START, s): best for s, best in close({START: (0, "")}).items()}
    best = compose(first, compose_all(parts))
    cost, audit = min(best[START, s] for s in (START, ASSISTANT) if (START, s) in best)
    seams = sum(a + b not in _LEGAL for a, b in zip(own["last"], own["first"].iloc[1:], strict=False))
    return pd.DataFrame([{"conv": own["conv"].iloc[0], **{f: own[f].sum() for f in _FAULTS}, "illegal": own["illegal"].sum() + seams, "cost": cost, "audit": audit}])


def _replayed(batches):
    """Repaired rows of conversations whose audit comes before their rows; one row at a time, however long they are."""
    conv, replay, place = None, None, 0

    def tell(turns: list, out: list):
        nonlocal place
        for role, text in turns:
            out.append((conv, place, role, text))
            place += 1

    frame = lambda out: pd.DataFrame(out, columns=["conv", "place", "role", "text"])
    for batch in batches:
        out: list = []
        for key, audit, role, text in zip(*(batch[c].tolist() for c in ("conv", "audit", "role", "text")), strict=True):
            if isinstance(audit, str):
                if replay is not None:
                    tell(replay.inserted(), out)
                conv, replay, place = key, Replay(audit), 0
            else:
                tell(replay.row(role, text), out)
        yield frame(out)
    if replay is not None:
        out = []
        tell(replay.inserted(), out)
        yield frame(out)


def _digests(batches):
    """``conv`` and the digest of its rows' text, read one after another."""
    import hashlib

    conv, held = None, None
    for batch in batches:
        done = []
        for key, place, role, text in zip(*(batch[c].tolist() for c in ("conv", "place", "role", "text")), strict=True):
            if place == 0:
                done += [] if held is None else [(conv, held.hexdigest())]
                conv, held = key, hashlib.sha256()
            held.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
        yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
    yield pd.DataFrame([] if held is None else [(conv, held.hexdigest())], columns=["conv", "repaired_sha256"])


def _same(a: DataFrame, b: DataFrame):
    return a["conv"].eqNullSafe(b["conv"])


class Repair:
    """The repair of a table of conversations.

    ``table`` has ``conv_id``, ``turn``, ``role``, ``text`` and may have ``present`` (false: the row only names its conversation); other
    columns are left out.  Null roles and texts are one space, an empty role fits nowhere; rows without a conversation are one; turns are taken in
    order, nulls first, those of one turn by role and text (its first 64 characters, then its MD5).  Repeated rows are
    duplicates of the first.  An empty table has no conversations; one without present rows is reported with zeros and an
    empty audit.  Texts are looked at whole.

    ``summary``: one row per conversation: faults, cost, audit.  ``rows``: the repaired turns.  Conversations with more than
    ``long_rows`` rows or ``long_chars`` characters, a third of the table in one of them maybe, are dealt by ranges of their
    order.  Only their last steps are bound to one task each: composing a row per partition, and reading the repaired rows in
    order for a digest.
    """

    def __init__(self, table: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS):
        self.spark, self.kind = table.sparkSession, table.schema["conv_id"].dataType
        rows = _prepared(table)
        self.sizes = staged(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), *self._gaps()), "conversation-sizes")
        long = staged(self.sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select("conv"), "conversation-long")
        self.any_long = long.limit(1).count() > 0
        plain = rows.join(small(long), _same(rows, long), "left_anti") if self.any_long else rows
        with arrow_batches(self.spark, BATCH_ROWS):
            sent = plain.select(*_ORDER, "text", "initial", "fault", "present").repartition("conv").sortWithinPartitions(*_ORDER)
            self.whole = staged(sent.mapInPandas(_whole, _REPORT), "conversation-reports")
            if self.any_long:
                self._long(rows.join(small(long), _same(rows, long), "left_semi").where("present"))

    @staticmethod
    def _gaps() -> list:
        """Distinct turns are counted by runs: a window would hold a conversation, distinct sums come partly before the exchange."""
        turn = F.when(F.col("present"), F.col("turn"))
        return [F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps")]

    def _long(self, rows: DataFrame) -> None:
        rows = staged(rows.withColumn("place", F.monotonically_increasing_id()), "conversation-rows")
        order = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"), "place")
        firsts = rows.where("fault <> 'blank'").groupBy("conv", "role", "digest").agg(F.min(order).alias("o"))
        firsts = firsts.select(F.col("o.place").alias("place"), F.lit(True).alias("first"))
        marked = rows.join(firsts, "place", "left")
        fault = F.when(F.col("fault") == "blank", "blank").when(F.col("first"), F.col("fault")).otherwise("duplicate")
        self.ordered = staged(marked.select(*_ORDER, "place", "text", "initial", fault.alias("fault")), "conversation-rows")
        dealt = self.ordered.select(*_ORDER, "place", "initial", "fault").repartitionByRange(*_ORDER, "place").sortWithinPartitions(*_ORDER, "place")
        parts = staged(dealt.mapInPandas(_stretches, _STRETCHES), "conversation-stretches")
        joined = parts.groupBy("conv").applyInPandas(_joined, _SUMMARY)
        self.joined = staged(joined, "conversation-joined")

    def _replay(self) -> DataFrame:
        """Repaired rows of the long conversations, each in one task in order."""
        audits = self.joined.select("conv", "audit")
        empty = [F.lit(None).cast(t).alias(c) for c, t in self.ordered.drop("conv", "initial", "fault").dtypes]
        rows = self.ordered.select("conv", F.lit(None).cast("string").alias("audit"), *[c for c in self.ordered.columns if c not in ("conv", "initial", "fault")])
        both = rows.union(audits.select("conv", "audit", *empty)).withColumn("after", F.col("audit").isNull())
        own = both.repartition("conv").sortWithinPartitions("conv", "after", *_ORDER[1:], "place")
        return own.mapInPandas(_replayed, "conv string, place long, role string, text string")

    def _named(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("conv").cast(self.kind).alias("conv_id"), *[c for c in df.columns if c != "conv"])

    def rows(self) -> DataFrame:
        """``conv_id``, ``place`` (from 0), ``role``, ``text`` of the repaired turns."""
        out = self.whole.select("conv", F.posexplode("repaired").alias("place", "r")).select("conv", F.col("place").cast("long"), "r.role", "r.text")
        return self._named(out.union(self._replay()) if self.any_long else out)

    def summary(self) -> DataFrame:
        """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256`` (of the repaired
        turns as ``role:text`` lines)."""
        lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
        out = self.whole.select(*[c for c in self.whole.columns if c != "repaired"], F.sha2(lines, 256).alias("repaired_sha256"))
        if self.any_long:
            with arrow_batches(self.spark, BATCH_ROWS):
                digests = staged(self._replay().mapInPandas(_digests, "conv string, repaired_sha256 string"), "conversation-digests")
            found = self.joined.join(digests, _same(self.joined, digests), "left").drop(digests["conv"])
            out = out.union(found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))))
        gaps = self.sizes.select("conv", "gaps")
        named = gaps.join(out, _same(gaps, out), "left").drop(out["conv"])
        zero = {**dict.fromkeys((*_FAULTS, "illegal", "cost"), F.lit(0)), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
        return self._named(named.select("conv", "gaps", *[F.coalesce(c, v).alias(c) for c, v in zero.items()]))


def repair_report(table: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    return Repair(table, long_rows, long_chars).summary()


def repaired_conversations(table: DataFrame) -> DataFrame:
    return Repair(table).rows()
