"""The learned ranker's training table, each row as it was known before its event, and the ranker fitted on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import EPS, stacked
from ..operators import lambdamart
from ..operators.ranking import WEIGHTS
from ..operators.state import ALPHA
from ..sources.staging import staged

# What an event says of a paper that was shown.
GAINS = {"save": 2, "click": 1, "view": 0, "not_interested": 0}
_PROFILES = {"lt": "long_term", "st": "short_term", "neg": "negative"}
FEATURES = ["lt_sim", "st_sim", "neg_sim", "saves_before", "dismissals_before"]
_AT = {s: FEATURES.index(f"{s}_sim") for s in _PROFILES}
#: The profiles that an event changes.
_CHANGES = {"save": ("lt", "st"), "not_interested": ("neg",)}


def training_table(events: DataFrame, vectors: DataFrame, days: int = 6) -> DataFrame:
    """``group`` (a user's events of some days), ``id``, ``user_id``, ``paper_id``, ``timestamp``, ``label`` and ``features``.

    Features are similarities to the user's profiles, and counts, as of just before the event: one fold over a
    user's events in order, which holds a vector for each profile, so an event never sees itself or what came later.  Events whose paper has no vector are left out.
    """
    label = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in GAINS.items()])
    group = F.concat_ws("/", F.col("user_id").cast("string"), F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / (86_400 * days)).cast("string"))
    known = events.where(F.col("event_type").isin(list(GAINS)) & F.col("user_id").isNotNull()).join(vectors.select("paper_id", "embedding"), "paper_id")
    columns = ["group", "id", "user_id", "paper_id", "timestamp", "label"]
    rows = known.select(group.alias("group"), "id", "user_id", "paper_id", "timestamp", label.alias("label"), "event_type", "embedding")
    schema = T.StructType([*rows.select(columns).schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def fold(batches):
        user, profiles, counts, waiting, last = None, {}, {}, [], None
        for batch in batches:
            sims = np.zeros((len(batch), len(FEATURES)))
            users, kinds, own = batch.column("user_id").to_pylist(), batch.column("event_type").to_pylist(), batch.column("embedding")
            there, matrix = own.is_valid().to_numpy(zero_copy_only=False), stacked(own.drop_null())
            place = np.cumsum(there) - 1
            for i, (u, time, kind) in enumerate(zip(users, batch.column("timestamp").cast(pa.int64()).to_pylist(), kinds, strict=True)):
                if u != user:
                    user, profiles, counts, waiting, last = u, {}, dict.fromkeys(_PROFILES, 0), [], None
                if time != last:
                    # Events of one time do not see each other.
                    for what, w in waiting:
                        _update(profiles, counts, what, w)
                    waiting, last = [], time
                v = matrix[place[i]] if there[i] else None
                if time is not None:
                    if v is not None:
                        size = np.sqrt(v @ v) + EPS
                        for name, (p, length) in profiles.items():
                            sims[i, _AT[name]] = (v @ p) / (size * (length + EPS))
                    sims[i, 3:] = counts["lt"], counts["neg"]
                if v is not None and kind in _CHANGES:
                    waiting.append((kind, v))
            sims[:, :3] = np.round(sims[:, :3], 9)
            out = pa.array(list(sims), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), out], [*columns, "features"])

    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "timestamp", "id")
    return ordered.select(*columns, "event_type", "embedding").mapInArrow(fold, schema)


def _update(profiles: dict, counts: dict, kind: str, v: np.ndarray) -> None:
    """A user's profiles (vector, length) and their numbers of updates after an event."""
    for name in _CHANGES[kind]:
        p, length = profiles.get(name, (None, 0.0))
        counts[name] += 1
        blended = v if p is None else (1 - ALPHA[_PROFILES[name]]) * p + ALPHA[_PROFILES[name]] * v
        size = np.sqrt((blended * blended).sum())
        if size >= EPS:
            unit = blended / size
            profiles[name] = unit, np.sqrt(unit @ unit)


def heuristic(features: str = "features"):
    """The fixed weights' score over the same features."""
    at = lambda name: F.col(features)[FEATURES.index(name)]
    return WEIGHTS["lt"] * at("lt_sim") + WEIGHTS["st"] * at("st_sim") - WEIGHTS["negative"] * F.greatest(at("neg_sim"), F.lit(0.0))


def split(table: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(groups that end before the time that ``share`` of the rows precede, the later groups)."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    limit = table.agg(F.percentile_approx(at, share, 10_000)).first()[0]
    late = table.groupBy("group").agg(F.max(at).alias("end")).where(F.col("end") > F.lit(limit)).select("group")
    return table.join(late, "group", "left_anti"), table.join(late, "group", "left_semi")


def ranked(table: DataFrame, score) -> DataFrame:
    """``query_id`` (the group), ``paper_id`` (the event's id), ``rank`` by a score, for the measures of ``evaluation``."""
    from pyspark.sql import Window as W

    order = W.partitionBy("group").orderBy(F.desc(F.round(score, 9)), "id")
    return table.select(F.col("group").alias("query_id"), F.col("id").alias("paper_id"), F.row_number().over(order).alias("rank"))


def learned(events: DataFrame, vectors: DataFrame, rounds: int = 4, depth: int = 2) -> tuple[list, DataFrame]:
    """(trees fitted on the earlier groups, the later groups' rows)."""
    table = staged(training_table(events, vectors), "rank-training")
    early, late = split(table)
    return lambdamart.fit(early, rounds, depth), late
