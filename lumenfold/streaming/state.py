"""Event ingestion as a stream: per-user state and profiles, equal to the batch folds over the same log, and event windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import ALPHA, HISTORY, MAX_NEGATIVES, MAX_POSITIVES

#: A user's newest events, oldest first, and how many there were in all.
STATE = "times array<bigint>, ids array<bigint>, saves array<boolean>, papers array<bigint>, seen bigint"
OUTPUT = "user_id long, positives array<bigint>, negatives array<bigint>, seen long"


def apply_event(positives: list, negatives: list, kind: str, paper) -> None:
    """One save or dismissal on the newest-first lists, in place."""
    own, other, most = (positives, negatives, MAX_POSITIVES) if kind == "save" else (negatives, positives, MAX_NEGATIVES)
    if paper in other:
        other.remove(paper)
    if paper not in own:
        own.insert(0, paper)
        del own[most:]


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.unix_micros(F.col("timestamp").cast("timestamp")))


def stream_user_state(events: DataFrame) -> DataFrame:
    """Running lists per user, folded from the last ``HISTORY`` saves and dismissals as in the batch form; ``seen`` counts all.

    The state is those events in order of time and id, so late ones within them take their place.
    """

    def update(key, batches, state):
        held = list(zip(*state.get[:4], strict=True)) if state.exists else []
        seen = state.get[4] if state.exists else 0
        for batch in batches:
            held += zip(*(batch[c].tolist() for c in ("at", "id", "save", "paper_id")), strict=True)
            seen += len(batch)
            held = sorted(held, key=lambda e: e[:2])[-HISTORY:]
        positives, negatives = [], []
        for _, _, save, paper in held:
            apply_event(positives, negatives, "save" if save else "not_interested", paper)
        state.update((*(list(x) for x in zip(*held, strict=True)), seen))
        yield pd.DataFrame({"user_id": [key[0]], "positives": [positives], "negatives": [negatives], "seen": [seen]})

    own = _timed(events.where(F.col("event_type").isin("save", "not_interested"))).select("user_id", "at", "id", (F.col("event_type") == "save").alias("save"), "paper_id")
    return own.groupBy("user_id").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")


def stream_profile(events: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """Running ``profile`` and ``n`` per user: the exponentially weighted unit vector of the batch form, over a stream.

    Each trigger's events are applied in order of time and id; those whose paper has no vector are left out.
    """
    alpha, event = ALPHA[kind], "not_interested" if kind == "negative" else "save"

    def update(key, batches, state):
        profile, n = (np.array(state.get[0]), state.get[1]) if state.exists else (np.zeros(0), 0)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        for vector in rows["embedding"]:
            new = np.asarray(vector, dtype=float) if not len(profile) else (1 - alpha) * profile + alpha * np.asarray(vector, dtype=float)
            size = np.sqrt((new * new).sum())
            profile = new / size if size >= 1e-10 else profile
        n += len(rows)
        state.update((profile.tolist(), n))
        yield pd.DataFrame({"user_id": [key[0]], "profile": [profile.tolist()], "n": [n]})

    own = _timed(events.where(F.col("event_type") == event)).join(vectors.select("paper_id", "embedding"), "paper_id").select("user_id", "at", "id", "embedding")
    shape = "profile array<double>, n bigint"
    return own.groupBy("user_id").applyInPandasWithState(update, f"user_id long, {shape}", shape, "update", "NoTimeout")


def stream_distinct(events: DataFrame, late: str = "1 hour", key: str = "id") -> DataFrame:
    """The first of the events with a key, among those no farther apart than the watermark; older keys are forgotten."""
    return events.withColumn("time", F.col("timestamp").cast("timestamp")).withWatermark("time", late).dropDuplicatesWithinWatermark([key]).drop("time")


def stream_window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts per type with a watermark."""
    timed = events.withColumn("time", F.col("timestamp").cast("timestamp")).withWatermark("time", late)
    return timed.groupBy(F.window("time", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
