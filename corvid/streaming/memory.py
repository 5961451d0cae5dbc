"""Streams: conversation memory, running scores, sessions and event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def remembered(turns: DataFrame, n: int = 10) -> DataFrame:
    """conv_id, turn, role, text, back: after each batch the newest ``n`` turns of the conversations in it.

    State holds ``n`` turns for each conversation.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in (state.get[0] if state.exists else [])]
        for frame in frames:
            held += list(zip(frame["turn"].tolist(), frame["role"].tolist(), frame["text"].tolist(), strict=True))
            held = sorted(set(held), key=lambda x: x[0])[-n:]
        state.update((held,))
        yield pd.DataFrame({"conv_id": [key[0]] * len(held), "turn": [x[0] for x in held], "role": [x[1] for x in held], "text": [x[2] for x in held], "back": list(range(len(held), 0, -1))})

    return turns.groupBy("conv_id").applyInPandasWithState(
        update,
        "conv_id long, turn long, role string, text string, back long",
        "turns array<struct<turn: long, role: string, text: string>>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def running_scores(events: DataFrame) -> DataFrame:
    """Count and mean of each evaluator's scores so far."""
    return events.groupBy("evaluator_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", by: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of each user: events at most ``gap`` apart. Works on streams and tables."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", late)
    return rows.groupBy(by, F.session_window("_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def windows(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day", by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts by tumbling or sliding window. Works on streams and tables."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", late)
    return rows.groupBy(by, F.window("_ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("started"), "n")
