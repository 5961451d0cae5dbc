"""Conversation memory as a stream with control events: clear, history, info, and expiry.

Events are ``(conv_id, seq, ts, kind, role, text)``: a ``turn`` is remembered, ``clear``
forgets what came before it, ``history`` asks for the turns remembered and ``info`` for
their number and size. What counts is ``seq``, not the order of arrival: turns before
the last clear are not remembered even if they come after it, and a turn that comes twice
(a replayed source) is one. Questions are answered from the events of smaller seq that
have arrived.

State holds the newest ``n`` turns of each conversation. With ``idle``, a conversation
without events for so long (by event time, behind the watermark of ``late``) is forgotten, which
is put out as ``expired``. Events without a conv_id are a conversation of their own, those
without a seq or kind are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_TURN = "seq long, role string, text string"
_ANSWER = f"conv_id long, seq long, kind string, n_turns long, n_chars long, turns array<struct<{_TURN.replace(' ', ': ')}>>".replace(",: ", ", ")
#: State needs this provider; set it before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Dialogue(StatefulProcessor):
    """Turns in a list state, and in a value the last clear and the time of the last event."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", _TURN)
        self.mark = handle.getValueState("mark", "cleared long, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {t[0]: tuple(t) for t in self.turns.get()}
        cleared, at = self.mark.get() if self.mark.exists() else (-1 << 62, -1)
        out = []
        for r in sorted(rows, key=lambda r: (r.seq, r.kind)):
            at = max(at, r.at)
            if r.kind == "turn" and r.seq > cleared:
                held[r.seq] = (r.seq, r.role, r.text)
            elif r.kind == "clear" and r.seq > cleared:
                cleared = r.seq
                before = [s for s in held if s < cleared]
                out.append(self._answer(key, r.seq, "cleared", [held.pop(s) for s in before], whole=False))
            elif r.kind in ("history", "info"):
                known = sorted(t for s, t in held.items() if s < r.seq)[-self.n :]
                out.append(self._answer(key, r.seq, r.kind, known, whole=r.kind == "history"))
        newest = sorted(held.values())[-self.n :]
        if newest:
            self.turns.put(newest)
        else:
            self.turns.clear()
        self.mark.update((cleared, at))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at + self.idle_ms)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = [tuple(t) for t in self.turns.get()]
        self.turns.clear()
        self.mark.clear()
        yield self._answer(key, None, "expired", held, whole=False)

    def close(self) -> None:
        pass

    @staticmethod
    def _answer(key, seq, kind: str, turns: list[tuple], whole: bool) -> Row:
        return Row(conv_id=key[0], seq=seq, kind=kind, n_turns=len(turns), n_chars=sum(len(t[2] or "") for t in turns), turns=[Row(seq=s, role=r, text=x) for s, r, x in turns] if whole else None)


def dialogues(events: DataFrame, n: int = 10, idle_seconds: int | None = None, late: str = "1 hour") -> DataFrame:
    """conv_id, seq, kind (cleared, history, info or expired), n_turns, n_chars, turns (of history) for a stream of events."""
    rows = events.where("seq is not null and kind is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("at", F.coalesce(F.unix_millis("ts"), F.lit(0)))
    rows = rows.withWatermark("ts", late) if idle_seconds is not None else rows
    mode = "EventTime" if idle_seconds is not None else "None"
    rows = rows.select("conv_id", "seq", "kind", "role", "text", "at", *(["ts"] if idle_seconds is not None else []))
    return rows.groupBy("conv_id").transformWithState(Dialogue(n, None if idle_seconds is None else idle_seconds * 1000), _ANSWER, "Append", mode)
