"""A queue of items for evaluators, as a stream: one item for each, leases, and results written once.

Events are ``(queue, seq, ts, kind, item_id, evaluator, score)``. An ``item`` joins the
end of its queue. An evaluator who is ``ready`` gets the first item, or waits for one; nobody has
more than one. ``done`` ends an item, ``left`` gives it back. An item is leased: without
``done`` within ``lease_seconds`` of event time it goes back to the end of the queue,
and its evaluator counts as gone. The first ``done`` of an item counts, also a late one;
later ones of the same item are nothing.

A queue is one key, in order of seq, so its work is sequential: ``sharded`` deals items
and evaluators to several queues by hash, each in order. State holds a row for each item that is not done
and for each evaluator; steps cost the same however long a queue is. ``written`` puts the
decisions into a ``Store`` under the batch's number, which a replayed batch finds taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import Store

_DECISION = "queue string, kind string, item_id long, evaluator string, score double, seq long"


class Queue(StatefulProcessor):
    """Items and evaluators by name, and both lines by place; places are given once."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item_id long", "place long, evaluator string, deadline long")
        self.line = handle.getMapState("line", "place long", "item_id long")
        self.people = handle.getMapState("people", "evaluator string", "place long, item_id long")
        self.waiting = handle.getMapState("waiting", "place long", "evaluator string")
        self.ends = handle.getValueState("ends", "item_head long, item_tail long, wait_head long, wait_tail long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._open(key)
        for r in sorted(rows, key=lambda r: r.seq):
            self.seq, self.now = r.seq, r.at
            if r.kind == "item" and not self.items.containsKey((r.item_id,)):
                self._queue(r.item_id)
            elif r.kind == "ready" and not self.people.containsKey((r.evaluator,)):
                self.waiting.updateValue((self.at[3],), (r.evaluator,))
                self.people.updateValue((r.evaluator,), (self.at[3], None))
                self.at[3] += 1
            elif r.kind == "done" and self.items.containsKey((r.item_id,)):
                place, holder, _ = self.items.getValue((r.item_id,))
                self._forget(r.item_id, place)
                if holder is not None:
                    self.people.removeKey((holder,))
                self._put("done", r.item_id, r.evaluator, r.score)
            elif r.kind == "left" and self.people.containsKey((r.evaluator,)):
                self._gone(r.evaluator)
            self._match()
        yield from self._closed()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._open(key)
        self.seq, self.now = None, expiredTimerInfo.getExpiryTimeInMs()
        late = [(deadline, item[0], holder) for item, (_, holder, deadline) in self.items.iterator() if holder is not None and deadline <= self.now]
        for _, _, holder in sorted(late):
            self._gone(holder)
        self._match()
        yield from self._closed()

    def close(self) -> None:
        pass

    def _open(self, key) -> None:
        self.key, self.out = key[0], []
        self.at = list(self.ends.get()) if self.ends.exists() else [0, 0, 0, 0]

    def _closed(self) -> list[Row]:
        self.ends.update(tuple(self.at))
        return self.out

    def _put(self, kind, item, evaluator, score=None) -> None:
        self.out.append(Row(queue=self.key, kind=kind, item_id=item, evaluator=evaluator, score=score, seq=self.seq))

    def _queue(self, item) -> None:
        self.line.updateValue((self.at[1],), (item,))
        self.items.updateValue((item,), (self.at[1], None, None))
        self.at[1] += 1

    def _forget(self, item, place) -> None:
        self.items.removeKey((item,))
        if place is not None and self.line.containsKey((place,)):
            self.line.removeKey((place,))

    def _gone(self, evaluator) -> None:
        """An evaluator leaves: out of the line, and the item back to the queue."""
        place, item = self.people.getValue((evaluator,))
        self.people.removeKey((evaluator,))
        if item is None:
            self.waiting.removeKey((place,))
        elif self.items.containsKey((item,)):
            self._queue(item)
            self._put("requeued", item, evaluator)

    def _match(self) -> None:
        """First items to first evaluators, as long as there are both."""
        while True:
            while self.at[0] < self.at[1] and not self.line.containsKey((self.at[0],)):
                self.at[0] += 1
            while self.at[2] < self.at[3] and not self.waiting.containsKey((self.at[2],)):
                self.at[2] += 1
            if self.at[0] == self.at[1] or self.at[2] == self.at[3]:
                return
            item, evaluator = self.line.getValue((self.at[0],))[0], self.waiting.getValue((self.at[2],))[0]
            self.line.removeKey((self.at[0],))
            self.waiting.removeKey((self.at[2],))
            deadline = self.now + self.lease_ms
            self.items.updateValue((item,), (None, evaluator, deadline))
            self.people.updateValue((evaluator,), (None, item))
            self.handle.registerTimer(deadline)
            self._put("assigned", item, evaluator)


def sharded(events: DataFrame, shards: int) -> DataFrame:
    """Events with a queue each: items by item_id, evaluators by their name; ``done`` and ``left`` follow the evaluator's."""
    who = F.when(F.col("kind") == "item", F.col("item_id").cast("string")).otherwise(F.col("evaluator"))
    return events.withColumn("queue", F.pmod(F.xxhash64(who), F.lit(shards)).cast("string"))


def decisions(events: DataFrame, lease_seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """queue, kind (assigned, done or requeued), item_id, evaluator, score, seq for a stream of events; null seqs and kinds are left out."""
    rows = events.where("seq is not null and kind is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select(F.col("queue").cast("string").alias("queue"), "seq", "ts", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at"), "kind", F.col("item_id").cast("long").alias("item_id"), F.col("evaluator").cast("string").alias("evaluator"), F.col("score").cast("double").alias("score"))
    return rows.withWatermark("ts", late).groupBy("queue").transformWithState(Queue(lease_seconds * 1000), _DECISION, "Append", "EventTime")


def written(store: Store, name: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each batch is in the store once, however often it is run."""
    return lambda batch, number: store.add(batch, batch=(name, number))
