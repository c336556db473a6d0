"""Queues in time as keyed state: entries are added, cancelled and fire when they are due, over any number of micro-batches.

Time is event time. Rows wait in state until the watermark has passed them and are then applied in the order of time, so the
result does not depend on how rows are cut into micro-batches or on their order, as long as none is further behind the latest
than the delay; Spark drops those that are, so the delay must cover them. An entry fires when the watermark reaches its due
time, a cancellation at that very time comes too late. State holds what waits, with a timer for each time at which something
is to happen; a key for which nothing waits holds none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key long, event_id long, due long"


class Queue(StatefulProcessor):
    """Rows (key, at, seq, what, event_id, due): what is add, cancel (that entry) or cancel_first (by due, then seq)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coming = handle.getMapState("coming", "at long, seq long", "what string, event_id long, due long")
        self.waiting = handle.getMapState("waiting", "event_id long", "due long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples():
                number = lambda v: None if pd.isna(v) else int(v)
                if not (pd.isna(r.at) or pd.isna(r.seq) or pd.isna(r.what)):
                    self.coming.updateValue((int(r.at), int(r.seq)), (r.what, number(r.event_id), number(r.due)))
                    self.handle.registerTimer(int(r.at))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # later timers of the same advance find nothing left
        out: list[tuple[int, int, int]] = []
        for (at, seq), (what, event_id, due) in sorted(((k, v) for k, v in self.coming.iterator() if k[0] <= now), key=lambda e: e[0]):
            self.coming.removeKey((at, seq))
            self._fire(key, at, out)
            if what == "add" and event_id is not None and due is not None:
                self.waiting.updateValue((event_id,), (due, seq))
                if due > now:
                    self.handle.registerTimer(due)
            elif what == "cancel" and event_id is not None and self.waiting.containsKey((event_id,)):
                self.waiting.removeKey((event_id,))
            elif what == "cancel_first" and (left := self._ordered()):
                self.waiting.removeKey((left[0][2],))
        self._fire(key, now, out)
        if out:
            yield pd.DataFrame(out, columns=["key", "event_id", "due"])

    def _ordered(self) -> list[tuple[int, int, int]]:
        return sorted((due, seq, event_id) for (event_id,), (due, seq) in self.waiting.iterator())

    def _fire(self, key, now: int, out: list[tuple[int, int, int]]) -> None:
        for due, _, event_id in self._ordered():
            if due <= now:
                self.waiting.removeKey((event_id,))
                out.append((key[0], event_id, due))

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """Timers need a state store that keeps them; set for the session's later streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def fired_stream(rows: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Stream (key, at: milliseconds, seq, what, event_id, due: milliseconds) to (key, event_id, due) of what fires.

    delay is how far rows may be behind the latest. A row without a key is left out; entries without an id or due time are
    passed over; an id that is added again replaces its waiting entry.
    """
    ship(rows.sparkSession)
    timed = rows.filter("key IS NOT NULL").select("key", "at", "seq", "what", "event_id", "due", F.timestamp_millis("at").alias("_time")).withWatermark("_time", delay)
    return timed.groupBy("key").transformWithStateInPandas(Queue(), OUT, "append", "EventTime")


def fired(rows: DataFrame, until: int) -> DataFrame:
    """Batch twin for entries that are added once and cancelled by id: what has come and is due by `until`, and was not cancelled before.

    One aggregation by key and id: partial sums meet before the shuffle, so a hot key is many groups.
    """
    adds, cancels = F.col("what") == "add", F.col("what") == "cancel"
    each = rows.filter("key IS NOT NULL AND event_id IS NOT NULL").groupBy("key", "event_id").agg(F.max(F.when(adds, F.col("due"))).alias("due"), F.max(F.when(adds, F.col("at"))).alias("added"), F.collect_set(F.when(cancels, F.col("at"))).alias("cancelled"))
    gone = F.exists("cancelled", lambda c: (c >= F.col("added")) & (c < F.col("due")))
    return each.filter(F.col("due").isNotNull() & (F.greatest("due", "added") <= until) & ~gone).select("key", "event_id", "due")
