"""Static values on a stream: the twin of reads as of a call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

OUT = "read_id long, value long"


class Statics(StatefulProcessor):
    """Rows (key, at, seq, slot, value, read_id) of one owner: a write, or a read where read_id is given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coming = handle.getMapState("coming", "at long, reads int, seq long", "slot long, value long, read_id long")
        self.values = handle.getMapState("values", "slot long", "value long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number = lambda v: None if pd.isna(v) else int(v)
        for frame in rows:
            for r in frame.itertuples():
                reads = not pd.isna(r.read_id)
                self.coming.updateValue((int(r.at), int(reads), int(r.read_id if reads else r.seq)), (number(r.slot), number(r.value), number(r.read_id)))
                self.handle.registerTimer(int(r.at))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for at, (slot, value, read_id) in sorted(((k, v) for k, v in self.coming.iterator() if k[0] <= now), key=lambda e: e[0]):
            self.coming.removeKey(at)
            if read_id is None:
                self.values.updateValue((slot,), (value or 0,))
            else:
                out.append((read_id, self.values.getValue((slot,))[0] if slot is not None and self.values.containsKey((slot,)) else 0))
        if out:
            yield pd.DataFrame(out, columns=["read_id", "value"])

    def close(self) -> None:
        pass


def statics_stream(rows: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Stream (owner, at: milliseconds, seq, slot, value, read_id) to (read_id, value), once the watermark has passed the read.

    Rows may be up to delay behind the latest; Spark drops later ones. Writes without a slot or time and reads without a time
    are left out. Writes at one time must differ in seq, reads in read_id.
    """
    ship(rows.sparkSession)
    keyed = rows.filter("at IS NOT NULL AND (read_id IS NOT NULL OR slot IS NOT NULL)").withColumn("key", F.coalesce(F.concat(F.lit("of "), F.col("owner").cast("string")), F.lit("all")))
    timed = keyed.select("key", "at", F.coalesce("seq", F.lit(0)).alias("seq"), "slot", "value", "read_id", F.timestamp_millis("at").alias("_time")).withWatermark("_time", delay)
    return timed.groupBy("key").transformWithStateInPandas(Statics(), OUT, "append", "EventTime")
