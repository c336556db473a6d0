"""Region edges on a stream: the twin of the batch operator, with one flag of state a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "k long, event_id long, entered boolean, left boolean"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    inside = state.get[0] if state.exists else False
    rows = pd.concat(list(frames)).sort_values(["due", "event_id"])  # of one key in one micro-batch
    out = []
    for r in rows.itertuples():
        out.append((key[0], r.event_id, bool(r.inside and not inside), bool(inside and not r.inside)))
        inside = bool(r.inside)
    state.update((inside,))
    yield pd.DataFrame(out, columns=["k", "event_id", "entered", "left"])


def edge_stream(rows: DataFrame) -> DataFrame:
    """Stream (k, event_id, due, inside) to (k, event_id, entered, left); late rows count when they come."""
    return rows.groupBy("k").applyInPandasWithState(_step, OUT, "inside boolean", "append", GroupStateTimeout.NoTimeout)
