"""The life of submitted batches, as a stateful stream and as a batch query with the same rows.

A batch starts with its first event. The first of its events that ends it (completed, failed, cancelled, expired) within the
window does; without one it expires at the window's end. The stream keeps two times and a status per open batch and emits a
batch once the watermark has passed its end, when no earlier event can come; so the order in which events arrive does not matter,
as long as none is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The statuses that end a batch; the hours after which it expires.
ENDS = ("cancelled", "completed", "expired", "failed")
HOURS = 24
ENDED = "batch_id string, status string, started timestamp, ended timestamp"
_STATE = "started long, ended long, status string"


def lifecycle(events: DataFrame, now: Column | None = None, hours: int = HOURS) -> DataFrame:
    """(batch_id, status, started, ended) of events (batch_id, ts, status): one row per batch; "open", without an end, if its window
    reaches beyond ``now`` (by default the last event's time) and nothing has ended it. Events without a batch or time do not count."""
    known = events.where("batch_id IS NOT NULL AND ts IS NOT NULL")
    first_end = F.min(F.when(F.col("status").isin(*ENDS), F.struct("ts", "status"))).alias("e")
    per = known.groupBy("batch_id").agg(F.min("ts").alias("started"), first_end)
    time = now if now is not None else F.col("now")
    if now is None:
        per = per.join(F.broadcast(known.agg(F.max("ts").alias("now"))))  # one row
    deadline = F.col("started") + F.expr(f"INTERVAL {hours} HOURS")
    in_time = F.coalesce(F.col("e.ts") <= deadline, F.lit(False)) & F.coalesce(F.col("e.ts") <= time, F.lit(False))
    status = F.when(in_time, F.col("e.status")).when(deadline <= time, "expired").otherwise("open")
    return per.select("batch_id", status.alias("status"), "started", F.when(in_time, F.col("e.ts")).when(deadline <= time, deadline).alias("ended"))


def lifecycle_stream(events: DataFrame, late: str = "1 hour", hours: int = HOURS) -> DataFrame:
    """(batch_id, status, started, ended) of a stream of events, each batch once, when it has ended and the watermark passed that."""
    window = hours * 3_600_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, ended, status = state.get if state.exists else (None, None, None)
        if not state.hasTimedOut:
            for f in frames:
                ms = f["ts"].astype("datetime64[us]").astype("int64") // 1000
                started = int(ms.min()) if started is None else min(started, int(ms.min()))
                for at, s in sorted(zip(ms[f["status"].isin(ENDS)], f["status"][f["status"].isin(ENDS)], strict=True))[:1]:
                    if ended is None or (at, s) < (ended, status):
                        ended, status = int(at), s
        over = started + window
        end, said = (ended, status) if ended is not None and ended <= over else (over, "expired")
        if end < state.getCurrentWatermarkMs():
            state.remove()
            yield pd.DataFrame({"batch_id": [key[0]], "status": [said], "started": [pd.Timestamp(started, unit="ms")], "ended": [pd.Timestamp(end, unit="ms")]})
        else:
            state.update((started, ended, status))
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs()) + 1)

    known = events.where("batch_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return known.groupBy("batch_id").applyInPandasWithState(step, ENDED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
