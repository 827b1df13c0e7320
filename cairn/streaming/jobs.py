"""States of jobs from a stream of their events: the last status of each, and whether a running one has gone quiet."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Statuses of jobs that have ended; seconds after which another one is stale.
ENDED, STALE = ("done", "error"), 30


def states(events: DataFrame, now: DataFrame, seconds: int = STALE) -> DataFrame:
    """Batch form: job, status, ts, stale as of ``now`` (one row). events: job, seq, ts, status; of events at the same time the last by seq counts."""
    last = events.groupBy("job").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("x"))
    rows = last.select("job", "x.status", "x.ts").crossJoin(F.broadcast(now.select(F.col("now").alias("_now"))))
    quiet = F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)) < F.col("_now")
    return rows.withColumn("stale", ~F.col("status").isin(*ENDED) & quiet).drop("_now")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, seconds: int) -> Iterator[pd.DataFrame]:
    """State: micros of the last event, its seq, its status. A job that ended has no timer."""
    if state.hasTimedOut:
        at, seq, status = state.get
        state.update((at, seq, status))  # it may go on
        yield pd.DataFrame({"job": [key[0]], "status": [status], "ts": [pd.Timestamp(at, unit="us")], "stale": [True]})
        return
    at, seq, status = state.get if state.exists else (None, None, None)
    for f in frames:
        for ts, s, kind in zip(f["ts"], f["seq"], f["status"], strict=True):
            micros = pd.Timestamp(ts).value // 1000
            if at is None or (micros, s) > (at, seq):
                at, seq, status = micros, int(s), kind
    state.update((at, seq, status))
    due = at // 1000 + 1000 * seconds + 1
    late = status not in ENDED and due <= state.getCurrentWatermarkMs()  # the batch is behind already
    if status not in ENDED and not late:
        state.setTimeoutTimestamp(due)
    yield pd.DataFrame({"job": [key[0]], "status": [status], "ts": [pd.Timestamp(at, unit="us")], "stale": [late]})


def watched(events: DataFrame, delay: str = "10 seconds", seconds: int = STALE) -> DataFrame:
    """Stream form: a row whenever a job's state changes, stale ones when the watermark passes their timer. State is one row for each job."""
    rows = events.withWatermark("ts", delay).select("job", "seq", "ts", "status")
    kind = events.schema["job"].dataType.simpleString()
    return rows.groupBy("job").applyInPandasWithState(
        partial(_advance, seconds=seconds), f"job {kind}, status string, ts timestamp, stale boolean", "at long, seq long, status string", "update", GroupStateTimeout.EventTimeTimeout
    )
