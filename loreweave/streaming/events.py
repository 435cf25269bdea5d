"""The stateful parts on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def kpi_windows(events: DataFrame, window: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls and errors in sliding windows over event time; rows later than `late` are dropped."""
    g = events.withWatermark("event_time", late).groupBy(F.window("event_time", window, slide), "tool")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errs")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "tool", "n", "errs")


def first_surfacings(events: DataFrame, late: str = "7 days") -> DataFrame:
    """The first surfacing of a record for a file in a session, for seven days: the ledger as a stream."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["session_id", "file", "memory_id"])


def retained(events: DataFrame, late: str = "90 days") -> DataFrame:
    """A stream that forgets state older than the retention."""
    return events.withWatermark("event_time", late)


DISMISSED = "session_id string, memory_id string, file string, count long"
_STATE = "surfaced array<struct<memory_id:string,file:string,ts:long>>, got array<struct<memory_id:string,ts:long>>, last long"


def _session(grace_ms: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            surfaced, got, _ = state.get
            last_get: dict[str, int] = {}
            for memory, ts in map(tuple, got):
                last_get[memory] = max(ts, last_get.get(memory, ts))
            seen: dict[tuple, int] = {}
            for memory, file, ts in map(tuple, surfaced):
                seen.setdefault((memory, file), ts)
            left = [(key[0], m, f, 1) for (m, f), ts in seen.items() if last_get.get(m, -1) < ts]
            state.remove()
            yield pd.DataFrame(left, columns=["session_id", "memory_id", "file", "count"])
            return
        surfaced, got, last = state.get if state.exists else ([], [], 0)
        surfaced, got = [tuple(x) for x in surfaced], [tuple(x) for x in got]
        for pdf in batches:
            pdf = pdf.sort_values("ordinal")
            for kind, memory, file, ts in zip(pdf["kind"], pdf["memory_id"], pdf["file"], pdf["ts"], strict=True):
                if kind == "surface":
                    surfaced.append((memory, file, int(ts)))
                else:
                    got.append((memory, int(ts)))
                last = max(last, int(ts))
        state.update((surfaced, got, last))
        state.setTimeoutTimestamp(max(last + grace_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["session_id", "memory_id", "file", "count"])

    return run


def dismissals(events: DataFrame, grace_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """A row for each surfaced record and file of a session that has been idle past the grace without a later get.

    events (session_id, kind 'surface' or 'get', memory_id, file, ts, ordinal, event_time). A session's state is its own events
    since the last idle time; it goes when the timer fires. Rows without a session are left out.
    """
    own = events.where("session_id is not null").withWatermark("event_time", late)
    return own.groupBy("session_id").applyInPandasWithState(_session(grace_ms), DISMISSED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def append_calls(events: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends tool calls to a store, all that is there now, partitioned by repository."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("repo_key").trigger(availableNow=True).start()
