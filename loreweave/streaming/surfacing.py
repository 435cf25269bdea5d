"""The edit hook as one streaming query: edits meet scopes, dismissed records are left out, each is shown once, and what nobody opens counts as dismissed.

    edits and gets -> scopes (stream-static join) -> unsuppressed -> one state for each session -> shown and dismissed rows

A session's events wait in a map by time until the watermark has passed them and are then taken in order of (ts, ordinal), so rows that
arrive in any order within the watermark give the same result, and so does a restart. The state holds waiting events, the last time that each
record was up for each file, the surfacings since the last idle time and the last get of their records; timers end an idle session and,
after keep_ms, the whole state. Later rows than the watermark are dropped by Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import memory
from ..operators.reconcile import unsuppressed

OUT = "session_id string, kind string, memory_id string, file string, ts long"
GRACE_MS, KEEP_MS = 600_000, 604_800_000
#: The state store that the query needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fields(**kinds) -> StructType:
    """A schema without a parser, which workers don't have."""
    return StructType([StructField(k, v) for k, v in kinds.items()])


class Session(StatefulProcessor):
    """One session: events wait for the watermark, then the ledger and the idle rule are applied in order."""

    def __init__(self, grace_ms: int, keep_ms: int) -> None:
        self.grace, self.keep = grace_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        pair, when = _fields(memory_id=StringType(), file=StringType()), _fields(ts=LongType())
        event = _fields(ts=LongType(), ordinal=LongType(), memory_id=StringType(), file=StringType(), kind=StringType())
        self.waiting = handle.getMapState("waiting", event, _fields(n=LongType()))
        self.ledger = handle.getMapState("ledger", pair, when)
        self.open = handle.getMapState("open", pair, when)
        self.gets = handle.getMapState("gets", _fields(memory_id=StringType()), when)
        self.last = handle.getValueState("last", when)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((int(r["ts"]), int(r["ordinal"]), r["memory_id"], r["file"] or "", r["kind"]), (1,))
            self.handle.registerTimer(int(r["ts"]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        due = sorted((tuple(k) for k in self.waiting.keys() if k[0] <= now), key=lambda k: (k[0], k[1], k[4], k[2], k[3]))
        for event in due:
            self.waiting.removeKey(event)
            ts, _, memory_id, file, kind = event
            out += self._idle(key[0], ts - 1)
            if kind == "get":
                known = self.gets.getValue((memory_id,)) if self.gets.containsKey((memory_id,)) else None
                self.gets.updateValue((memory_id,), (max(ts, known[0]) if known else ts,))
            else:
                before = self.ledger.getValue((memory_id, file))[0] if self.ledger.containsKey((memory_id, file)) else None
                self.ledger.updateValue((memory_id, file), (ts,))
                if before is None or ts - before > self.keep:
                    out.append(Row(session_id=key[0], kind="shown", memory_id=memory_id, file=file, ts=ts))
                    if not self.open.containsKey((memory_id, file)):
                        self.open.updateValue((memory_id, file), (ts,))
            self.last.update((ts,))
            self.handle.registerTimer(ts + self.grace)
            self.handle.registerTimer(ts + self.keep + 1)
        out += self._idle(key[0], now)
        self._forget(now)
        return iter(out)

    def _idle(self, session: str, now: int) -> list[Row]:
        """If the session has been idle for the grace by now: its surfacings without a later get are dismissed, and a new stretch begins."""
        if not self.last.exists() or self.last.get()[0] + self.grace > now:
            return []
        got = {k[0]: v[0] for k, v in self.gets.iterator()}
        left = [(k[0], k[1], v[0]) for k, v in self.open.iterator() if got.get(k[0], -1) < v[0]]
        at = self.last.get()[0]
        self.open.clear()
        self.gets.clear()
        self.last.clear()
        return [Row(session_id=session, kind="dismissed", memory_id=m, file=f, ts=at) for m, f, _ in sorted(left)]

    def _forget(self, now: int) -> None:
        """What was up longer ago than keep_ms can't hold back a showing any more."""
        old = [tuple(k) for k, v in self.ledger.iterator() if v[0] + self.keep < now]
        for k in old:
            self.ledger.removeKey(k)


def pointers(edits: DataFrame, memories: DataFrame, scope: DataFrame, dismissed: DataFrame, most: int = 2) -> DataFrame:
    """Edits (session_id, path, ts, ordinal, event_time; a stream or a table) with each active record whose scope names or globs the path and that has
    not been dismissed `most` times for it: kind surface. memories (id, status, version), scope (memory_id, kind, value), dismissed (memory_id, file, count, version)."""
    own = scope.where("kind = 'file'").select("memory_id", "value")
    active = memories.where("status = 'active'").select(F.col("id").alias("memory_id"), "version")
    literal = own.where(~F.col("value").rlike(memory.GLOB)).select("memory_id", F.struct(F.lit("path").alias("kind"), "value").alias("key"), F.lit(None).cast("string").alias("regex"))
    globs = own.join(memory.pattern_index(scope).withColumnRenamed("pattern", "value"), "value").select("memory_id", "key", "regex")
    index = literal.unionByName(globs).join(active, "memory_id")
    keys = F.concat(F.array(F.struct(F.lit("path").alias("kind"), F.col("path").alias("value"))), memory.path_keys("path"))
    met = edits.withColumn("key", F.explode(keys)).join(index, "key").where(F.col("regex").isNull() | F.expr("path rlike regex"))
    rows = met.select("session_id", F.lit("surface").alias("kind"), "memory_id", F.col("path").alias("file"), "version", "ts", "ordinal", "event_time")
    return unsuppressed(rows, dismissed, most).drop("version")


def surfacing(edits: DataFrame, gets: DataFrame, memories: DataFrame, scope: DataFrame, dismissed: DataFrame, grace_ms: int = GRACE_MS, keep_ms: int = KEEP_MS, late: str = "10 minutes") -> DataFrame:
    """session_id, kind (shown or dismissed), memory_id, file, ts over a stream of edits and one of gets (session_id, memory_id, ts, ordinal, event_time). A record is shown
    for a file once in keep_ms; it is dismissed if its session is then idle for grace_ms without a get of it at or after the surfacing. ts of a dismissal
    is the session's last event. Rows without session are left out. A record with several patterns for one path counts once.

    The session's state store is RocksDB (transformWithState needs it)."""
    shown = pointers(edits, memories, scope, dismissed)
    asked = gets.select("session_id", F.lit("get").alias("kind"), "memory_id", F.lit("").alias("file"), "ts", "ordinal", "event_time")
    rows = shown.unionByName(asked).where("session_id is not null and memory_id is not null").withWatermark("event_time", late)
    # The worker that sets up the state on the driver is started apart and may not find this package, so the class goes there whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return rows.groupBy("session_id").transformWithState(Session(grace_ms, keep_ms), OUT, "append", "EventTime")
