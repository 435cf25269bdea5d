"""Usage events kept by a stream: a store to which a repeated batch adds nothing, and that forgets what is past its retention."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

DAY_MS, RETENTION_DAYS = 86_400_000, 90
COLUMNS = "ts long, tool string, dur_ms long, status string, err_class string, err_code string, cache_status string, mode string, result_count long, query_len long, meta string, synthetic int, session_id string"


def _clock() -> int:
    return int(time.time() * 1000)


def fit_calls(events: DataFrame) -> DataFrame:
    """Events in the columns of the store: those that an event lacks are null, tags and messages made fit for a log, unmarked calls are real ones."""
    for field in COLUMNS.split(", "):
        name, kind = field.split(" ")
        events = events.withColumn(name, (F.col(name) if name in events.columns else F.lit(None)).cast(kind))
    if "err_message" in events.columns:
        events = events.withColumn("meta", t.safe_message(F.col("err_message")))
    events = events.withColumns({"err_class": t.safe_tag("err_class"), "err_code": t.safe_tag("err_code"), "synthetic": F.coalesce("synthetic", F.lit(0))})
    keys = [c for c in ("repo_key",) if c in events.columns]
    return events.select(*keys, *(f.split(" ")[0] for f in COLUMNS.split(", ")))


def store_batch(batch: DataFrame, number: int, path: str, now_ms: int, days: int = RETENTION_DAYS) -> None:
    """Writes one numbered batch of events (ts, ..., repo_key) into folders of its day and number, in place of what an earlier try of the same
    number left there; days past the retention go. Events that are past it already are not written."""
    cutoff = now_ms - days * DAY_MS
    rows = fit_calls(batch).where(F.col("ts") >= cutoff).withColumns({"day": F.floor(F.col("ts") / DAY_MS).cast("int"), "batch": F.lit(number)})
    forget(batch.sparkSession, path, cutoff, number)
    rows.write.mode("append").partitionBy("day", "batch", "repo_key").parquet(path)


def forget(spark: SparkSession, path: str, cutoff_ms: int, number: int | None = None) -> list[int]:
    """Deletes the days wholly before cutoff_ms, and with a number what a failed try of that batch has left; the days that went. There is a folder for a
    day, and in it one for a batch: the driver lists the days."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    if not fs.exists(root):
        return gone
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if not name.startswith("day="):
            continue
        day = int(name[4:])
        if (day + 1) * DAY_MS <= cutoff_ms:
            fs.delete(f.getPath(), True)
            gone.append(day)
        elif number is not None:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), f"batch={number}"), True)
    return sorted(gone)


def store_calls(events: DataFrame, path: str, checkpoint: str, days: int = RETENTION_DAYS, clock: Callable[[], int] = _clock):
    """Starts a query that stores all events of a stream that are there now, each exactly once: after a failure Spark repeats the last batch
    with its number and rows, which then takes the place of the first try."""
    write = lambda batch, number: store_batch(batch, number, path, clock(), days)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_calls(spark: SparkSession, path: str, now_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Stored events within the retention, to the millisecond; days are pruned by folder."""
    cutoff = now_ms - days * DAY_MS
    return spark.read.parquet(path).where((F.col("day") >= cutoff // DAY_MS) & (F.col("ts") >= cutoff)).drop("day", "batch")
