"""What the operators of this subpackage share: table reads, lineage cuts and file places."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals only: the contracts lower-case A-Z and leave every other letter as it is.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A batch of rows for Python ends after so many bytes.
BATCH_BYTES = 4 << 20
_own_dir: list[str] = []
_places: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once, unless the session says how much that is. Rows may be long: a bound on their number is none."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary one on a local master, whose
    driver and executor are one process; on a cluster that is an error, as its machines don't see each other's folders."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="loreweave-"))
        place = _own_dir[0]
    return place.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, and a lost
    executor costs no more than the tasks that ran on it. metrics are aggregates taken while writing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if metrics:
        seen = Observation()
        df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
        got = seen.get
    else:
        df.write.parquet(path)
        got = {}
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out, got


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut has written. Nothing may be left that reads them: results that are still lazy included."""
    for table_ in tables:
        if path := _places.pop(table_, None):
            jvm = table_.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table_.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number for each row; stable only once the result has been cut."""
    return df.withColumn(name, F.monotonically_increasing_id())
