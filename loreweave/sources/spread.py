"""Parallelism over small tables, and a setting that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table is dealt out anew only if it has less than this for each core.
BYTES_EACH = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if by Spark's estimate it is so small that it may lie in fewer row groups than there are cores: a row group is read by
    one task. Larger tables stay as they are, without a shuffle. For work that costs more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * BYTES_EACH else df


def safe_unions(spark: SparkSession) -> None:
    """Takes a union as dealt out by no key, unless the session says otherwise. Spark 4.1 may take the union of two sides with one key as dealt out by
    it and leave out the shuffle that follows; where adaptive execution has then planned the sides anew (one by broadcast, partitions joined), rows of
    one key are in several tasks. Seen in `lifecycle.apply` on 10,000 records, whose states were in other tasks than their commands."""
    key = "spark.sql.unionOutputPartitioning"
    if key not in spark.conf.getAll:
        spark.conf.set(key, "false")
