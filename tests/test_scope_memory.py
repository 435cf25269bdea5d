"""Pairs of records that share a scope: what a task holds doesn't grow with a value's records."""

from pyspark.sql import functions as F

from loreweave.operators import graph


def scope_of(spark, n):
    return spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("memory_id"), F.lit("tag").alias("kind"), F.lit("all").alias("value"))


def test_records_are_not_paired_in_the_task_that_joins(spark):
    lines = graph.shared_scope_pairs(scope_of(spark, 10))._jdf.queryExecution().executedPlan().toString().split("\n")
    made = [i for i, x in enumerate(lines) if "Generate explode(b_members" in x]
    assert made
    for i in made:
        below = [x.lstrip(" :+-") for x in lines[i + 1 :]]
        assert next(x for x in below if x.startswith(("Exchange", "SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin"))).startswith("Exchange")


def test_a_block_makes_few_rows(spark):
    assert graph.MEMBERS**2 <= 2**16
    found = graph.shared_scope_pairs(scope_of(spark, 3000)).agg(F.count("weight"), F.sum("weight"), F.sum("source"), F.sum("target"), F.count_if(F.col("source") >= F.col("target"))).first()
    n = 3000
    assert tuple(found) == (n * (n - 1) // 2, n * (n - 1) // 2, sum(i * (n - 1 - i) for i in range(n)), sum(i * i for i in range(n)), 0)
