"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def apart(table: DataFrame, *columns: str) -> DataFrame:
    """A grouped table dealt by other columns than it was grouped by. A join then deals it anew, and both its sides are plain exchanges, which
    adaptive execution can split where a key is hot; a grouping in the same stage would forbid that."""
    return table.repartition(*columns)


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one other, which itself points to none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Alternates the large-star and small-star steps: each node's larger neighbours, then its smaller ones,
    are tied to the smallest node seen. Nothing is collected: a step is a grouped minimum and a join, whose
    hot nodes Spark can split, and each round ends in a table in the shared folder. Self-loops and repeated
    edges do no harm; no edges give no rows.
    """
    e, _ = cut(edges.where(f"{a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(apart(low, "u", "m"), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low, "u", "m"), "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new, _ = cut(small, "edges")
        discard(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
