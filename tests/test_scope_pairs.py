"""Pairs of records that share a scope, and how much of them is shuffled."""

import itertools

import pytest
from pyspark.sql import functions as F

from loreweave.operators import graph

SCHEMA = "repo string, memory_id long, kind string, value string"


def shuffled(spark) -> int:
    """Bytes that this session has written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def brute(rows):
    own = {}
    for repo, m, kind, value in rows:
        if None not in (repo, m, kind, value):
            own.setdefault((repo, m), set()).add((kind, value))
    pairs = ((a, b, len(own[a] & own[b])) for a, b in itertools.combinations(sorted(own), 2) if a[0] == b[0])
    return {(a[0], a[1], b[1], n) for a, b, n in pairs if n}


@pytest.mark.parametrize("wide, members, part", [(64, 512, 4096), (3, 2, 5), (0, 1, 1), (1, 3, 1000)])
def test_pairs_as_by_all_pairs(spark, monkeypatch, wide, members, part):
    for name, value in (("WIDE", wide), ("MEMBERS", members), ("PART", part)):
        monkeypatch.setattr(graph, name, value, raising=False)
    rows = [(f"r{m % 2}", m, ("tag", "file")[v % 2], f"v{v}") for m in range(60) for v in range(9) if (m * 7 + v * v) % 5 == 0 or m > 55]
    rows += [("r0", m, "tag", "all") for m in range(0, 60, 2)] + [("r1", m, "tag", "all") for m in range(0, 60, 2)]
    rows += [("r0", 1, "a", "bc"), ("r0", 3, "ab", "c"), ("r0", 5, "a", ""), ("r0", 7, "a", ""), ("r0", 9, "", "a"), ("r0", 70, "tag", "alone"), ("r0", -3, "tag", "v1"), ("r0", -3, "tag", "all")]
    rows += [(None, 1, "tag", "all"), (None, 3, "tag", "all"), ("r0", None, "tag", "all"), ("r0", 11, None, "all"), ("r0", 13, None, "all"), ("r0", 15, "tag", None), ("r0", 17, "tag", None)]
    found = [tuple(r) for r in graph.shared_scope_pairs(spark.createDataFrame(rows * 2, SCHEMA)).select("repo", "source", "target", "weight").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_values_of_more_records_are_left_out_on_demand(spark):
    rows = [("r", m, "tag", "many") for m in range(8)] + [("r", m, "tag", f"few{m % 2}") for m in range(4)]
    found = {tuple(r) for r in graph.shared_scope_pairs(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    assert found == {("r", 0, 2, 1), ("r", 1, 3, 1)}


def test_pairs_are_not_shuffled(spark):
    scope = spark.range(1500).repartition(4).select(F.lit("r").alias("repo"), F.col("id").alias("memory_id"), F.lit("tag").alias("kind"), F.concat(F.lit("v"), (F.col("id") % 2).cast("string")).alias("value"))
    before = shuffled(spark)
    assert graph.shared_scope_pairs(scope).agg(F.count("weight"), F.sum("source"), F.sum("target")).first()[0] == 2 * 750 * 749 // 2
    assert shuffled(spark) - before < 200_000
