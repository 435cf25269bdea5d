"""Stored indexes of patterns and vectors against looking at all pairs."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from loreweave.operators import graph, memory, vectors

SF = "/root/testdata/sf0.01/embeddings.parquet"


def test_patterns_meet_paths_by_keys(spark):
    parts = ["src", "lib", "a.b", "x", "**", "*", "a*b", "{src,lib}", "[ab]c", "foo?", "a**"]
    ends = ["*.ts", "*.{ts,js}", "x", "package.json", "**", "*", "*.test.ts", "{a/b,c}.md", ".env", "f[0-9].py", "*x", "a.b"]
    globs = [*ends, *(f"{a}/{b}" for a in parts for b in ends), *(f"{a}/{b}/{c}" for a, b in itertools.product(["src", "**", "*", "a**", "{src,lib}"], ["x", "**", "a*b"]) for c in ends)]
    dirs = ["", "src/", "lib/", "src/x/", "lib/a.b/", "ac/", "aXb/", "x/src/", "src/x/aXb/", "foo1/", "axx/", "aqb/x/", "a/"]
    names = ["m.ts", "m.js", "x", "package.json", "y.test.ts", "c.md", ".env", "f3.py", "a.b", "xx", "a/b.md", "ax", "a.b/x"]
    paths = spark.createDataFrame([(d + n,) for d in dirs for n in names], "path string")
    scope = spark.createDataFrame([(k % 97, "file", g) for k, g in enumerate(globs)] + [(5, "file", "src/m.ts"), (6, "tag", "**"), (7, "file", None)], "memory_id long, kind string, value string")
    own = scope.where("kind = 'file'")
    every = paths.join(F.broadcast(own), F.lit(True))
    every = every.withColumn("regex", memory.glob_regex("value")).where((F.col("path") == F.col("value")) | F.col("value").rlike(memory.GLOB) & F.expr("path rlike regex"))
    want = {(r.path, r.memory_id, r.value) for r in every.collect()}
    found = memory.scope_matches(paths, scope)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_find_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    v = spark.read.parquet(SF).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    path = str(tmp_path / "i")
    vectors.write_index(v, path)
    assert vectors.read_index(spark, path).count() == v.count()
    exact = {(r.source, r.target) for r in graph.nearest(v, v, 5, -9.0).collect()}
    pairs = lambda df: {(r.source, r.target) for r in df.collect()}
    every = vectors.search(spark, path, v, 5, probes=1000)
    assert pairs(every) == exact
    recall = len(pairs(vectors.search(spark, path, v, 5)) & exact) / len(exact)
    print("recall", recall)
    assert recall >= 0.9
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    edges = {(r.source, r.target) for r in vectors.semantic_edges(spark, path, 2, 0.3, probes=1000).collect()}
    assert edges == {(r.source, r.target) for r in graph.semantic_edges(v, 2, 0.3).collect()}


def test_an_index_is_refreshed_by_content(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(200)] + [(900, None), (901, []), (902, [1.0])]
    frame = lambda x: spark.createDataFrame(x, "id long, vec array<double>")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    vectors.write_index(frame(rows), a, cells=6)
    assert vectors.read_index(spark, a).select("cell").distinct().count() > 3
    later = [(k, v if k % 10 else [float(x) for x in rng.normal(size=8)]) for k, v in rows[:180]] + [(k, [float(x) for x in rng.normal(size=8)]) for k in range(500, 520)]
    new, same = vectors.changes(frame(later), vectors.read_index(spark, a))
    assert (new.count(), same.count()) == (18 + 20, 162)
    vectors.refresh_index(frame(later), a, b)
    assert {(r.id, tuple(r.vec)) for r in vectors.read_index(spark, b).collect()} == {(k, tuple(v)) for k, v in later}
    got = {(r.source, r.target) for r in vectors.search(spark, b, frame(later), 3, probes=6).collect()}
    assert got == {(r.source, r.target) for r in graph.nearest(frame(later), frame(later), 3, -1e9).collect()}


def test_planned_and_written_hops_are_the_same(spark):
    rng = np.random.default_rng(8)
    calls = spark.createDataFrame([(f"k{a}", f"k{b}" if b < 60 else "::x") for a, b in rng.integers(0, 64, (260, 2)).tolist()], "from_key string, to_key string")
    targets = spark.createDataFrame([("k1",), ("k2",), ("k2",), ("none",)], "target string")
    rows = lambda df: {tuple(r) for r in df.select("target", "key", "hop").collect()}
    deep = rows(graph.blast_radius(calls, targets, 50))
    assert rows(graph.blast_radius(calls, targets, 5)) == {r for r in deep if r[2] <= 5} and rows(graph.blast_radius(calls, targets, 0)) == set()
    plan = graph.blast_radius(calls, targets, 3)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString() or "Reused" in plan._jdf.queryExecution().executedPlan().toString()
