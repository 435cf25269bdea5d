"""The most similar vectors of groups against a loop, and how many rows are shuffled for them."""

import math

import numpy as np
import pytest

from loreweave.operators import graph, intake, memory, pairs, vectors


def shuffled(spark, df):
    """Rows that a result's stages write for others."""
    sc = spark.sparkContext

    def so_far():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = so_far()
    rows = df().collect()
    return rows, so_far() - before


def unit(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return [[float(v) for v in r] for r in x / np.sqrt((x * x).sum(1))[:, None]]


@pytest.mark.parametrize("cosine", [False, True])
def test_the_best_of_groups_equal_the_loop(spark, monkeypatch, cosine):
    monkeypatch.setattr(pairs, "STREAM", 7)
    monkeypatch.setattr(pairs, "ROWS", 5)
    rng = np.random.default_rng(2)
    vec = [[float(x) for x in np.round(v, 1)] for v in rng.normal(size=(70, 4))]
    vec = [vec[3] if k % 5 == 0 else v for k, v in enumerate(vec)] + [[math.nan, 1.0, 0.0, 0.0], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0], [], None]
    rows = [("ab"[k % 2] if k % 11 else "c", k, v) for k, v in enumerate(vec)] + [(None, 900, vec[1])]
    frame = spark.createDataFrame(rows, "g string, id long, vec array<double>")
    fine = [(g, i, v) for g, i, v in rows if g and v and None not in v]

    def sim(a, b):
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        return dot / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) + 1e-9) if cosine else dot

    for earlier in (False, True):
        want = []
        for g, i, v in fine:
            near = [(sim(v, w), j) for h, j, w in fine if g == h and i != j and len(v) == len(w) and (j < i or not earlier)]
            near = sorted((-math.inf if math.isnan(s) else -s, j) for s, j in near if math.isnan(s) or s >= 0.2)[:3]
            want += [(i, j) for _, j in near]
        got = [(r.source, r.target) for r in pairs.best(frame, frame, 3, 0.2, cosine, earlier, part=9).collect()]
        assert sorted(got) == sorted(want) and len(want) > 100


def test_records_of_a_tag_are_not_shuffled_as_pairs(spark):
    n, vec = 300, unit(300, 8, 1)
    rows = [(k, "gotcha", "active", ["hot", "hot", f"t{k % 3}"], v) for k, v in enumerate(vec)]
    m = spark.createDataFrame(rows, "id long, type string, status string, tags array<string>, vec array<double>")
    got, moved = shuffled(spark, lambda: memory.dedup_target(m.withColumnRenamed("id", "new_id"), m.drop("vec"), m.select("id", "vec"), -1.0))
    x = np.array(vec)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    assert {(r.new_id, r.id) for r in got} == {(k, int(sims[k].argmax())) for k in range(n)} and moved < 20 * n


def test_all_pairs_give_few_rows(spark):
    n = 2000
    frame = spark.createDataFrame(list(enumerate(unit(n, 8, 4))), "id long, vec array<double>")
    got, moved = shuffled(spark, lambda: graph.semantic_edges(frame, 2, 0.3))
    assert len(got) > n / 2 and moved < 9 * n


@pytest.mark.parametrize("probes", [4, 1000])
def test_a_query_is_not_shuffled_for_each_cell(spark, tmp_path, monkeypatch, probes):
    n, vec = 900, unit(900, 8, 5)
    frame = spark.createDataFrame(list(enumerate(vec)), "id long, vec array<double>")
    vectors.write_index(frame, str(tmp_path / "i"))
    got, moved = shuffled(spark, lambda: vectors.search(spark, str(tmp_path / "i"), frame, 2, -2.0, probes))
    assert len(got) == 2 * n and moved < 9 * n
    # Of other sizes of parts the result is the same: a query looks into its own cells, whatever its part needs.
    monkeypatch.setattr(vectors, "BLOCK", 37)
    again = vectors.search(spark, str(tmp_path / "i"), frame, 2, -2.0, probes).collect()
    assert {(r.source, r.target) for r in again} == {(r.source, r.target) for r in got}
    c, _ = vectors._centres(spark, str(tmp_path / "i"))
    x = np.array(vec)
    looks = np.argsort(np.argsort(-(x @ c.T), axis=1, kind="stable"), axis=1) < probes
    own = {r.id: r.cell for r in vectors.read_index(spark, str(tmp_path / "i")).collect()}
    sims = np.where(looks[:, [own[k] for k in range(n)]], x @ x.T, -9)
    np.fill_diagonal(sims, -9)
    assert {(r.source, r.target) for r in got} == {(k, int(j)) for k in range(n) for j in np.argsort(-sims[k])[:2] if sims[k, j] > -9}


def test_captures_of_a_tag_are_shuffled_once_for_a_part(spark):
    n = 1600
    frame = spark.createDataFrame([(k, ["hot"], v) for k, v in enumerate(unit(n, 8, 6))], "place long, tags array<string>, vec array<double>")
    got, moved = shuffled(spark, lambda: intake.nearest_before(frame, frame, 0.9))
    assert 0 < len(got) < n and all(r.to < r.place for r in got) and moved < 5 * n
