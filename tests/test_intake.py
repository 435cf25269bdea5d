"""Intake in rounds against a loop over all captures."""

import math

import numpy as np
from pyspark.sql import functions as F

from loreweave.operators import history, intake, library, memory
from loreweave.functions import rules

POINT = "place long, tags array<string>, vec array<double>, copy string"


def cosine(a, b):
    return round(float(np.dot(a, b)) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b)) + 1e-9), 12)


def loop(points, known, least):
    """points and known: (place, tags, vec). Place of what each point follows, None for leaders."""
    there, out = sorted(known), {}
    for place, tags, vec in sorted(points):
        near = [(-cosine(vec, v), p) for p, own, v in there if set(own) & set(tags)]
        near = [x for x in near if -x[0] >= least]
        out[place] = min(near)[1] if near else None
        if not near:
            there.append((place, tags, vec))
    return out


def test_leaders_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(intake, "BLOCK", 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    tags = lambda: sorted({f"t{x}" for x in rng.integers(0, 5, rng.integers(0, 4))} | ({"hot"} if rng.random() < 0.4 else set()))
    vec = lambda: [float(x) for x in np.round(centres[rng.integers(12)] + rng.normal(size=6) * 0.35, 3)]
    points = [(int(k), tags(), vec()) for k in rng.permutation(220)]
    points += [(1000 + k, points[k % 30][1], points[k % 30][2]) for k in range(60)]  # copies
    known = [(-100 + k, tags(), vec()) for k in range(15)] + [(-50, ["hot"], [0.0] * 6)]
    frame = lambda rows: spark.createDataFrame([(p, t, v, str((t, v))) for p, t, v in rows], POINT)
    for least in (0.8, 0.97):
        got = {r.place: r.to for r in intake.leaders(frame(points), frame(known), least).collect()}
        want = loop(points, known, least)
        assert got == want and len(set(want.values())) > 10
    assert intake.leaders(frame([]), frame(known), 0.8).count() == 0
    assert {r.to for r in intake.leaders(frame(points[:5]), frame([]), 2.0).collect()} == {None}


def test_a_run_equals_the_loop_and_loses_nothing(spark):
    said = ["We always use tabs in the parser because spaces broke the build last week", "please always use tabs in the parser because spaces broke the build last week!", "ok", "never merge the billing branch before the nightly job has finished its work", "instead never merge the billing branch before the nightly job has finished", "what is this?"]
    rows = [(s, 2 * k, "user", said[(s * 5 + k) % len(said)] + (" extra" * (s % 2))) for s in range(6) for k in range(5)] + [(s, 2 * k + 1, "assistant", f"done {s}") for s in range(6) for k in range(3)]
    turns = spark.createDataFrame(rows, "session long, turn long, role string, text string")
    memories = spark.createDataFrame([("old", "capture", "candidate", ["parser", "tabs"]), ("gone", "capture", "trashed", ["parser"]), ("other", "gotcha", "active", ["parser"])], "id string, type string, status string, tags array<string>")
    vectors = library.embed(memories.select("id", F.lit("We always use tabs in the parser because spaces broke\n\n" + said[0]).alias("text"))).select("id", "vec")
    for least, low in ((0.7, False), (0.9, True)):
        run = intake.intake(turns, memories, vectors, least, low)
        got = {(r.session, r.turn): (r.route, r.id) for r in run.outcomes.collect()}
        prompts = history.prompts(turns).withColumns({"rule": rules.structural_reject("text"), "tier": rules.capture_tier("text")}).collect()
        assert set(got) == {(p.session, p.turn) for p in prompts}
        mine = {(r.session, r.turn): r for r in run.created.collect()}
        texts = {(p.session, p.turn): p for p in prompts}
        own = lambda r: f"{memory_title(spark, r)}\n\n{body(r)}"
        keys = sorted(k for k, p in texts.items() if p.rule is None and not (low and p.tier == "low"))
        frame = spark.createDataFrame([(n, own(texts[k]), texts[k].text) for n, k in enumerate(keys)], "id long, text string, body string")
        vecs = {r.id: r.vec for r in library.embed(frame).collect()}
        tags = {n: [] for n in range(len(keys))}
        for r in memory.extract_tags(frame).collect():
            tags[r.id].append(r.tag)
        want = loop([(n, tags[n], vecs[n]) for n in range(len(keys))], [(-1, ["parser", "tabs"], {r.id: r.vec for r in vectors.collect()}["old"])], least)
        ids = {n: got[k][1] for n, k in enumerate(keys)} | {-1: "old"}
        for n, k in enumerate(keys):
            assert got[k][0] == ("create" if want[n] is None else "append"), (k, texts[k].text)
            assert (k in mine) == (want[n] is None) and (want[n] is None or got[k][1] == ids[want[n]])
        routes = [r for r, _ in got.values()]
        assert "append" in routes and "create" in routes and routes.count("reject") > 0 and (routes.count("discard") > 0) <= low
        assert run.evidence.count() == len(routes) - routes.count("reject") and run.discarded.count() == routes.count("discard")


def body(p):
    return p.text if p.snippet is None else f"{p.text}\n\n_Acknowledged:_ {p.snippet}"


def memory_title(spark, p):
    from loreweave.functions import text as t

    return spark.range(1).select(t.capture_title(F.lit(p.text), F.lit(body(p))).alias("x")).first().x
