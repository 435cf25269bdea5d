"""The surfacing stream and the stats store: any order of arrival, restarts and repeated batches against loops."""

import random

from pyspark.sql import functions as F

from loreweave.streaming import sink, surfacing

EDIT = "session_id string, path string, ts long, ordinal long"
GET = "session_id string, memory_id string, ts long, ordinal long"


def loop(edits, gets, patterns, suppressed, grace, keep):
    """All events in order, session by session."""
    out, events = [], [(s, t, o, "get", m, "") for s, m, t, o in gets if s]
    for s, p, t, o in edits:
        for m in sorted({m for m, test in patterns if test(p)}):
            if s and (m, p) not in suppressed:
                events.append((s, t, o, "surface", m, p))
    for session in {e[0] for e in events}:
        ledger, first, got, last = {}, {}, {}, None

        def close():
            out.extend((session, "dismissed", m, f, last) for (m, f), t in first.items() if got.get(m, -1) < t)  # noqa: B023
            first.clear()  # noqa: B023
            got.clear()  # noqa: B023

        for _, t, _, kind, m, f in sorted(e for e in events if e[0] == session):
            if last is not None and last + grace < t:
                close()
            if kind == "get":
                got[m] = t
            else:
                if (m, f) not in ledger or t - ledger[m, f] > keep:
                    out.append((session, "shown", m, f, t))
                    first.setdefault((m, f), t)
                ledger[m, f] = t
            last = t
        close()
    return sorted(out)


def test_surfacing_equals_the_loop_in_any_order_and_over_a_restart(spark, tmp_path):
    rng, base = random.Random(4), 1_700_000_000_000
    grace, keep, late = 60_000, 400_000, 200_000
    edits, gets, t = [], [], base
    for n in range(120):
        t += rng.choice([1000, 5000, 5000, 30_000, 90_000])
        s = rng.choice(["a", "b", "c", None])
        if rng.random() < 0.7:
            edits.append((s, rng.choice(["src/x.ts", "src/y.py", "lib/z.ts"]), t, n))
        else:
            gets.append((s, rng.choice(["m1", "m2", "m3"]), t, n))
    memories = spark.createDataFrame([("m1", "active", 1), ("m2", "active", 3), ("m3", "active", 1), ("m4", "trashed", 1)], "id string, status string, version int")
    scope = spark.createDataFrame([("m1", "file", "src/**"), ("m1", "file", "src/x.ts"), ("m2", "file", "**/*.ts"), ("m3", "file", "lib/z.ts"), ("m4", "file", "**")], "memory_id string, kind string, value string")
    dismissed = spark.createDataFrame([("m2", "src/x.ts", 2, 3), ("m1", "src/y.py", 2, 9)], "memory_id string, file string, count long, version int")
    patterns = [("m1", lambda p: p.startswith("src/")), ("m2", lambda p: p.endswith(".ts")), ("m3", lambda p: p == "lib/z.ts")]
    # Arrivals are shuffled within stretches shorter than the watermark's delay; a last event far ahead lets all timers fire.
    arrivals = sorted([("edit", x) for x in edits] + [("get", x) for x in gets], key=lambda x: x[1][2] // 100_000 + rng.random())
    end = [("edit", ("z", "none", t + 10**9, 9999)), ("get", ("z", "none", t + 10**9, 9999))]
    third = len(arrivals) // 3
    batches = [arrivals[:third], arrivals[third : 2 * third], arrivals[2 * third :], end, [(k, (s, p, t + 1, o)) for k, (s, p, t, o) in end]]
    inputs = {k: str(tmp_path / k) for k in ("edit", "get")}
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", surfacing.STORE)
    try:
        for batch in batches:  # each run is a restart from the checkpoint
            for kind, ddl in (("edit", EDIT), ("get", GET)):
                spark.createDataFrame([x for k, x in batch if k == kind], ddl).coalesce(1).write.mode("append").parquet(inputs[kind])
            read = lambda kind, ddl: spark.readStream.schema(ddl).parquet(inputs[kind]).withColumn("event_time", F.timestamp_millis("ts"))
            found = surfacing.surfacing(read("edit", EDIT), read("get", GET), memories, scope, dismissed, grace, keep, f"{late} milliseconds")
            query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("session_id", "kind", "memory_id", "file", "ts").collect() if r.session_id != "z")
    want = loop(edits, gets, patterns, {("m2", "src/x.ts")}, grace, keep)
    assert got == want and {k for _, k, *_ in want} == {"shown", "dismissed"}


def test_a_repeated_batch_adds_nothing_and_old_days_go(spark, tmp_path):
    path, day = str(tmp_path / "calls"), sink.DAY_MS
    now = 200 * day + 5
    rows = [(d * day + k, "recall", "x y" if k else None, "r1") for d in (100, 109, 110, 111, 199) for k in range(3)]
    events = spark.createDataFrame(rows, "ts long, tool string, err_class string, repo_key string")
    sink.store_batch(events, 0, path, 150 * day)
    assert sink.read_calls(spark, path, 150 * day).count() == 15
    sink.store_batch(events, 0, path, 150 * day)
    sink.store_batch(events.limit(4), 1, path, 150 * day)
    sink.store_batch(events.limit(4), 1, path, 150 * day)
    assert sink.read_calls(spark, path, 150 * day).count() == 19
    sink.store_batch(events.limit(0), 2, path, now)
    left = sink.read_calls(spark, path, now)
    assert {r.ts // day for r in left.collect()} == {111, 199} | ({110} if any(r[0] // day == 110 and r[0] >= now - 90 * day for r in rows) else set())
    assert spark.read.parquet(path).select("day").distinct().count() == 3 and sink.forget(spark, path, now - 90 * day) == []
    assert set(left.columns) == {"repo_key", *(c.split(" ")[0] for c in sink.COLUMNS.split(", "))} and {r.synthetic for r in left.collect()} == {0}


def test_a_stream_of_calls_is_stored_once_over_restarts(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("in", "calls", "check"))
    rows = spark.createDataFrame([(k, "recall", k % 7, "r") for k in range(50)], "ts long, tool string, result_count long, repo_key string")
    for part in (rows.where("ts < 20"), rows.where("ts >= 20")):
        part.coalesce(1).write.mode("append").parquet(source)
        sink.store_calls(spark.readStream.schema(rows.schema).parquet(source), path, check, clock=lambda: 1000).awaitTermination()
    assert sorted(r.ts for r in sink.read_calls(spark, path, 1000).collect()) == list(range(50))
