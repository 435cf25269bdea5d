"""Scans, logs and stores on small files."""

import json

from pyspark.sql import functions as F

from loreweave.sources import files
from loreweave.streaming import events


def test_scan_and_documents(spark, tmp_path):
    for name, data in {"a/readme.md": b"# Title\nbody", "a/node_modules/x.md": b"no", "b/plan.md": b"plan", "b/my_secret.md": b"secret", "b/bin.txt": b"a\x00b", "b/latin.txt": b"\xff\xfe", "b/big.txt": b"x" * 50, "b/code.ts": b"let x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    scanned = files.scan(spark, str(tmp_path))
    docs, skipped = files.documents(scanned, most=40)
    assert {r.path for r in docs.collect()} == {"a/readme.md", "b/plan.md"}
    assert {tuple(r) for r in skipped.collect()} == {("b/bin.txt", "binary"), ("b/latin.txt", "non-utf8"), ("b/big.txt", "oversize")}
    assert "b/my_secret.md" in {r.path for r in files.documents(scanned, include="my_")[0].collect()}
    top = files.load_docs(docs).collect()
    assert [(r.path, r.title) for r in top] == [("a/readme.md", "Title"), ("b/plan.md", "b/plan.md")]
    assert files.texts(scanned).count() == 6  # all but the file that is no UTF-8


def test_transcripts(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "first"}},
        "{broken",
        {"type": "assistant", "turn": 4, "message": {"role": "assistant", "content": [{"type": "text", "text": "hello"}, {"type": "tool_use", "name": "Read", "input": {"path": "x"}}]}},
        {"type": "user", "isSidechain": True, "message": {"role": "user", "content": "side"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "other dialect"}},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    rows = files.transcripts(files.numbered_lines(spark, str(tmp_path))).orderBy("turn").collect()
    assert [(r.session, r.turn, r.role, r.text) for r in rows] == [("s1", 0, "user", "first"), ("s1", 3, "user", "other dialect"), ("s1", 4, "assistant", "hello")]
    assert rows[2].tool_uses[0].name == "Read" and json.loads(rows[2].tool_uses[0].args) == {"path": "x"}


def test_records_round_trip(spark):
    one = [("m1", "decision", "active", 'A "title": x', 3, "2024-01-01", "2024-01-02", "explicit", 0.5, True, ["a", "b"], [], "text\n---\nmore")]
    df = spark.createDataFrame(one, files.MEMORY)
    out = files.memory_markdown(files.memory_export(df).select(F.col("value").alias("body")))
    assert out.collect() == df.collect()
    assert files.memory_markdown(spark.createDataFrame([("no header",), (None,)], "body string")).count() == 0
    listed = files.memory_markdown(spark.createDataFrame([("---\nid: x\ntags:\n  - one\n  - two\nfiles: [src/a.ts, 'b']\n---\nB",)], "body string")).first()
    assert listed.tags == ["one", "two"] and listed.files == ["src/a.ts", "b"] and listed.body == "B"


def test_stores_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("0" * 16, 1), ("global", 2), ("other", 3)], "repo_key string, v int")
    files.write_store(df, str(tmp_path / "s"))
    files.write_store(spark.createDataFrame([("global", 9)], "repo_key string, v int"), str(tmp_path / "s"))
    assert {r.v for r in files.read_store(spark, str(tmp_path / "s")).collect()} == {1, 9, 3} and files.read_store(spark, str(tmp_path / "s"), "global").first().v == 9
    assert {r.repo_key for r in files.stores(df).collect()} == {"0" * 16, "global"}
    s = spark.createDataFrame([("a", "/x"), ("b", "/y")], "source string, root string")
    out, overlap = files.register_source(s, spark.createDataFrame([("b", "/x/z")], "source string, root string"))
    assert out.count() == 2 and tuple(overlap.first()) == ("a", "b")
    spark.createDataFrame([("m", [1.0, 2.0]), ("m", [1.0]), ("n", [1.0, 2.0])], "model string, vec array<float>").write.parquet(str(tmp_path / "v"))
    assert files.vectors(spark, str(tmp_path / "v"), "m", 2).count() == 1
    m = files.manifests(spark.createDataFrame([("package.json", '{"name": "x", "dependencies": {"next": "1"}, "devDependencies": {"electron": "2"}}')], "path string, body string")).first()
    assert (m.name, m.framework) == ("x", "electron")


def test_streams(spark, tmp_path):
    rows = [(f"s{k % 2}", "f", "m", "a", "ok" if k % 3 else "error", k) for k in range(12)]
    df = spark.createDataFrame(rows, "session_id string, file string, memory_id string, tool string, status string, k int").withColumn("event_time", F.timestamp_millis(F.col("k") * 600_000))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("kpi", events.kpi_windows(stream, "1 hour", "1 hour")), ("seen", events.first_surfacings(stream))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "seen" else "complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("seen").count() == 2
    assert {(r.n, r.errs) for r in spark.table("kpi").collect()} == {(6, 2)}
