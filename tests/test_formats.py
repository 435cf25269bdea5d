"""Round trips of the data sources, what they check, and restarts of the stream."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from loreweave.sources import formats


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


def frame(spark, n, dim=3):
    return spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") % 5 > 0, F.lit("h")).alias("hash"), F.array(*[(F.col("id") * k / 4).cast("float") for k in range(dim)]).alias("vec"))


def read(spark, folder, model="m"):
    return sorted((r.path, r.hash, tuple(r.vec)) for r in spark.read.format("vector_sidecar").option("model", model).load(folder).collect())


def test_sidecar_round_trip_and_publication(spark, tmp_path):
    folder, rows = str(tmp_path / "s"), frame(spark, 40)
    want = sorted((r.path, r.hash, tuple(r.vec)) for r in rows.collect())
    save = lambda df, mode: df.write.format("vector_sidecar").option("model", "m").mode(mode).save(folder)
    assert read(spark, folder) == []
    save(rows.repartition(3), "overwrite")
    assert read(spark, folder) == want and read(spark, folder, "other") == []
    save(rows.limit(2), "append")
    assert len(read(spark, folder)) == 42
    with pytest.raises(Exception, match="numbers|lengths"):
        save(rows.union(frame(spark, 2, 4)).coalesce(1), "overwrite")
    assert len(read(spark, folder)) == 42  # the failed write has published nothing
    save(rows.limit(0), "overwrite")
    assert read(spark, folder) == []


def test_single_files_are_read_in_ranges_and_checked(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    os.makedirs(folder)
    rows = [(f"p{k}", f"h{k}", (float(k), k / 2)) for k in range(10)]

    def put(data=None, **changed):
        meta = {"modelName": "m", "dim": 2, "count": 10, "entries": [{"path": p, "hash": h} for p, h, _ in rows]} | changed
        with open(f"{folder}/{formats.META}", "w") as f:
            json.dump({k: v for k, v in meta.items() if v is not None}, f)
        with open(f"{folder}/{formats.SINGLE}", "wb") as f:
            f.write(data if data is not None else b"".join(struct.pack("<2f", *v) for *_, v in rows))

    monkeypatch.setattr(formats, "RANGE", 4)
    put()
    reader = formats.SidecarReader(folder, "m")
    assert len(reader.partitions()) == 3 and sorted((p, h, tuple(v)) for part in reader.partitions() for p, h, v in reader.read(part)) == sorted(rows)
    assert read(spark, folder) == sorted(rows)
    for bad, said in ((dict(dim=None), "lacks fields"), (dict(count=9), "entries"), (dict(data=b"x" * 79), "bytes")):
        put(**bad)
        with pytest.raises(formats.CorruptSidecar, match=said):
            formats.SidecarReader(folder, "m").partitions()
    with open(f"{folder}/{formats.META}", "w") as f:
        f.write("{")
    with pytest.raises(Exception, match="no JSON"):
        read(spark, folder)


def test_a_log_is_streamed_once_over_restarts(spark, tmp_path, monkeypatch):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    os.makedirs(source)

    def add(name, text):
        with open(f"{source}/{name}", "a") as f:
            f.write(text)

    def run():
        stream = spark.readStream.format("session_log").load(source)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file, r.at, r.value) for r in spark.read.schema("file string, at long, value string").parquet(out).collect())

    add("a.jsonl", '{"n": 1}\n\n{"n": 2}\n{"n": ')
    add("b.jsonl", "é one\r\ntwo\n")
    assert run() == [("a.jsonl", 0, '{"n": 1}'), ("a.jsonl", 10, '{"n": 2}'), ("b.jsonl", 0, "é one"), ("b.jsonl", 8, "two")]
    add("a.jsonl", "3}\n")
    add("c.jsonl", "new\n")
    assert [(f, v) for f, _, v in run()] == [("a.jsonl", '{"n": 1}'), ("a.jsonl", '{"n": 2}'), ("a.jsonl", '{"n": 3}'), ("b.jsonl", "é one"), ("b.jsonl", "two"), ("c.jsonl", "new")]
    assert len(run()) == 6
    monkeypatch.setattr(formats, "LOG_BYTES", 7)
    reader = formats.LogReader(source)
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) > 4 and sorted(v for p in parts for *_, v in reader.read(p)) == sorted(v for *_, v in run())
