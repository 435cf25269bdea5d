"""Formats of Spark's own reader and writer: vector sidecars, and session logs as a stream.

    spark.read.format("vector_sidecar").option("model", m).load(folder)     (path, hash, vec)
    df.write.format("vector_sidecar").option("model", m).mode("overwrite").save(folder)
    spark.readStream.format("session_log").load(folder)                     (file, at, value)

Folders are opened by the workers themselves, so they have to be mounted at one place on all machines; stores in object storage go by Parquet.

A sidecar is a folder with a description and vectors of four-byte floats. Tasks write parts under names of their own, and the commit replaces the
description, which names them: readers see the old set or the new one, never half of one, and a failed task's part is named nowhere. Three things are
checked before a row is read: the description has its fields, the entries are as many as it says, and each part has their bytes. Sidecars with one
file of vectors and all entries in the description are read as well, in ranges of rows. A missing sidecar, or one of another model, has no rows.

A session log's position is where each file had been read to, in bytes, at the end of a whole line. What is written after it is the next batch;
a line without its end waits.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Names of a sidecar's files.
META, SINGLE = ".vectors.meta.json", ".vectors.bin"
#: Rows of a single file that one task reads, and bytes of a log that one task reads, about.
RANGE, LOG_BYTES = 50_000, 32 << 20


class CorruptSidecar(ValueError):
    pass


@dataclass
class Part(InputPartition):
    file: str
    entries: list | str  # (path, hash) of its rows, or the file that has them
    dim: int
    first: int
    rows: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    dim: int


def _description(folder: str) -> dict | None:
    place = os.path.join(folder, META)
    if not os.path.exists(place):
        return None
    try:
        with open(place, encoding="utf-8") as f:
            meta = json.load(f)
    except ValueError as e:
        raise CorruptSidecar(f"the description is no JSON: {place}") from e
    fit = isinstance(meta, dict) and isinstance(meta.get("dim"), int) and isinstance(meta.get("count"), int) and isinstance(meta.get("entries", meta.get("parts")), list)
    if not fit:
        raise CorruptSidecar(f"the description lacks fields: {place}")
    return meta


def _sized(file: str, rows: int, dim: int) -> None:
    found = os.path.getsize(file) if os.path.exists(file) else -1
    if found != rows * dim * 4:
        raise CorruptSidecar(f"{file} has {found} bytes, not {rows * dim * 4}")


class SidecarReader(DataSourceReader):
    def __init__(self, folder: str, model: str | None) -> None:
        self.folder, self.model = folder, model

    def partitions(self) -> Sequence[InputPartition]:
        meta = _description(self.folder)
        if meta is None or self.model is not None and meta.get("modelName") != self.model:
            return [Part("", [], 0, 0, 0)]
        dim, at = meta["dim"], lambda name: os.path.join(self.folder, name)
        if "parts" in meta:
            if sum(p["rows"] for p in meta["parts"]) != meta["count"]:
                raise CorruptSidecar(f"the parts don't have the {meta['count']} rows of the description: {self.folder}")
            for p in meta["parts"]:
                _sized(at(p["name"] + ".bin"), p["rows"], dim)
            return [Part(at(p["name"] + ".bin"), at(p["name"] + ".json"), dim, 0, p["rows"]) for p in meta["parts"]] or [Part("", [], 0, 0, 0)]
        entries = meta["entries"]
        if len(entries) != meta["count"]:
            raise CorruptSidecar(f"{len(entries)} entries, not the {meta['count']} of the description: {self.folder}")
        if not os.path.exists(at(SINGLE)):
            return [Part("", [], 0, 0, 0)]
        _sized(at(SINGLE), meta["count"], dim)
        return [Part(at(SINGLE), [(e.get("path"), e.get("hash")) for e in entries[k : k + RANGE]], dim, k, len(entries[k : k + RANGE])) for k in range(0, len(entries), RANGE)] or [Part("", [], 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.rows:
            return
        entries = partition.entries
        if isinstance(entries, str):
            with open(entries, encoding="utf-8") as f:
                entries = [tuple(x) for x in json.load(f)]
            if len(entries) != partition.rows:
                raise CorruptSidecar(f"{partition.file} has {len(entries)} entries, not {partition.rows}")
        with open(partition.file, "rb") as f:
            f.seek(partition.first * partition.dim * 4)
            for path, digest in entries:
                yield path, digest, list(struct.unpack(f"<{partition.dim}f", f.read(partition.dim * 4)))


class SidecarWriter(DataSourceWriter):
    def __init__(self, folder: str, model: str, overwrite: bool) -> None:
        self.folder, self.model, self.overwrite = folder, model, overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        name, entries, dim = f"part-{uuid.uuid4().hex}", [], 0
        with open(os.path.join(self.folder, name + ".bin"), "wb") as f:
            for row in iterator:
                vec = row["vec"]
                dim = dim or len(vec)
                if len(vec) != dim:
                    raise ValueError(f"vectors of {dim} and of {len(vec)} numbers")
                f.write(struct.pack(f"<{dim}f", *vec))
                entries.append((row["path"], row["hash"]))
        with open(os.path.join(self.folder, name + ".json"), "w", encoding="utf-8") as f:
            json.dump(entries, f)
        return Written(name, len(entries), dim)

    def commit(self, messages: list) -> None:
        os.makedirs(self.folder, exist_ok=True)
        parts = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.rows]
        dims = {m.dim for m in messages if m is not None and m.rows}
        old = None if self.overwrite else _description(self.folder)
        if old is not None:
            if "parts" not in old or old.get("modelName") != self.model:
                raise ValueError("only a sidecar of the same model that was written in parts can be added to")
            parts, dims = old["parts"] + parts, dims | ({old["dim"]} if old["parts"] else set())
        if len(dims) > 1:
            raise ValueError(f"vectors of several lengths: {sorted(dims)}")
        meta = {"modelName": self.model, "dim": max(dims, default=0), "count": sum(p["rows"] for p in parts), "parts": parts}
        fresh = os.path.join(self.folder, f"{META}.{uuid.uuid4().hex}")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(meta, f)
        os.replace(fresh, os.path.join(self.folder, META))

    def abort(self, messages: list) -> None:
        for m in messages:
            for end in (".bin", ".json") if m is not None else ():
                if os.path.exists(place := os.path.join(self.folder, m.name + end)):
                    os.remove(place)


class VectorSidecar(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_sidecar"

    def schema(self) -> str:
        return "path string, hash string, vec array<float>"

    def _folder(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema) -> DataSourceReader:
        return SidecarReader(self._folder(), self.options.get("model"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SidecarWriter(self._folder(), self.options.get("model", ""), overwrite)


@dataclass
class Lines(InputPartition):
    file: str
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: end for f in sorted(os.listdir(self.folder)) if not f.startswith((".", "_")) and (end := _whole(os.path.join(self.folder, f)))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for f, to in end.items():
            at, place = start.get(f, 0), os.path.join(self.folder, f)
            while at < to:
                with open(place, "rb") as log:  # to the end of the line that a task's share ends in
                    log.seek(min(to, at + LOG_BYTES) - 1)
                    log.readline()
                    cut = min(log.tell(), to)
                out.append(Lines(place, at, cut))
                at = cut
        return out

    def read(self, partition: Lines) -> Iterator[tuple]:
        with open(partition.file, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text.strip():
                    yield os.path.basename(partition.file), at, text
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def _whole(file: str) -> int:
    """Bytes of a file up to the end of its last whole line."""
    at = os.path.getsize(file)
    with open(file, "rb") as f:
        while at > 0:
            step = min(at, 1 << 16)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return 0


class SessionLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options["path"].removeprefix("file://"))


def register(spark: SparkSession) -> None:
    """Makes both formats known. Spark asks for partitions in a process that may not find this package, so the classes go there whole."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(VectorSidecar)
    spark.dataSource.register(SessionLog)
