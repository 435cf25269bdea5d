"""WARC archives: written as whole-file gzip streams, normalised to one member per record with an index, read back.

Archives are files in a shared folder, opened through pyarrow's file systems (local, HDFS and object stores). A task
writes under a name of its own attempt, and only names that reach the manifest table count, so a task that ran twice
or was lost leaves an unused file and nothing else.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, small_batches

#: An archive is closed after so many bytes of payload, and streams are read in parts of so many.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 1 << 20
LEVEL = 1
#: Revisits go to every task if there are so many at most (about 100 bytes each); beyond, they meet the pages by a shuffle.
BROADCAST_ROWS = 200_000
#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One uncompressed WARC record: a response with its payload, or a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(stream: io.IOBase) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or many members, in parts."""
    z = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            if part := z.decompress(data, READ_BYTES):
                yield part
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    if tail := z.flush():
        yield tail


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, block and the whole bytes of each record; no more than one record and a part are held."""
    held = bytearray()

    def more(n: int) -> bool:
        while len(held) < n:
            if (part := next(parts, None)) is None:
                return False
            held.extend(part)
        return True

    while True:
        seen = 0
        while (cutoff := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more(seen + 1):
                if held.strip():
                    raise ValueError("a WARC stream ends inside a record")
                return
        lines = held[:cutoff].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:60]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        end = cutoff + 4 + size + 4
        if not more(end):
            raise ValueError("a WARC stream ends inside a record")
        yield headers, bytes(held[cutoff + 4 : end - 4]), bytes(held[:end])
        del held[:end]


def _write(folder: str, date: str):
    def run(batches):
        done, out, z, size, path, n = [], None, None, 0, "", 0

        def close():
            nonlocal out
            out.write(z.flush())
            out.close()
            done.append((path, n, size))
            out = None

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    system, place = _open(folder)
                    system.create_dir(place)
                    path, z, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                    out = system.open_output_stream(_open(path)[1], compression=None)
                payload = html.encode()
                out.write(z.compress(record(page_id, url, payload, digest, refers_to, date)))
                size, n = size + len(payload), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([{"path": p, "records": k, "payload_bytes": s} for p, k, s in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64())]))

    return run


def _normalise(folder: str):
    def run(batches):
        for batch in batches:
            done = []
            for source in batch.column("path").to_pylist():
                system, place = _open(source)
                target, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                own, own_place = _open(target)
                own.create_dir(own_place.rpartition("/")[0])
                index: list[str] = []
                with system.open_input_stream(place, compression=None) as stream, own.open_output_stream(own_place, compression=None) as out:
                    for headers, _, whole in records(inflate(stream)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        index.append(json.dumps({"offset": at, "length": len(member), "id": headers["WARC-Record-ID"], "type": headers["WARC-Type"], "uri": headers["WARC-Target-URI"]}))
                        at += len(member)
                with own.open_output_stream(f"{own_place}.idx", compression=None) as out:
                    out.write("\n".join(index).encode())
                done.append({"path": target, "index_path": f"{target}.idx", "records": len(index)})
            yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("index_path", pa.string()), ("records", pa.int64())]))

    return run


def _read(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path, index_path in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
            system, place = _open(path)
            with system.open_input_stream(_open(index_path)[1], compression=None) as stream:
                index = [json.loads(x) for x in stream.read().decode().split("\n") if x]
            rows = []
            with system.open_input_file(place) as file:
                for entry in index:
                    file.seek(entry["offset"])
                    headers, block, _ = next(records(iter([zlib.decompress(file.read(entry["length"]), 31)])))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    number = lambda name: int(headers[name]) if headers.get(name) else None  # noqa: E731, B023
                    rows.append((number("X-Page-ID"), size if revisit else len(payload), digest, headers["WARC-Type"], number("X-Refers-To-Page")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100, date: str = "2024-01-31T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) to whole-file gzip archives; returns the manifest (path, records, payload_bytes).

    Of rows with equal payloads of `least` bytes or more, those with the smallest page_id are responses, the others revisit
    it. A null html is an empty payload, a null url an empty target, a row without page_id a response. Repeated rows give a
    record each. An empty table gives no archives. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    folder = folder or scratch(pages.sparkSession, "warc")
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # Only (page_id, digest) are grouped; the pages themselves meet their answer by page_id, a key without hot values.
    light = pages.where(f"octet_length(html) >= {least}").select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    again = light.join(first, "digest").where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct()
    again, got = cut(again, "warc-revisits", n=F.count(F.lit(1)))
    if got["n"] <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = pages.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return cut(rows.mapInArrow(_write(folder, date), "path string, records long, payload_bytes long"), "warc-manifest")[0]


def _each(archives: DataFrame) -> DataFrame:
    """A task for each archive: a lost executor costs the archives it was at."""
    n = archives.count()
    return archives.repartition(n) if n > 1 else archives


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """Inflates each archive (path) once, rewrites every record as its own gzip member and writes an index of offsets beside
    it; returns path, index_path, records. No more than a record is held. A broken stream fails the task."""
    folder = folder or scratch(archives.sparkSession, "warc-members")
    return cut(_each(archives.select("path")).mapInArrow(_normalise(folder), "path string, index_path string, records long"), "warc-index")[0]


def read_archives(archives: DataFrame) -> DataFrame:
    """Reads every record through its index: page_id, payload_bytes, payload_digest (recomputed where the payload is there),
    record_type, refers_to."""
    return _each(archives.select("path", "index_path")).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
