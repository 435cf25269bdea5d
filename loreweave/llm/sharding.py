"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is divided into segments; each belongs to the next virtual node clockwise. A row's doc_id puts it into a segment. A
shard takes the rows of its segments in ring order until it is full, and what is left continues clockwise to the next shard with
room. Capacities add up to the number of rows and are at most one apart, so balance is exact; a row moves away from its own
shard only where that is full. Only the counts of segments, whose number grows slowly with the rows, come to the driver; rows find their
place by their rank within the segment. Rows that are equal in all that ranks them are counted before they are dealt out and
spread again at the end, so they don't gather in one task, however many they are.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Segments of the ring at least; a segment has so many rows at most, about, and so many equal rows are spread by one task.
SEGMENTS, VIRTUAL_NODES, SEGMENT_ROWS, SPREAD = 1 << 12, 64, 1_000_000, 100_000


def ring(shards: int, segments: int = SEGMENTS, virtual: int = VIRTUAL_NODES) -> list[int]:
    """The shard that owns each segment: that of the first virtual node at or after its start."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big")
    nodes = sorted((place(s, v), s) for s in range(shards) for v in range(virtual))
    owners, k = [], 0
    for segment in range(segments):
        start = (segment << 64) // segments
        while k < len(nodes) and nodes[k][0] < start:
            k += 1
        owners.append(nodes[k % len(nodes)][1])
    return owners


def allot(counts: dict[int, int], owners: list[int], shards: int) -> list[dict]:
    """Which ranks of each segment go to which shard, and the slot of the first; bounded by the size of the ring."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    pieces, left = [], []

    def take(segment: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard] - used[shard])
        if n:
            pieces.append({"segment": segment, "lo": lo, "hi": lo + n, "shard": shard, "slot0": used[shard]})
            used[shard] += n
        return lo + n

    for segment, n in sorted(counts.items()):
        if (lo := take(segment, 0, n, owners[segment])) < n:
            left.append((segment, lo, n))
    for segment, lo, n in left:
        at = segment
        while lo < n:
            at = (at + 1) % len(owners)
            lo = take(segment, lo, n, owners[at])
    return pieces


def segments_for(rows: int) -> int:
    """How many segments a ring for so many rows has: a power of two."""
    return max(SEGMENTS, 1 << max(0, -(-rows // SEGMENT_ROWS) - 1).bit_length())


def shard(docs: DataFrame, shards: int = 40, segments: int | None = None, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, law ('rows': counts at most one apart), shard, slot
    (gapless from 0 within the shard), grown_shard (null under this law).

    size is the UTF-8 bytes of the text (null: none) plus 16; a null text has the crc32 of an empty one. Rows without doc_id are hashed by
    crc32 and size. Rows of one segment rank by hash, doc_id, crc32 and size; rows equal in all of these differ in nothing that is
    returned but their places, which are neighbours. With
    fewer rows than shards some shards are empty; an empty table gives an empty result. Other columns are ignored.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    h = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"))).otherwise(F.xxhash64("text_crc32", "size"))
    segments = segments or segments_for(docs.count())
    rows = rows.withColumn("h", h).withColumn("segment", F.pmod("h", F.lit(segments)).cast("int"))
    counts = {r.segment: r.n for r in rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = json.dumps(allot(counts, ring(shards, segments, virtual), shards))
    one = docs.sparkSession.range(1).select(F.from_json(F.lit(pieces), "array<struct<segment int, lo long, hi long, shard int, slot0 long>>").alias("p"))
    place = one.select(F.inline("p"))
    equal = rows.groupBy("segment", "h", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("segment").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = equal.withColumn("to", upto).withColumn("from", F.col("to") - F.col("n"))
    # The table of places has a row for each segment and a few more for each full shard.
    met = ranked.join(F.broadcast(place), "segment").where("from < hi and to > lo")
    own = met.select("doc_id", "size", "text_crc32", "shard", F.greatest("from", "lo").alias("a"), F.least("to", "hi").alias("b"), (F.col("slot0") - F.col("lo")).alias("shift"))
    single = own.where("b = a + 1").select("doc_id", "size", "text_crc32", "shard", (F.col("a") + F.col("shift")).alias("slot"))
    many = own.where("b > a + 1").withColumn("a0", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.lit(SPREAD).cast("long"))))
    many = many.withColumn("b0", F.least(F.col("a0") + SPREAD, F.col("b"))).repartition("doc_id", "text_crc32", "size", "a0")
    many = many.withColumn("at", F.explode(F.sequence("a0", F.col("b0") - 1))).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))
    out = single.unionByName(many)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
