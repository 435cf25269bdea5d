"""Lloyd's rounds over integer vectors by kd-tree filtering: exact assignments without a distance for each vector and centroid.

Vectors are put into kd-trees of at most BLOCK vectors, once, each tree a row of a table. A node holds its number of vectors, their
integer sum and their box. In each round all centroids go down each tree: at a node those are pruned that are farther than another one for
every point of the box, strictly, so that ties stay; a node with one centroid left is assigned whole, by its count and sum; what reaches a
leaf is resolved vector by vector. Only sums and counts of each centroid leave a task, and only centroids reach the driver (k x DIMS numbers).

Vectors of another length, with a null, a NaN or an infinite component are left out, null vectors too. Components beyond MOST after scaling
count as MOST (so that every squared distance fits a long). A null vec_id is hashed as no digits; rows of one vec_id are vectors of their own, equal
hashes ordered by their components. With fewer than k vectors there are as many centroids as vectors; an empty table has no rows. A sum of distances
beyond a long is the largest long. Columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, small_batches
from .words import tidied

DIMS, SCALE, MOST = 64, 1024, 1 << 27
#: Vectors of a tree, and the most of a leaf.
BLOCK, LEAF = 8192, 16
#: Up to this size of components products are exact in double precision.
DOUBLE_MOST = 1 << 21


class Tree:
    """A kd-tree over rows of points: node i of level d has the rows from i * n >> d to (i + 1) * n >> d, so ranges need no storage."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, depth: int) -> None:
        self.points, self.low, self.high, self.total, self.depth = points, low, high, total, depth

    @staticmethod
    def ends(n: int, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1, dtype=np.int64) * n >> level

    @staticmethod
    def levels(n: int) -> int:
        depth = 0
        while n >> depth > LEAF:
            depth += 1
        return depth

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the order in which it has the rows."""
        n, order = len(points), np.arange(len(points))
        depth = cls.levels(n)
        for level in range(depth):
            ends, below = cls.ends(n, level), cls.ends(n, level + 1)
            for i in range(1 << level):
                a, b, half = int(ends[i]), int(ends[i + 1]), int(below[2 * i + 1])
                own = points[order[a:b]]
                wide = int(np.argmax(own.max(0) - own.min(0)))
                order[a:b] = order[a:b][np.argpartition(own[:, wide], half - a)]
        points = np.ascontiguousarray(points[order])
        low, high, total = [], [], []
        for level in range(depth + 1):
            first = cls.ends(n, level)[:-1]
            low.append(np.minimum.reduceat(points, first))
            high.append(np.maximum.reduceat(points, first))
            total.append(np.add.reduceat(points.astype(np.int64), first))
        return cls(points, np.concatenate(low), np.concatenate(high), np.concatenate(total), depth), order

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return tuple(x.tobytes() for x in (self.points, self.low, self.high, self.total))

    @classmethod
    def unpack(cls, points: bytes, low: bytes, high: bytes, total: bytes) -> Tree:
        read = lambda x, t: np.frombuffer(x, t).reshape(-1, DIMS)
        rows = read(points, np.int32)
        return cls(rows, read(low, np.int32), read(high, np.int32), read(total, np.int64), cls.levels(len(rows)))

    def filter(self, centroids: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """What centroids get: whole nodes as (level, nodes, centroid of each); rows of open leaves and the centroid of each."""
        k, n = len(centroids), len(self.points)
        kind = np.float64 if max(int(np.abs(self.low[0]).max()), int(np.abs(self.high[0]).max()), int(np.abs(centroids).max())) <= DOUBLE_MOST else np.int64
        c = centroids.astype(kind)
        norm = (c * c).sum(1)
        nodes, left, whole, base = np.zeros(1, np.int64), np.ones((1, k), bool), [], 0
        for level in range(self.depth + 1):
            low, high = self.low[base + nodes].astype(kind), self.high[base + nodes].astype(kind)
            middle = (low + high).astype(np.float64)
            far = np.where(left, norm - middle @ c.T.astype(np.float64), np.inf)
            best = far.argmin(1)
            for s in np.unique(best):
                own = np.flatnonzero(best == s)
                apart = c - c[s]
                # The corner of the box that suits z best against s: if even there s is nearer, z goes.
                corner = high[own] @ np.maximum(apart, 0).T + low[own] @ np.minimum(apart, 0).T
                left[own] &= ~(norm - norm[s] > 2 * corner)
            alone = left.sum(1) == 1
            whole.append((level, nodes[alone], left[alone].argmax(1)))
            nodes, left = nodes[~alone], left[~alone]
            if level < self.depth:
                base += 1 << level
                nodes, left = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(left, 2, axis=0)
        ends = self.ends(n, self.depth)
        size = (ends[1:] - ends[:-1])[nodes]
        rows = np.repeat(ends[:-1][nodes], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        own = self.points[rows].astype(kind)
        gap = norm - 2 * (own @ c.T)
        gap = np.where(np.repeat(left, size, axis=0), gap, np.inf if kind is np.float64 else np.iinfo(np.int64).max)
        return whole, rows, gap.argmin(1) if len(rows) else np.zeros(0, np.int64)

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of each centroid, and their integer sums."""
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), np.int64)
        whole, rows, own = self.filter(centroids)
        for level, nodes, to in whole:
            ends = self.ends(len(self.points), level)
            np.add.at(count, to, ends[nodes + 1] - ends[nodes])
            np.add.at(total, to, self.total[(1 << level) - 1 + nodes])
        np.add.at(count, own, 1)
        for z in np.unique(own):
            total[z] += self.points[rows[own == z]].sum(0, dtype=np.int64)
        return count, total

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each row, and its squared distance."""
        to = np.zeros(len(self.points), np.int64)
        whole, rows, own = self.filter(centroids)
        to[rows] = own
        for level, nodes, cluster in whole:
            ends = self.ends(len(self.points), level)
            for a, b, z in zip(ends[nodes], ends[nodes + 1], cluster, strict=True):
                to[a:b] = z
        gap = self.points.astype(np.int64) - centroids[to]
        return to, (gap * gap).sum(1)


TREE = "points binary, low binary, high binary, total binary"


def integer_vectors(vectors: DataFrame, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """vec_id and v, the components as integers: floor(scale * x)."""
    whole = (F.size("embedding") == dims) & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return vectors.where(whole).select("vec_id", scaled.alias("v"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v) to trees of at most BLOCK of them."""
    names = ["ids", "points", "low", "high", "total"]

    def planted(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        tree, order = Tree.build(np.concatenate(rows))
        own = pa.concat_arrays(ids).take(pa.array(order))
        own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        return pa.RecordBatch.from_arrays([own, *(pa.array([x], pa.binary()) for x in tree.pack())], names)

    ids, rows, held = [], [], 0
    for batch in batches:
        values = batch.column("v")
        own = np.asarray(values.flatten(), np.int32).reshape(-1, DIMS)
        at = 0
        while at < len(own):
            to = min(len(own), at + BLOCK - held)
            ids.append(batch.column("vec_id").slice(at, to - at))
            rows.append(own[at:to])
            held, at = held + to - at, to
            if held == BLOCK:
                yield planted(ids, rows)
                ids, rows, held = [], [], 0
    if held:
        yield planted(ids, rows)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array | None, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values if "ids" in batch.schema.names else None
            yield ids, Tree.unpack(*(batch.column(c)[i].as_py() for c in ("points", "low", "high", "total")))


def _partial(centroids: np.ndarray):
    """Trees to one row for each centroid: its number, how many vectors it got, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), np.int64)
        for _, tree in _read(batches):
            n, s = tree.sums(centroids)
            count, total = count + n, total + s
        got = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(count[got]), pa.array(total[got].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return tidied(run)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _read(batches):
            to, distance = tree.assign(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return tidied(run)


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of seed and vec_id."""
    by = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select("v", by.alias("by")).orderBy("by", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, DIMS)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that counts."""
    spark = vectors.sparkSession
    small_batches(spark)
    kept = integer_vectors(vectors)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    trees, _ = cut(kept.mapInArrow(tidied(_trees), f"ids array<{id_type}>, {TREE}"), "kd-trees")
    centroids = first_centroids(kept, k, seed)
    nodes = trees.select("points", "low", "high", "total")
    for _ in range(rounds if len(centroids) else 0):
        parts = nodes.mapInArrow(_partial(centroids), "cluster int, n long, s array<long>")
        sums = parts.select("cluster", "n", F.posexplode("s").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        moved = centroids.copy()
        for cluster, dim, n, s in sums.collect():  # k x DIMS rows
            moved[cluster, dim] = s // n
        centroids = moved
    found, _ = cut(trees.mapInArrow(_assigned(centroids), f"vec_id {id_type}, cluster int, distance long"), "assigned")
    discard(trees)
    most = F.lit((1 << 63) - 1)
    whole = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole = whole.withColumn("every", F.sum("own").over(Window.partitionBy(F.lit(0))))  # k rows
    hashes = [(z, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for z, c in enumerate(centroids)]
    facts = whole.select("cluster", *[F.least(F.col(a), most.cast("decimal(38,0)")).cast("long").alias(b) for a, b in (("own", "cluster_inertia"), ("every", "inertia"))])
    facts = facts.join(spark.createDataFrame(hashes, "cluster int, centroid_sha256 string"), "cluster")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
