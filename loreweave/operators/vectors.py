"""A stored index of vectors: cells around centroids, searched by the nearest few and ranked exactly among what they hold.

Centroids are fitted on a bounded sample (SAMPLE vectors, those with the smallest hash of their id), every vector is stored in the cell of its nearest
one. A search reads the cells of the `probes` centroids that suit a query best and ranks their vectors by exact dot products, so similarities are
right and only neighbours in other cells can be missed; with as many probes as cells none is. How many probes the data need is measured when the
index is written: as many as find RECALL of the nearest neighbours within the sample. Clustered vectors need few, noise needs about half the cells. `graph.nearest` and `graph.semantic_edges` are the exact way.
Queries are dealt into parts of bounded size, past which the vectors of the cells that they look into are streamed, so that a cell with a third of all vectors is many tasks. Vectors have one length (others are left
out, as are null ones); of equal similarities the smaller id counts first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pairs

#: Vectors that centroids are fitted on, most centroids, rounds of fitting, and queries of a part at least.
SAMPLE, MOST_CELLS, ROUNDS, BLOCK = 20_000, 4096, 8, 2048
#: The share of neighbours that a search shall find, and the queries of the sample and neighbours of each that it is measured on.
RECALL, ASKED, NEIGHBOURS = 0.95, 1000, 5


def _content(vec: Column) -> Column:
    return F.xxhash64(vec)


def _probes(x: np.ndarray, c: np.ndarray) -> int:
    """Cells that a query has to look into, so that RECALL of the NEIGHBOURS nearest ones of ASKED rows of x, among all of x, are found."""
    own, q = (x @ c.T - (c * c).sum(1) / 2).argmax(1), x[:: max(1, len(x) // ASKED)]
    at = np.arange(len(q)) * max(1, len(x) // ASKED)
    sims = q @ x.T
    sims[np.arange(len(q)), at] = -np.inf
    near = own[np.argsort(-sims, axis=1)[:, : min(NEIGHBOURS, len(x) - 1)]]
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    need = np.sort(np.take_along_axis(rank, near, axis=1).ravel())
    return int(need[min(len(need) - 1, int(RECALL * len(need)))]) + 1 if len(need) else 1


def fit_cells(vectors: DataFrame, cells: int | None = None) -> tuple[np.ndarray, int]:
    """Centroids (cells x length) of a sample of at most SAMPLE vectors (id, vec), which the driver holds, by default about the square root of all,
    at least 1; and how many a query should look into."""
    some = vectors.where("size(vec) > 0").select(F.col("vec").cast("array<double>").alias("vec"), F.xxhash64(F.col("id").cast("string")).alias("h")).orderBy("h", "vec").limit(SAMPLE)
    x = [r["vec"] for r in some.collect()]
    if not x:
        return np.zeros((0, 0)), 1
    x = np.array([v for v in x if len(v) == len(x[0])])
    k = min(cells or max(1, round(vectors.count() ** 0.5)), MOST_CELLS, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(own, minlength=k)
        for z in np.flatnonzero(n):
            c[z] = x[own == z].mean(0)
    return c, _probes(x, c)


def _nearest_cells(c: np.ndarray, most: int, by_dot: bool):
    """The `most` nearest centroids of vectors, or (by_dot) those with the largest dot products, as neighbours are ranked."""
    half = 0 if by_dot else (c * c).sum(1) / 2

    @F.pandas_udf("array<int>")
    def run(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        far = np.stack(vecs.to_numpy()) @ c.T - half
        best = np.argsort(-far, axis=1, kind="stable")[:, :most]
        return pd.Series(list(best.astype(np.int32)))

    return run


def _celled(vectors: DataFrame, c: np.ndarray, most: int, by_dot: bool = False) -> DataFrame:
    """Vectors (id, vec) of the centroids' length with `cells`, the best ones first."""
    fit = vectors.where(F.size("vec") == c.shape[1]).select("id", F.col("vec").cast("array<double>").alias("vec"))
    return fit.withColumn("cells", _nearest_cells(c, most, by_dot)("vec"))


def write_index(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Stores the index of vectors (id, vec): centroids, and the vectors in a folder for each cell."""
    spark, (c, probes) = vectors.sparkSession, fit_cells(vectors, cells)
    spark.createDataFrame([(k, [float(x) for x in v], probes) for k, v in enumerate(c)], "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _write(_celled(vectors, c, 1), path) if len(c) else None


def _write(celled: DataFrame, path: str) -> None:
    rows = celled.select("id", "vec", _content(F.col("vec")).alias("content"), F.element_at("cells", 1).alias("cell"))
    rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    """At most MOST_CELLS rows, and the probes of a query."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return (np.array([r["centre"] for r in rows]), rows[0]["probes"]) if rows else (np.zeros((0, 0)), 1)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec, content, cell) of all stored vectors."""
    return spark.read.parquet(f"{path}/vectors")


def changes(vectors: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors (id, vec) that are new or have other content than the stored ones, and the stored ones that still hold."""
    now = vectors.where("size(vec) > 0").select("id", F.col("vec").cast("array<double>").alias("vec")).withColumn("content", _content(F.col("vec")))
    return now.join(stored, ["id", "content"], "left_anti").select("id", "vec"), stored.join(now, ["id", "content"], "left_semi")


def refresh_index(vectors: DataFrame, path: str, to: str) -> None:
    """The index at `path` brought up to date for vectors (id, vec), stored at `to`: cells are found for new and changed vectors alone, gone ones
    are left out, centroids stay."""
    spark = vectors.sparkSession
    c, _ = _centres(spark, path)
    spark.read.parquet(f"{path}/centres").coalesce(1).write.mode("overwrite").parquet(f"{to}/centres")
    new, same = changes(vectors, read_index(spark, path))
    kept = same.select("id", "vec", F.array("cell").alias("cells"))
    _write(kept.unionByName(_celled(new, c, 1)), to)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, least: float = -1e300, probes: int | None = None) -> DataFrame:
    """(source, target, sim): for each query (id, vec) the k stored vectors with the largest dot products of at least `least` among the cells that it
    looks into, without itself. probes: by default what the index was measured to need."""
    c, enough = _centres(spark, path)
    probes = min(enough if probes is None else probes, len(c))
    stored = read_index(spark, path)
    if not len(c):
        none = queries.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0.0).alias("sim"))
        return none.limit(0)
    near = _celled(queries.where(pairs.sound(F.col("vec"))), c, probes, by_dot=True)
    # Queries with one best cell stand together, so that their part needs few cells; a part has `size` queries, however many a cell has.
    sizes = near.groupBy(F.element_at("cells", 1).alias("first")).agg(F.count(F.lit(1)).alias("n")).orderBy("first").collect()  # MOST_CELLS rows
    size, begun, at = pairs.part_rows(sum(r["n"] for r in sizes), BLOCK), 0, []
    for r in sizes:
        own = -(-r["n"] // size)
        at.append((r["first"], begun // size, own))
        begun = begun + r["n"] if own == 1 else (-(-begun // size) + own) * size
    dealt = F.broadcast(spark.createDataFrame(at, "first int, sup int, own int"))
    asked = near.withColumn("first", F.element_at("cells", 1)).join(dealt, "first").withColumn("sup", F.col("sup") + F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    g, dim = F.lit(0).alias("g"), F.lit(c.shape[1]).alias("dim")
    if probes < len(c):
        needed = asked.select("sup", F.explode("cells").alias("cell")).distinct()
        held = stored.join(F.broadcast(needed), "cell")
    else:
        held = stored.withColumn("sup", F.explode(F.sequence(F.lit(0), F.lit(max((b + n for _, b, n in at), default=1) - 1))))
    cells = c if probes < len(c) else None
    return pairs.met(asked.select(g, dim, "sup", "id", "vec"), held.select(g, dim, "sup", "id", "vec", "cell"), k, least, digits=12, cells=cells, probes=probes)


def semantic_edges(spark: SparkSession, path: str, k: int = 2, least: float = 0.65, probes: int | None = None) -> DataFrame:
    """(source, target, sim): what graph.semantic_edges gives, from a stored index: each stored vector's k most similar ones among `probes` cells (by default what the index was measured to need),
    each unordered pair once, the source being the smaller id of those that have the other among theirs."""
    near = search(spark, path, read_index(spark, path).select("id", "vec"), k, least, probes)
    once = near.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min("source").alias("source"), F.first("sim").alias("sim"))
    return once.select("source", F.when(F.col("source") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("target"), "sim")
