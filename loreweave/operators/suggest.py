"""Suggestions for a task: the checked call, the memories that go with them, and their quality against known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import library, memory, ranking

MODES, MOST_POOL, TOP = ("fast", "deep", "semantic"), 200, 5


def check(task: str, mode: str = "fast", limit: int = TOP, pool: int = 60) -> None:
    """Raises ValueError for what no ranker takes."""
    whole = lambda n: isinstance(n, int) and not isinstance(n, bool)
    if not task.strip():
        raise ValueError("the task is empty")
    if not whole(limit) or limit < 1:
        raise ValueError("limit has to be a positive integer")
    if not whole(pool) or not 1 <= pool <= MOST_POOL:
        raise ValueError(f"pool has to be an integer from 1 to {MOST_POOL}")
    if mode not in MODES:
        raise ValueError(f"mode has to be one of {', '.join(MODES)}, not {mode!r}")


def anchor_of(files: DataFrame, value: str | None) -> str | None:
    """The file that a caller comes from: slashes forward, without a leading ./ or /; None if there is no such file."""
    if not value:
        return None
    path = value.replace("\\", "/")
    path = path[2:] if path.startswith("./") else path[1:] if path.startswith("/") else path
    return None if files.where(F.col("path") == path).isEmpty() else path


def suggest(store: dict[str, DataFrame], task: str, mode: str = "fast", origin: str | None = None, limit: int = TOP, pool: int = 60, stale: bool = False) -> tuple[DataFrame, dict]:
    """The best `limit` of path, kind, score in a mode, and what was asked: mode, task, origin (null if it is no file), freshness.

    store: files, docs, functions, imports, calls, entry_files, and contents (path, body) for deep, path_vectors (id, vec) and query
    (one row with vec) for semantic.
    """
    check(task, mode, limit, pool)
    origin = anchor_of(store["files"], origin)
    code = [store[k] for k in ("files", "docs", "functions", "imports", "calls", "entry_files")]
    if mode == "fast":
        found = ranking.suggest_fast(*code, task, origin, limit)
    elif mode == "deep":
        found = ranking.suggest_deep(*code, store["contents"], task, origin, limit, pool)
    else:
        query = [float(x) for x in store["query"].first().vec]
        best = library.vector_top(store["path_vectors"].withColumn("source", F.lit("all")), query, limit)
        kind = F.when(F.col("id").rlike(r"\.(md|txt)$"), "doc").otherwise("file")
        found = best.select(F.col("id").alias("path"), kind.alias("kind"), "score")
    return found, {"mode": mode, "task": task, "origin": origin, "freshness": "stale" if stale else "fresh"}


def suggest_with_memories(store: dict[str, DataFrame], task: str, query: list[float], mode: str = "fast", **how) -> tuple[DataFrame, DataFrame, dict]:
    """suggest, and (id, cosine) of the memories that fit its files; none where the results are weak."""
    found, asked = suggest(store, task, mode, **how)
    return found, memory.related(found, mode, store["memories"], store["scope"], store["vectors"], query), asked


def quality(ranked: DataFrame, truth: DataFrame, top: int = TOP) -> DataFrame:
    """(query, hit, precision, recall) of rankings (query, path, rank from 0) against known answers (query, path): whether one is among the
    first `top`, how many are over `top`, and over the answers. A query without results has zeros."""
    first = ranked.where(F.col("rank") < top).select("query", "path").distinct()
    answers = truth.select("query", "path").distinct()
    met = answers.join(first.withColumn("got", F.lit(1)), ["query", "path"], "left").groupBy("query").agg(F.count("got").alias("hits"), F.count(F.lit(1)).alias("n"))
    return met.select("query", (F.col("hits") > 0).cast("int").alias("hit"), (F.col("hits") / top).alias("precision"), (F.col("hits") / F.col("n")).alias("recall"))


def mean_quality(measured: DataFrame) -> DataFrame:
    """One row of means."""
    return measured.agg(*(F.avg(c).alias(c) for c in ("hit", "precision", "recall")))


def ranks(scores: DataFrame) -> DataFrame:
    """(query, path, rank from 0) of scores (query, path, score); ties by path."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "path")
    return scores.select("query", "path", (F.row_number().over(w) - 1).alias("rank"))
