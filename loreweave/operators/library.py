"""Passages of documents, full-text and vector retrieval, and their fusion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .search import POOL, _root, full_text, search_index, search_texts, top, write_index  # noqa: F401
from .search import porter as _porter  # noqa: F401
from .search import postings as inverted_index  # noqa: F401

MOST_CHARS, OVERLAP = 1800, 200
RRF, TOP, BOOST, SNIPPET = 60, 8, 0.1, 400
DIM = 384
#: Characters of documents whose passages a task holds before it hands them on.
HELD = 1 << 20
PASSAGE = "doc_id string, ordinal int, heading_path array<string>, text string, line_start int, line_end int"


def _windows(lines: list[tuple[int, str]], most: int, overlap: int) -> list[list[tuple[int, str]]]:
    """Greedy runs of whole lines, each begun by the last lines of the one before; a section that fits stays whole."""
    if sum(len(x) for _, x in lines) + len(lines) - 1 <= most:
        return [lines]
    out, held, size = [], [], 0
    for line in lines:
        if held and size + len(line[1]) + 1 > most:
            out.append(held)
            tail, size = [], 0
            while len(tail) < len(held) and size < overlap:
                tail.insert(0, held[-1 - len(tail)])
                size += len(tail[0][1]) + 1
            held = tail
        held = [*held, line]
        size += len(line[1]) + 1
    return [*out, held] if held else out


def _passages(most: int, overlap: int) -> Callable:
    import re

    heading = re.compile(r"^(#{1,6})\s+(.+?)\s*$")

    frame = lambda rows: pd.DataFrame(rows, columns=["doc_id", "ordinal", "heading_path", "text", "line_start", "line_end"])

    def run(batches):
        for pdf in batches:
            rows, held = [], 0
            for doc_id, body in zip(pdf["doc_id"], pdf["body"], strict=True):
                sections, path, lines = [], [], []
                for n, line in enumerate(re.split("\r?\n", body or ""), 1):
                    if m := heading.match(line):
                        if lines:
                            sections.append(([title for _, title in path], lines))
                        level = len(m[1])
                        path = [x for x in path if x[0] < level] + [(level, m[2])]
                        lines = []
                    lines.append((n, line))
                sections.append(([title for _, title in path], lines))
                k = 0
                for names, own in sections:
                    for w in _windows(own, most, overlap):
                        rows.append((doc_id, k, names, "\n".join(x for _, x in w), w[0][0], w[-1][0]))
                        k += 1
                held += len(body or "")
                if held >= HELD:
                    yield frame(rows)
                    rows, held = [], 0
            yield frame(rows)

    return run


def passages(docs: DataFrame, most: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Passages of documents (doc_id, body): sections under their headings, in windows of at most `most` characters that overlap by
    whole lines of `overlap` characters. Greedy windows depend on all before them, so each document is walked once."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("body", F.lit("")).alias("body")).mapInPandas(_passages(most, overlap), PASSAGE)


def vector_top(vectors: DataFrame, query: list[float], limit: int = POOL) -> DataFrame:
    """(source, id, rank, score): the nearest vectors of each source by dot product."""
    from .memory import dot

    scored = vectors.select("source", "id", dot(F.array(*map(F.lit, query)), F.col("vec")).alias("score"))
    return top(scored, limit)


def rrf(*ranked: DataFrame, k: int = RRF, first: int = 0) -> DataFrame:
    """(source, id, rrf): sums of 1 / (k + rank + first) over rankings (source, id, rank from 0)."""
    both = ranked[0].select("source", "id", "rank")
    for r in ranked[1:]:
        both = both.union(r.select("source", "id", "rank"))
    return both.groupBy("source", "id").agg(F.sum(1 / (F.lit(float(k + first)) + F.col("rank"))).alias("rrf"))


def min_max(scores: DataFrame, column: str, name: str = "norm") -> DataFrame:
    """Adds the column scaled to 0..1 over all rows; a span of 0 counts as 1."""
    span = scores.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = scores.crossJoin(F.broadcast(span))
    return x.withColumn(name, (F.col(column) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)).drop("lo", "hi")


def hybrid(index: DataFrame, vectors: DataFrame | None, query: str, vector: list[float] | None, sources: DataFrame, docs: DataFrame, repo: str | None = None, most: int = TOP, sizes: DataFrame | None = None) -> DataFrame:
    """(source, id, score): full-text and vector rankings fused, scaled, lifted for sources of the same repository and by the document's value; full text alone without a vector.

    sources (source, repo, status), docs (source, id, doc_type, status_header, pinned).
    """
    ok = sources.where("status = 'ok'")
    ranked = [full_text(index, query, sizes=sizes)] + ([vector_top(vectors, vector)] if vectors is not None and vector is not None else [])
    fused = min_max(rrf(*ranked).join(ok.select("source", "repo"), "source"), "rrf")
    own = F.when(F.col("repo") == repo, BOOST).otherwise(0.0) if repo is not None else F.lit(0.0)
    out = fused.join(docs, ["source", "id"])
    score = F.col("norm") + own + t.value_weight("doc_type", "status_header", "pinned")
    return out.select("source", "id", score.alias("score")).orderBy(F.desc("score"), "source", "id").limit(most)


def snippet(text) -> F.Column:
    """400 characters of a passage, with an ellipsis if cut."""
    return F.when(F.length(text) > SNIPPET, F.concat(F.substring(text, 1, SNIPPET), F.lit("…"))).otherwise(F.col(text))


def embed(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """texts (id, text) with vec: trigrams hashed into `dim` places by FNV-1a and scaled to length 1; without trigrams the zero vector. No model is needed, and equal texts have equal vectors."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        import numpy as np

        def one(x: str | None):
            raw, v = np.frombuffer((x or "").lower().encode("utf-32-le"), np.uint32).astype(np.uint64), np.zeros(dim)
            if len(raw) >= 3:
                h = np.full(len(raw) - 2, 2166136261, np.uint64)
                for k in range(3):
                    h = (h ^ raw[k : k + len(h)]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
                v = np.bincount((h % np.uint64(dim)).astype(np.int64), minlength=dim).astype(float)
                v /= np.sqrt(v @ v)
            return v

        return s.map(one)

    return texts.withColumn("vec", run("text"))


def source_status(sources: DataFrame, docs: DataFrame, mtimes: DataFrame) -> DataFrame:
    """(source, docs, stale): documents per source, and those changed or gone since they were indexed. docs (source, path, indexed_ms), mtimes (source, path, mtime_ms)."""
    seen = docs.join(mtimes, ["source", "path"], "left")
    stale = F.col("mtime_ms").isNull() | (F.col("mtime_ms") > F.col("indexed_ms"))
    n = seen.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(stale).alias("stale"))
    return sources.select("source").join(n, "source", "left").select("source", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("stale", F.lit(0)).alias("stale"))


def index_plan(found: DataFrame, manifest: DataFrame, model: str) -> DataFrame:
    """(path, action, old_path): what an incremental run has to do: add, change, remove, rename by content, or everything anew after a change of model."""
    if not manifest.where(F.col("model") != model).isEmpty():
        return found.select("path", F.lit("add").alias("action"), F.lit(None).cast("string").alias("old_path"))
    from .reconcile import diff_files, rename_relink

    change = diff_files(found, manifest)
    of = lambda k, df: df.join(change.where(F.col("change") == k), "path", "left_semi")
    moved = rename_relink(of("removed", manifest), of("added", found))
    plain = change.join(moved.select(F.col("new_path").alias("path")), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    action = F.when(F.col("change") == "added", "add").when(F.col("change") == "removed", "remove").otherwise("change")
    return plain.select("path", action.alias("action"), F.lit(None).cast("string").alias("old_path")).unionByName(moved.select(F.col("new_path").alias("path"), F.lit("rename").alias("action"), "old_path"))
