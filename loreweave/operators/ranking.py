"""Ranking of files and documents for a task: token overlap, imports, calls, fuzzy tokens and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from .graph import cut

FUNCTION_CAP, TRIGRAM_WEIGHT, CONTENT_PER_TOKEN, CONTENT_CAP, LEAST_OVERLAP = 12, 4.0, 3, 9, 0.4
MOST_BYTES, MOST_HITS, SNIPPET = 500_000, 3, 160


def task_tokens(spark, task: str) -> list[str]:
    """Tokens of a task; a plan's parameter."""
    return spark.range(1).select(t.tokenize_task(F.lit(task)).alias("t")).first().t


def token_forms(spark, tokens: list[str]) -> dict[str, list[str]]:
    """Each task token with the words whose singular it is."""
    if not tokens:
        return {}
    return {r.t: r.f for r in spark.range(1).select(F.explode(_literal(tokens)).alias("t")).select("t", t.plural_forms("t").alias("f")).collect()}


def _met(side: DataFrame) -> DataFrame:
    """A side that grows with the files, joined by a shuffle: Spark takes packed columns and exploded tokens for a few megabytes and would send
    those of a million files through the driver."""
    return side.hint("merge")


def _literal(tokens: list[str]) -> Column:
    return F.array(*map(F.lit, tokens)).cast("array<string>")


def _held(of: Column | str, forms: dict[str, list[str]]) -> Column:
    """How many of the task's tokens a value has."""
    return sum((t.holds_token(of, k, f).cast("int") for k, f in forms.items()), F.lit(0))


def connected_files(calls: DataFrame) -> DataFrame:
    """(file, other) for files that call each other, both ways; unresolved and inner calls are no connection."""
    pairs = calls.where(~F.col("to_key").startswith("::")).select(t.key_file("from_key").alias("a"), t.key_file("to_key").alias("b")).where("a != b")
    return pairs.select(F.col("a").alias("file"), F.col("b").alias("other")).union(pairs.select("b", "a")).distinct()


def fan_in(calls: DataFrame) -> DataFrame:
    """(file, fan_in): the most distinct callers that one resolved target of the file has."""
    counts = calls.where(~F.col("to_key").startswith("::")).groupBy("to_key").agg(F.count_distinct("from_key").alias("n"))
    return counts.groupBy(t.key_file("to_key").alias("file")).agg(F.max("n").alias("fan_in"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (from_path, to_path) whose target is exactly one file: equal, equal without extension, or its /index."""
    p = t.normalise_path("path")
    stem = t.strip_extension(p)
    keys = files.select("path", F.explode(F.array_distinct(F.array_compact(F.array(p, stem, F.when(stem.endswith("/index"), F.regexp_replace(stem, "/index$", "")))))).alias("key"))
    one = keys.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target")).where("n = 1").select("key", "target")
    return imports.join(_met(one), t.normalise_path(imports.to_path) == one.key).drop("key")


def fast_scores(files: DataFrame, docs: DataFrame, functions: DataFrame, imports: DataFrame, calls: DataFrame, entry_files: DataFrame, tokens: list[str], anchor: str | None = None) -> DataFrame:
    """(path, score) of files other than docs with any evidence."""
    code = files.join(_met(docs.select("path")), "path", "left_anti")
    p, forms = t.normalise_path("path"), token_forms(files.sparkSession, tokens)
    own = code.select("path", (_held(p, forms) * 5 + F.when(t.basename_stem(p).isin(*tokens), 4).otherwise(0)).alias("s_path"))
    fn = functions.select("file", t.fenced(_held("qualified_name", forms) * F.when(F.col("exported"), 3).otherwise(1)).alias("s"))
    fn = fn.where("s > 0").groupBy("file").agg(F.least(F.sum("s"), F.lit(FUNCTION_CAP)).alias("s_fn"))
    out = own.join(_met(fn), own.path == fn.file, "left").drop("file")
    out = out.join(_met(entry_files.select("path", F.lit(2).alias("s_entry")).distinct()), "path", "left")
    hot = fan_in(calls).where("fan_in > 5").select(F.col("file").alias("path"), F.lit(1).alias("s_fan"))
    out = out.join(_met(hot), "path", "left")
    parts = ["s_path", "s_fn", "s_entry", "s_fan"]
    if anchor is not None:
        resolved = resolve_imports(imports, files)
        targets = resolved.where(F.col("from_path") == anchor).groupBy(F.col("target").alias("path")).agg((F.count(F.lit(1)) * 4).alias("s_to"))
        importers = resolved.where(F.col("target") == anchor).select(F.col("from_path").alias("path"), F.lit(4).alias("s_from")).distinct()
        near = connected_files(calls).where(F.col("file") == anchor).select(F.col("other").alias("path"), F.lit(3).alias("s_call"))
        same = F.when(p == anchor, 6).when(t.directory(p) == t.directory(F.lit(anchor)), 2).otherwise(0)
        out = out.join(_met(targets), "path", "left").join(_met(importers), "path", "left").join(_met(near), "path", "left").withColumn("s_near", same)
        parts += ["s_to", "s_from", "s_call", "s_near"]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in parts), F.lit(0))
    return out.select("path", total.cast("double").alias("score")).where("score > 0")


def second_pass(scores: DataFrame, files: DataFrame, docs: DataFrame, calls: DataFrame) -> DataFrame:
    """Two more points for files connected with the current top file, which are added if they had none; first in file order (ordinal) on ties."""
    top = scores.join(_met(files.select("path", "ordinal")), "path").orderBy(F.desc("score"), "ordinal").limit(1).select(F.col("path").alias("file"))
    near = connected_files(calls).join(F.broadcast(top), "file").select(F.col("other").alias("path"), F.lit(2.0).alias("more"))
    near = near.join(_met(files.select("path")), "path", "left_semi").join(_met(docs.select("path")), "path", "left_anti")
    return scores.join(near, "path", "full_outer").select("path", (F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("score"))


#: Points of a document for each task token that a field holds.
DOC_WEIGHTS = {"title": 8, "path": 5, "body": 1}


def doc_scores(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """(path, score) of documents: title 8, path 5, body 1 for each task token found. Documents are read once and no tokens are made of them."""
    forms = token_forms(docs.sparkSession, tokens)
    s = sum((_held(field, forms) * w for field, w in DOC_WEIGHTS.items()), F.lit(0))
    return docs.select("path", t.fenced(s).cast("double").alias("score")).where("score > 0")


def token_index(docs: DataFrame) -> DataFrame:
    """(path, field, token) of documents (path, title, body), each once. Written partitioned or bucketed by token it answers any task by
    reading the task's tokens alone; `reconcile.reindex` keeps it up to date by content hash."""
    fields = F.explode(F.create_map(*(x for f in DOC_WEIGHTS for x in (F.lit(f), t.token_set(f))))).alias("field", "tokens")
    return docs.select("path", fields).select("path", "field", F.explode("tokens").alias("token"))


def indexed_doc_scores(index: DataFrame, tokens: list[str]) -> DataFrame:
    """What doc_scores gives, from a stored token_index."""
    weight = F.create_map(*(F.lit(x) for kv in DOC_WEIGHTS.items() for x in kv))
    return index.where(F.col("token").isin(*tokens)).groupBy("path").agg(F.sum(F.element_at(weight, F.col("field"))).cast("double").alias("score"))


def suggest_fast(files, docs, functions, imports, calls, entry_files, task: str, anchor: str | None = None, limit: int = 5, connected: bool = True, index: DataFrame | None = None) -> DataFrame:
    """The best `limit` of path, kind, score: score, files before docs, shorter path, path. index: a stored token_index of docs, if there is one."""
    tokens = task_tokens(files.sparkSession, task)
    code = fast_scores(files, docs, functions, imports, calls, entry_files, tokens, anchor)
    if connected:
        code = second_pass(code, files, docs, calls)
    both = code.withColumn("kind", F.lit("file")).unionByName((doc_scores(docs, tokens) if index is None else indexed_doc_scores(index, tokens)).withColumn("kind", F.lit("doc")))
    return both.select("path", "kind", "score").orderBy(F.desc("score"), F.desc("kind"), F.length("path"), "path").limit(limit)


def fuzzy_tokens(items: DataFrame, queries: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """(id, query, token, sim): each item's best token for each query token by trigram overlap, first of equals by ordinal.

    items (id, token, ordinal), queries (query). A set-similarity join: distinct tokens meet by shared trigrams, then go back to the items.
    """
    gram = lambda df, c: df.select(c).distinct().select(c, F.size(t.trigrams(c)).alias(f"n_{c}"), F.explode(t.trigrams(c)).alias("g"))
    a, b = gram(items, "token"), gram(queries, "query")
    shared = a.join(b, "g").groupBy("token", "query", "n_token", "n_query").agg(F.count(F.lit(1)).alias("k"))
    near = shared.select("token", "query", (F.col("k") / (F.col("n_token") + F.col("n_query") - F.col("k"))).alias("sim")).where(F.col("sim") >= least)
    best = items.join(_met(near), "token").groupBy("id", "query").agg(F.max_by(F.struct("token", "sim"), F.struct("sim", (-F.col("ordinal")).alias("o"))).alias("m"))
    return best.select("id", "query", "m.token", "m.sim")


def content_hits(contents: DataFrame, tokens: list[str]) -> DataFrame:
    """(path, line, token, snippet): the first three lines of each file that hold a task token, with the first token in task order. Files over 500 kB are passed over."""
    lines = contents.where(F.octet_length("body") <= MOST_BYTES).select("path", F.posexplode(F.split("body", "\n")).alias("pos", "text"))
    low = F.lower("text")
    first = F.coalesce(*(F.when(low.contains(k), k) for k in tokens)) if tokens else F.lit(None).cast("string")
    hits = lines.withColumn("token", first).where("token is not null")
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).where(F.col("n") <= MOST_HITS)
    return hits.select("path", (F.col("pos") + 1).alias("line"), "token", F.substring(F.trim("text"), 1, SNIPPET).alias("snippet"))


def candidate_pool(scored: DataFrame, files: DataFrame, pool: int) -> DataFrame:
    """(path) of at most `pool` files: fuzzy-only finds first, then others by score, then files without any evidence in file order. scored has path, score, fuzzy_only."""
    rest = files.select("path", "ordinal").join(_met(scored.select("path")), "path", "left_anti").select("path", F.lit(2).alias("c"), F.lit(0.0).alias("score"), "ordinal")
    ranked = scored.join(_met(files.select("path", "ordinal")), "path", "left").select("path", F.when(F.col("fuzzy_only"), 0).otherwise(1).alias("c"), "score", "ordinal")
    return ranked.unionByName(rest).orderBy("c", F.desc("score"), "ordinal", "path").limit(pool).select("path")


def suggest_deep(files, docs, functions, imports, calls, entry_files, contents, task: str, anchor: str | None = None, limit: int = 5, pool: int = 60) -> DataFrame:
    """The fast ranker's pool with fuzzy tokens (four times the overlap for each task token) and contents (three for each token found, nine at most)."""
    spark = files.sparkSession
    tokens = task_tokens(spark, task)
    fast = suggest_fast(files, docs, functions, imports, calls, entry_files, task, anchor, max(pool, limit))
    named = files.select(F.col("path").alias("id"), F.col("path").alias("value")).unionByName(functions.select(F.col("file").alias("id"), F.col("qualified_name").alias("value")))
    items = named.select("id", F.posexplode(t.tokenize("value")).alias("ordinal", "token")).groupBy("id", "token").agg(F.min("ordinal").alias("ordinal"))
    queries = spark.range(1).select(F.explode(_literal(tokens)).alias("query"))
    fuzzy = fuzzy_tokens(items, queries).groupBy(F.col("id").alias("path")).agg((F.sum("sim") * TRIGRAM_WEIGHT).alias("fuzzy"))
    both = fast.join(fuzzy, "path", "full_outer").select("path", F.coalesce("kind", F.lit("file")).alias("kind"), (F.coalesce("score", F.lit(0.0)) + F.coalesce("fuzzy", F.lit(0.0))).alias("score"), F.col("score").isNull().alias("fuzzy_only"))
    both = cut(both, "scores")  # used twice, and small: a row for each file with evidence
    chosen = candidate_pool(both, files, max(pool, limit))
    found = content_hits(contents.join(chosen, "path", "left_semi"), tokens).groupBy("path").agg(F.least(F.count_distinct("token") * CONTENT_PER_TOKEN, F.lit(CONTENT_CAP)).alias("content"))
    out = both.join(found, "path", "full_outer").select("path", F.coalesce("kind", F.lit("file")).alias("kind"), (F.coalesce("score", F.lit(0.0)) + F.coalesce("content", F.lit(0))).alias("score"))
    return out.orderBy(F.desc("score"), F.desc("kind"), "path").limit(limit)


def entry_pick(candidates: DataFrame, files: DataFrame, most: int = 8) -> DataFrame:
    """(path, ordinal): the first `most` distinct candidates (path, ordinal) that are files."""
    return candidates.join(files.select("path"), "path", "left_semi").groupBy("path").agg(F.min("ordinal").alias("ordinal")).orderBy("ordinal", "path").limit(most)
