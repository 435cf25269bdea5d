"""Evidence, chunks and search over agent sessions (turns: session, turn, role, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules

SNIPPET, CHUNK, NEAR = 500, 512, 3
#: Weights of the kinds of evidence in a search.
WEIGHTS = {"correction": 1.0, "prompt": 0.7, "file": 0.6, "tool": 0.4, "summary": 0.8}
CHUNK_WEIGHT, CHUNK_COSINE = 0.5, 0.3
Judge = Callable[[str], Column]


def next_snippet(turns: DataFrame) -> DataFrame:
    """(session, turn, snippet) of user turns: the first assistant text before the next user turn, 500 characters of it; null if there is none."""
    order = Window.partitionBy("session").orderBy("turn")
    runs = turns.withColumn("run", F.sum((F.col("role") == "user").cast("int")).over(order))
    own = Window.partitionBy("session", "run").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    said = F.when((F.col("role") == "assistant") & (F.length("text") > 0), F.substring("text", 1, SNIPPET))
    return runs.withColumn("snippet", F.first(said, ignorenulls=True).over(own)).where("role = 'user'").select("session", "turn", "snippet")


def prompts(turns: DataFrame) -> DataFrame:
    """User turns that a harness didn't write, with snippet and whether they correct."""
    own = turns.where("role = 'user' and text != ''").where(~rules.is_injected("text"))
    return own.join(next_snippet(turns), ["session", "turn"]).select("session", "turn", "text", "snippet", rules.is_correction("text").alias("correction"))


def _said(injected: bool) -> Column:
    """Whether a turn is a user's with text; without `injected`, one that a harness didn't write."""
    own = (F.col("role") == "user") & (F.col("text") != "")
    return own if injected else own & ~rules.is_injected("text")


def corrections(turns: DataFrame, injected: bool = False, judge: Judge = rules.is_correction) -> DataFrame:
    """(session, turn, correction) of each prompt; `injected`: also of those that a harness wrote."""
    return turns.where(_said(injected)).select("session", "turn", judge("text").alias("correction"))


def evidence_counts(turns: DataFrame, injected: bool = False, judge: Judge = rules.is_correction) -> DataFrame:
    """Per session: turns, prompts, corrections; `injected`: with prompts that a harness wrote."""
    real = _said(injected)
    return turns.groupBy("session").agg(F.count(F.lit(1)).alias("turns"), F.count_if(real).alias("prompts"), F.count_if(real & judge("text")).alias("corrections"))


def token_chunks(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """(session, chunk, token_start, token_end, text): windows of `size` white-space words over a session's turns, each begun by its role and number."""
    marked = turns.select("session", "turn", F.concat(F.lit("["), "role", F.lit(" #"), F.col("turn").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("line"))
    words = marked.select("session", "turn", F.posexplode(F.filter(F.split("line", r"\s+"), lambda w: w != "")).alias("i", "w"))
    counts = words.groupBy("session", "turn").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("session").orderBy("turn")) - F.col("n"))
    placed = words.join(before, ["session", "turn"]).withColumn("pos", F.col("before") + F.col("i"))
    g = placed.groupBy("session", F.floor(F.col("pos") / size).cast("int").alias("chunk")).agg(F.min("pos").alias("token_start"), (F.max("pos") + 1).alias("token_end"), F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    return g.select("session", "chunk", "token_start", "token_end", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("text"))


def content_digest(turns: DataFrame) -> DataFrame:
    """(session, digest): sha256 over a session's turns in order, fields parted by NUL."""
    one = F.concat_ws("\x00", F.col("turn").cast("string"), "role", F.coalesce("text", F.lit("")))
    return turns.groupBy("session").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))), lambda s: s["x"]), "\x00"), 256).alias("digest"))


def files_near_turn(points: DataFrame, touches: DataFrame, most: int = NEAR) -> DataFrame:
    """(session, turn, path): files touched within `most` turns. points (session, turn), touches (session, turn, path)."""
    p, f = points.alias("p"), touches.alias("f")
    return p.join(f, (F.col("p.session") == F.col("f.session")) & F.col("f.turn").between(F.col("p.turn") - most, F.col("p.turn") + most)).select("p.session", "p.turn", "f.path").distinct()


def nearest_file(points: DataFrame, touches: DataFrame) -> DataFrame:
    """(session, turn, path, distance): the file touched nearest in turns, the earlier of equals. The last touch before and the first after are found by windows over both, not by pairs."""
    both = points.select("session", "turn", F.lit(None).cast("string").alias("path"), F.lit(1).alias("p")).unionByName(touches.groupBy("session", "turn").agg(F.min("path").alias("path")).withColumn("p", F.lit(0)))
    back = Window.partitionBy("session").orderBy("turn", "p").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("session").orderBy("turn", "p").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("p") == 0, F.struct("turn", "path"))
    x = both.withColumns({"a": F.last(at, ignorenulls=True).over(back), "b": F.first(at, ignorenulls=True).over(on)}).where("p = 1")
    da, db = F.col("turn") - F.col("a.turn"), F.col("b.turn") - F.col("turn")
    first = F.col("b").isNull() | F.coalesce(da <= db, F.lit(False))
    return x.where("a is not null or b is not null").select("session", "turn", F.when(first, F.col("a.path")).otherwise(F.col("b.path")).alias("path"), F.when(first, da).otherwise(db).alias("distance"))


def turns_around(turns: DataFrame, centres: DataFrame, most: int = NEAR) -> DataFrame:
    """Turns within `most` of a centre (session, centre)."""
    return turns.join(centres, "session").where(F.abs(F.col("turn") - F.col("centre")) <= most).select("session", "centre", "turn", "role", "text")


def search(evidence: DataFrame, query: str, sessions: list[str] | None = None, limit: int | None = 20, chunks: DataFrame | None = None, vector: list[float] | None = None) -> DataFrame:
    """(session, turn, kind, score, text) of evidence (session, turn, kind, text) that holds the query, and of chunks (session, turn, text, vec) close to its vector.

    A turn may give several hits. With `sessions` given they alone are searched.
    """
    own = evidence if sessions is None else evidence.where(F.col("session").isin(*sessions))
    weight = F.coalesce(*(F.when(F.col("kind") == k, w) for k, w in WEIGHTS.items()))
    hits = own.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("session", "turn", "kind", weight.alias("score"), "text")
    if chunks is not None and vector is not None:
        from .memory import dot

        v = F.array(*map(F.lit, vector))
        norm = F.sqrt(dot(v, v)) * F.sqrt(dot(F.col("vec"), F.col("vec")))
        sim = F.when(norm == 0, 0.0).otherwise(dot(v, F.col("vec")) / norm)
        near = (chunks if sessions is None else chunks.where(F.col("session").isin(*sessions))).withColumn("sim", sim).where(F.col("sim") > CHUNK_COSINE)
        hits = hits.unionByName(near.select("session", "turn", F.lit("chunk").alias("kind"), (F.col("sim") * CHUNK_WEIGHT).alias("score"), "text"))
    return hits.orderBy(F.desc("score"), "session", "turn", "kind").limit(limit) if limit else hits


def search_broadening(evidence: DataFrame, query: str, session: str, limit: int = 20) -> DataFrame:
    """The session's hits, or the whole project's where it has none."""
    own = search(evidence, query, [session], limit)
    return own if not own.isEmpty() else search(evidence, query, None, limit)


def search_evidence(turns: DataFrame, injected: bool = False, judge: Judge = rules.is_correction) -> DataFrame:
    """Rows for `search`: prompts, and corrections once more; `injected`: with prompts that a harness wrote."""
    p = turns.where(_said(injected)).withColumn("correction", judge("text"))
    return p.select("session", "turn", F.lit("prompt").alias("kind"), "text").unionByName(p.where("correction").select("session", "turn", F.lit("correction").alias("kind"), "text"))


def new_evidence(evidence: DataFrame, marks: DataFrame) -> DataFrame:
    """Evidence past each session's last processed turn (session, last_turn); -1 where none is stored."""
    return evidence.join(marks, "session", "left").where(F.col("turn") > F.coalesce("last_turn", F.lit(-1))).drop("last_turn")


def capture_routes(turns: DataFrame) -> DataFrame:
    """(session, turn, route, reason) of prompts: rejected by a rule, discarded without signal, else a capture."""
    p = prompts(turns).withColumns({"rule": rules.structural_reject("text"), "tier": rules.capture_tier("text")})
    route = F.when(F.col("rule").isNotNull(), "reject").when(F.col("tier") == "low", "discard").otherwise("capture")
    return p.select("session", "turn", route.alias("route"), F.coalesce("rule", "tier").alias("reason"))


def ignore_worktrees(sessions: DataFrame, prefixes: list[str]) -> DataFrame:
    """Sessions that don't come from an ignored worktree; an unknown origin passes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("worktree").startswith(p)
    return sessions.where(~F.coalesce(hit, F.lit(False)))


def latest_manifest(entries: DataFrame) -> DataFrame:
    """The last entry of each id (id, ordinal, ...)."""
    w = Window.partitionBy("id").orderBy(F.desc("ordinal"))
    return entries.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
