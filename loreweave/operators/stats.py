"""Metrics over tool calls and sessions. `now` and windows are parameters; every comparison at a window's edge is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_MS = {"1h": 3_600_000, "24h": 86_400_000, "7d": 604_800_000, "30d": 2_592_000_000}
UNATTRIBUTED, BUCKETS = "(unattributed)", 30
#: Thresholds of the verdict.
MEMORY_USED_GOOD, MEMORY_USED_OK, RECALL_TO_GET_OK, ERRORS_BAD, LEAST_SESSIONS, LEAST_CALLS = 50, 20, 30, 5, 5, 20


def percentile(values: Column, p: float) -> Column:
    """Of a sorted array: the element at floor(p / 100 * (n - 1)), no interpolation; 0 for none."""
    n = F.size(values)
    return F.coalesce(F.try_element_at(values, (F.floor(F.lit(p) / 100 * (n - 1)) + 1).cast("int")), F.lit(0.0))


def percentiles(calls: DataFrame, keys: list[str], value: str = "dur_ms") -> DataFrame:
    """p50 and p95 per key, exact, without a group's values in one row or one task: distinct values are counted, their counts summed in bins of
    a thousandth of an octave, and values in order are only those of the bin that holds the rank."""
    from pyspark.sql.window import Window

    v = F.col(value).cast("double")
    counts = calls.where(F.col(value).isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("bin", F.floor(F.signum("v") * F.log2(1 + F.abs("v")) * 1024))
    # As many rows for a key as its values span bins: some ten thousand.
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    bins = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("m"))
    bins = bins.withColumns({"upto": F.sum("m").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("m").over(w)})
    ranks = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.floor(F.lit(p) / 100 * (F.col("all") - 1)).alias("rank")) for p in (50, 95))))
    held = bins.withColumn("r", ranks).where("upto > r.rank and upto - m <= r.rank")
    held = held.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("bin").alias("b"), "r.p", "r.rank", (F.col("upto") - F.col("m")).alias("below"))
    same = F.col("bin") == F.col("b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}"))
    near = counts.join(held, same)
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys, "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto).where("upto > rank")
    return near.groupBy(*keys).agg(*(F.min(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in (50, 95)))


def _within(calls: DataFrame, now_ms: int, window: str) -> DataFrame:
    return calls.where(F.col("ts") > now_ms - WINDOW_MS[window])


def aggregate(calls: DataFrame, now_ms: int, window: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Calls, errors, cache mix, and percentiles over durations that aren't synthetic; one row of zeros for none."""
    recent = _within(calls, now_ms, window)
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    sums = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), count(F.col("status") == "error").alias("errs"), *(count(F.col("cache_status") == s).alias(s) for s in ("fresh", "reindexed", "stale")))
    p = percentiles(recent.where("synthetic = 0"), keys)
    out = sums.join(p, keys, "left") if keys else sums.crossJoin(p)
    return out.select(*keys, "total", "errs", F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"), "fresh", "reindexed", "stale")


def hit_rate(calls: DataFrame, now_ms: int, window: str, tool: str = "suggest_files") -> DataFrame:
    """hits, total, rate of one tool; calls without a recorded result count for nothing."""
    own = _within(calls, now_ms, window).where((F.col("tool") == tool) & F.col("result_count").isNotNull())
    out = own.agg(F.count_if(F.col("result_count") > 0).alias("hits"), F.count(F.lit(1)).alias("total"))
    return out.select("hits", "total", F.when(F.col("total") == 0, 0.0).otherwise(F.col("hits") / F.greatest("total", F.lit(1))).alias("rate"))


def top_tools(calls: DataFrame, now_ms: int, window: str, limit: int = 10) -> DataFrame:
    """The tools called most, with their errors."""
    g = _within(calls, now_ms, window).groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errs"))
    return g.orderBy(F.desc("n"), "tool").limit(limit)


def latency_per_tool(calls: DataFrame, now_ms: int, window: str) -> DataFrame:
    """tool, p50, p95."""
    return percentiles(_within(calls, now_ms, window).where("synthetic = 0"), ["tool"])


def tool_counts(calls: DataFrame, now_ms: int, window: str) -> DataFrame:
    """tool, n over all stores."""
    return _within(calls, now_ms, window).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def activity(recorded: DataFrame, used: DataFrame, now_ms: int, window: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket, recorded, used: counts in equal parts of the window; times outside it are left out, not clamped.

    recorded (ts) counts from the start of the window to before now, used (ts) after the start up to now.
    """
    span = WINDOW_MS[window]
    since = now_ms - span

    def part(df: DataFrame, inside: Column, name: str) -> DataFrame:
        b = F.floor((F.col("ts") - since) / (span / buckets)).cast("int")
        return df.where(inside).select(b.alias("bucket")).where(F.col("bucket").between(0, buckets - 1)).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    ts = F.col("ts")
    all_ = recorded.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    out = all_.join(part(recorded, (ts >= since) & (ts < now_ms), "recorded"), "bucket", "left").join(part(used, (ts > since) & (ts <= now_ms), "used"), "bucket", "left")
    return out.select("bucket", F.coalesce("recorded", F.lit(0)).alias("recorded"), F.coalesce("used", F.lit(0)).alias("used"))


def sessions(calls: DataFrame, surface: DataFrame, now_ms: int, window: str) -> DataFrame:
    """One row per session with calls or surfacings: counts, first and last time, and whether recalls and surfacings led to a later get."""
    since = now_ms - WINDOW_MS[window]
    key = F.coalesce("session_id", F.lit(UNATTRIBUTED)).alias("session_id")
    c = calls.where(F.col("ts") >= since).select(key, "ts", "tool", F.lit(0).alias("s"))
    s = surface.where(F.col("ts") >= since).select(key, "ts", F.lit("").alias("tool"), F.lit(1).alias("s"))
    tool = lambda n: (F.col("tool") == n) & (F.col("s") == 0)
    g = c.unionByName(s).groupBy("session_id").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if(F.col("s") == 0).alias("total_calls"),
        *(F.count_if(tool(f"{n}_memory")).alias(n) for n in ("recall", "get", "record")),
        F.count_if(F.col("s") == 1).alias("surfacings"),
        F.min(F.when(tool("recall_memory"), F.col("ts"))).alias("first_recall"),
        F.min(F.when(F.col("s") == 1, F.col("ts"))).alias("first_surface"),
        F.max(F.when(tool("get_memory"), F.col("ts"))).alias("last_get"),
    )
    # Some get is later than the first recall exactly if the last get is.
    return g.select(
        *("session_id", "first_ts", "last_ts", "total_calls", "recall", "get", "record", "surfacings"),
        ((F.col("get") >= 1) | (F.col("record") >= 1)).alias("memory_used"),
        F.coalesce(F.col("last_get") > F.col("first_recall"), F.lit(False)).alias("recall_to_get"),
        F.coalesce(F.col("last_get") > F.col("first_surface"), F.lit(False)).alias("surface_to_get"),
    )


def _pct(n: Column, d: Column) -> Column:
    return F.when(d == 0, 0.0).otherwise(n / F.greatest(d, F.lit(1)) * 100)


def adoption(calls: DataFrame, surface: DataFrame, now_ms: int, window: str, cleanup: tuple[str, ...] = ("deprecate_memory", "trash_memory", "merge_memories", "confirm_memory", "rewrite_memory")) -> DataFrame:
    """One row: shares of sessions that used memories, whose recalls and surfacings led to a get, clean-ups per extracted candidate, and calls without a session."""
    s = sessions(calls, surface, now_ms, window)
    a = s.agg(
        F.count(F.lit(1)).alias("session_count"),
        F.count_if("memory_used").alias("used"),
        F.count_if(F.col("recall") >= 1).alias("recalled"),
        F.count_if("recall_to_get").alias("recalled_got"),
        F.count_if(F.col("surfacings") >= 1).alias("surfaced"),
        F.count_if("surface_to_get").alias("surfaced_got"),
    )
    c = calls.where(F.col("ts") >= now_ms - WINDOW_MS[window]).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("session_id").isNull()).alias("loose"),
        F.coalesce(F.sum(F.when(F.col("tool") == "extract_session", F.coalesce("result_count", F.lit(0)))), F.lit(0)).alias("candidates"),
        F.count_if(F.col("tool").isin(*cleanup)).alias("cleanup"),
    )
    col = F.col
    return a.crossJoin(c).select(
        "session_count",
        _pct(col("used"), col("session_count")).alias("memory_used_pct"),
        _pct(col("recalled_got"), col("recalled")).alias("recall_to_get_pct"),
        col("recalled").alias("sessions_recalled"),
        col("recalled_got").alias("sessions_recall_to_get"),
        _pct(col("surfaced_got"), col("surfaced")).alias("surface_to_get_pct"),
        _pct(col("cleanup"), col("candidates")).alias("extract_cleanup_pct"),
        F.when(col("events") == 0, 0.0).otherwise(col("loose") / F.greatest("events", F.lit(1))).alias("unattributed_share"),
        "used",
        (col("session_count") - col("used")).alias("not_used"),
    )


def adoption_across(per_store: DataFrame) -> DataFrame:
    """One row from the counts of many stores (session_count, used, sessions_recalled, sessions_recall_to_get): summed, then divided."""
    names = ("session_count", "used", "sessions_recalled", "sessions_recall_to_get")
    s = per_store.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    c = F.col
    return s.select("session_count", _pct(c("used"), c("session_count")).alias("memory_used_pct"), _pct(c("sessions_recall_to_get"), c("sessions_recalled")).alias("recall_to_get_pct"), "sessions_recalled", "sessions_recall_to_get", "used", F.greatest(F.lit(0), c("session_count") - c("used")).alias("not_used"))


def verdict(inputs: DataFrame) -> DataFrame:
    """Adds dot and reason to rows of memory_used_pct, recall_to_get_pct, err_pct, total_sessions, total_calls: the first failing dimension names a mixed verdict."""
    used, got, err = F.col("memory_used_pct"), F.col("recall_to_get_pct"), F.col("err_pct")
    few = (F.col("total_sessions") < LEAST_SESSIONS) | (F.col("total_calls") < LEAST_CALLS)
    good = (used >= MEMORY_USED_GOOD) & (got >= RECALL_TO_GET_OK) & (err < ERRORS_BAD)
    reason = F.when(few, "too little data").when(good, "landing").when(err >= ERRORS_BAD, "errors").when(used < MEMORY_USED_OK, "rarely used").when(used < MEMORY_USED_GOOD, "sometimes used").otherwise("recalls rarely open")
    return inputs.withColumn("reason", reason).withColumn("dot", F.when(few, "muted").when(good, "green").otherwise("yellow"))


def memory_health(memories: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Counts by status with pinned over all, and the `top` records used most."""
    statuses = ("active", "candidate", "deprecated", "merged_into", "trashed")
    counts = memories.agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses), F.count_if("pinned").alias("pinned"))
    most = memories.where("get_count > 0").orderBy(F.desc("get_count"), F.desc("last_accessed"), "id").limit(top)
    return counts, most.select("id", "title", "get_count")


def status_groups(memories: DataFrame, order: tuple[str, ...] = ("active", "candidate", "deprecated")) -> DataFrame:
    """status, position, n in a fixed order, with zeros."""
    rows = memories.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, order))).alias("position", "status"))
    return rows.join(memories.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", "position", F.coalesce("n", F.lit(0)).alias("n"))


def best_cache(meta: DataFrame) -> DataFrame:
    """The newest index of each repository (repo, worktree, indexed_at)."""
    return meta.groupBy("repo").agg(F.max_by("worktree", "indexed_at").alias("worktree"), F.max("indexed_at").alias("indexed_at"))


def storage_footprint(files: DataFrame) -> DataFrame:
    """Bytes per store of a binaryFile listing (path, length)."""
    return files.groupBy(F.regexp_extract("path", "/([0-9a-f]{16}|global)/", 1).alias("store")).agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))


def touched_searches(searches: DataFrame, hits: DataFrame, touches: DataFrame) -> DataFrame:
    """One row: searches, share with any hit, share with a hit's file touched later in the session, share of hits in the same repository.

    searches (search_id, session_id, turn), hits (search_id, path, same_repo), touches (session_id, turn, path).
    """
    later = hits.join(searches, "search_id").alias("h").join(touches.alias("t"), (F.col("h.session_id") == F.col("t.session_id")) & (F.col("h.path") == F.col("t.path")) & (F.col("t.turn") > F.col("h.turn")), "left_semi")
    touched = later.select(F.col("search_id")).distinct().withColumn("touched", F.lit(1))
    some = hits.groupBy("search_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("same_repo").alias("own"))
    a = searches.join(some, "search_id", "left").join(touched, "search_id", "left").agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("n") > 0).alias("full"), F.count("touched").alias("touched"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.coalesce(F.sum("own"), F.lit(0)).alias("own"))
    rate = lambda n, d: F.when(F.col(d) == 0, 0.0).otherwise(F.col(n) / F.greatest(d, F.lit(1)))
    return a.select("searches", rate("full", "searches").alias("non_empty_rate"), rate("touched", "full").alias("touch_rate"), rate("own", "hits").alias("in_repo_ratio"))


def bootstrap_totals(sessions: DataFrame, results: DataFrame, limit: int | None = None) -> DataFrame:
    """One row over the earliest `limit` sessions (session, started): sessions processed, candidates created, evidence appended, candidates
    rejected, sessions that failed. results (session, created, appended, rejected, error); a session without a result did nothing."""
    own = sessions.select("session", "started")
    own = own.orderBy("started", "session").limit(limit) if limit is not None else own
    x = own.join(results, "session", "left")
    ok = F.col("error").isNull()
    done = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    return x.agg(F.count_if(ok).alias("sessions"), done("created").alias("created"), done("appended").alias("appended"), done("rejected").alias("rejected"), F.count_if(~ok).alias("failed"))
