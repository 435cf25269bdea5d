"""Recall, surfacing, review and briefing over curated records (memories) and their scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions import text as t
from . import pairs

#: Weights and limits of recall, dedup, matching and surfacing.
SEMANTIC, SCOPE, STATUS, CONFIDENCE, RECENCY = 0.5, 0.3, 0.1, 0.05, 0.05
POOL, TOP_K, RECENCY_DAYS, PROJECT_BOOST, DEDUP_COSINE, GENERIC_TAG_LIMIT = 200, 10, 60.0, 0.1, 0.85, 9
SCOPED_COSINE, UNSCOPED_COSINE, RELATED_CAP, SURFACE_CAP = 0.45, 0.60, 3, 5
CONFIDENCE_FLOORS = {"fast": 10.0, "deep": 15.0, "semantic": 0.5}
GLOB = r"[\]\[*?{]"
DAY_MS = 86_400_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a| |b| + 1e-9)."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def glob_regex(pattern: Column | str) -> Column:
    """A path glob as an anchored regular expression: ** crosses slashes, * and ? don't, [..] and one level of {a,b} as usual."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    p = F.regexp_replace(p, r"([.+^$()|\\])", r"\\$1")
    p = F.regexp_replace(p, r"\[!", "[^")
    braces = F.regexp_replace(F.regexp_replace(p, r"\{([^{}]*)\}", "\x01$1\x02"), ",(?=[^\x01\x02]*\x02)", "|")
    p = F.translate(braces, "\x01\x02", "()")
    p = F.regexp_replace(p, r"\(([^()]*)\)", "(?:$1)")
    p = F.regexp_replace(p, r"\*\*/", "\x03")
    p = F.regexp_replace(p, r"\*\*", "\x04")
    p = F.regexp_replace(p, r"\*", "[^/]*")
    p = F.regexp_replace(p, r"\?(?!:)", "[^/]")
    return F.concat(F.lit("^"), F.replace(F.replace(p, F.lit("\x03"), F.lit("(?:.*/)?")), F.lit("\x04"), F.lit(".*")), F.lit("$"))


def _key(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def pattern_key(pattern: Column | str) -> Column:
    """What each path that a glob covers has to have, as (kind, value): the literal folders that the glob begins with (dir), or else its
    literal file name (name), or extension (ext). Globs without any of these have kind any."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    head = F.regexp_extract(p, r"^((?:[^\]\[*?{}/]+/)*)", 1)
    # A name is only one if a slash, or ** as a whole segment, stands before it; braces may reach over slashes.
    whole = ~p.rlike(r"[{}]|[^/]\*\*/")
    name = F.regexp_extract(p, r"/([^\]\[*?{}/]+)$", 1)
    end = F.regexp_extract(p, r"\.([^\]\[*?{}/.]+)$", 1)
    return (
        F.when(head != "", _key("dir", F.substring(head, F.lit(1), F.length(head) - 1)))
        .when(whole & (name != ""), _key("name", name))
        .when(end != "", _key("ext", end))
        .otherwise(_key("any", F.lit("")))
    )


def path_keys(path: Column | str) -> Column:
    """All keys of patterns that may cover a path: its folders, its name, its extension, and that of patterns without any."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    above = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    folders = F.when(F.size(parts) > 1, F.transform(above, lambda n: _key("dir", F.array_join(F.slice(parts, 1, n), "/")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    return F.concat(folders, F.array(_key("name", F.element_at(parts, -1)), _key("ext", F.regexp_extract(p, r"\.([^/.]*)$", 1)), _key("any", F.lit(""))))


def pattern_index(scope: DataFrame) -> DataFrame:
    """(key, pattern, regex) of the distinct globs of a scope; may be stored."""
    globs = scope.where("kind = 'file'").select(F.col("value").alias("pattern")).where(F.col("pattern").rlike(GLOB)).distinct()
    return globs.select(pattern_key("pattern").alias("key"), "pattern", glob_regex("pattern").alias("regex"))


def scope_matches(paths: DataFrame, scope: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(path, memory_id, value) where a stored file scope names or globs a path. Literals meet by an equi-join. So do globs: each has one key, a path
    has a row for each of its keys, and only pairs with a common key are looked at. index: a stored pattern_index."""
    own = scope.where("kind = 'file'").select("memory_id", "value")
    each = paths.select("path").distinct()
    literal = each.join(own, F.col("path") == F.col("value")).select("path", "memory_id", "value")
    index = pattern_index(scope) if index is None else index
    near = each.select("path", F.explode(path_keys("path")).alias("key")).join(index, "key").where(F.expr("path rlike regex"))
    globbed = near.select("path", F.col("pattern").alias("value")).join(own, "value").select("path", "memory_id", "value")
    return literal.unionByName(globbed).distinct()


def list_memories(memories: DataFrame, scope: DataFrame, types: list[str] | None = None, statuses: list[str] | None = None, file: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first."""
    m = memories
    m = m.where(F.col("type").isin(*types)) if types else m
    m = m.where(F.col("status").isin(*statuses)) if statuses else m
    if file is not None:
        m = m.join(scope.where((F.col("kind") == "file") & (F.col("value") == file)).select(F.col("memory_id").alias("id")), "id", "left_semi")
    return m.orderBy(F.desc("updated_ms"), "id").limit(limit)


def candidates(memories: DataFrame, scope: DataFrame, files: list[str] = [], tags: list[str] = [], types: list[str] = [], statuses: tuple[str, ...] = ("active", "candidate"), pool: int | None = POOL) -> DataFrame:  # noqa: B006
    """Records that recall may score: of the statuses and types, and with a scope given those that name it, hold any glob, or have no scope. Of more than `pool` those of the smallest ids."""
    m = memories.where(F.col("status").isin(*statuses))
    m = m.where(F.col("type").isin(*types)) if types else m
    if files or tags:
        is_file, is_tag = F.col("kind") == "file", F.col("kind") == "tag"
        hit = (is_file & (F.col("value").isin(*files) | F.col("value").rlike(GLOB)) if files else F.lit(False)) | (is_tag & F.col("value").isin(*tags) if tags else F.lit(False))
        s = scope.groupBy(F.col("memory_id").alias("id")).agg(F.max(hit).alias("hit"))
        m = m.join(s, "id", "left").where(F.coalesce("hit", F.lit(True))).drop("hit")
    return m if pool is None else m.orderBy("id").limit(pool)


def recall(memories: DataFrame, scope: DataFrame, vectors: DataFrame, query: list[float], now_ms: int, files: list[str] = [], tags: list[str] = [], types: list[str] = [], limit: int | None = TOP_K, pool: int | None = POOL) -> DataFrame:  # noqa: B006
    """id, score of the best records: .5 cosine + .3 scope + .1 status + .05 confidence + .05 recency; no vector counts as cosine 0.

    Scope is 1 for a file hit, .5 for a tag hit, 0 for scopes without a hit, .2 for no scope.
    """
    spark = memories.sparkSession
    c = candidates(memories, scope, files, tags, types, pool=pool)
    paths = spark.range(1).select(F.explode(F.array(*map(F.lit, files)).cast("array<string>")).alias("path"))
    by_file = scope_matches(paths, scope).select(F.col("memory_id").alias("id"), F.lit(1).alias("file_hit")).distinct() if files else None
    tag_hit = (F.col("kind") == "tag") & F.col("value").isin(*tags) if tags else F.lit(False)
    s = scope.groupBy(F.col("memory_id").alias("id")).agg(F.max(tag_hit).alias("tag_hit"))
    c = c.join(s, "id", "left")
    c = c.join(by_file, "id", "left") if files else c.withColumn("file_hit", F.lit(None).cast("int"))
    c = c.join(vectors.select("id", "vec"), "id", "left")
    scoped = F.when(F.col("tag_hit").isNull(), 0.2).when(F.col("file_hit") == 1, 1.0).when(F.col("tag_hit"), 0.5).otherwise(0.0)
    sim = F.coalesce(cosine(F.array(*map(F.lit, query)), F.col("vec")), F.lit(0.0))
    age = (F.lit(now_ms) - F.col("updated_ms")) / DAY_MS
    score = sim * SEMANTIC + scoped * SCOPE + t.status_weight("status") * STATUS + F.col("confidence") * CONFIDENCE + t.recency(age, RECENCY_DAYS) * RECENCY
    out = c.select("id", score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def cross_tier(project: DataFrame, general: DataFrame, limit: int = TOP_K, boost: float = PROJECT_BOOST) -> DataFrame:
    """Recall results (id, score) of a project and of the general tier together; the project's are lifted."""
    both = project.select("id", (F.col("score") + boost).alias("score"), F.lit("project").alias("tier")).unionByName(general.select("id", "score", F.lit("global").alias("tier")))
    return both.orderBy(F.desc("score"), "id").limit(limit)


def dedup_target(new: DataFrame, memories: DataFrame, vectors: DataFrame, least: float = DEDUP_COSINE) -> DataFrame:
    """(new_id, id, cosine): for each new record (new_id, type, tags, vec) the most similar active or candidate one of its type that shares a tag; none below `least`. Ties by id; untagged records have none.
    Records of a type and tag meet in parts (`pairs`), never as rows of pairs."""
    group = F.to_json(F.struct("type", F.col("tag").alias("tag"))).alias("g")
    tagged = lambda df, name: df.where(F.col("type").isNotNull()).select(F.col(name).alias("id"), "type", F.explode(F.array_distinct("tags")).alias("tag"), "vec").where("tag is not null").select(group, "id", "vec")
    old = memories.where(F.col("status").isin("active", "candidate")).join(vectors.select("id", "vec"), "id")
    near = pairs.best(tagged(new, "new_id"), tagged(old, "id"), 1, least, cosine=True)
    return near.select(F.col("source").alias("new_id"), F.col("target").alias("id"), F.col("sim").alias("cosine"))


def file_window(results: DataFrame, share: float = 0.7, most: int = 3) -> DataFrame:
    """The first results (path, score) of at least `share` of the best score."""
    top = results.agg(F.max("score").alias("top"))
    return results.join(F.broadcast(top), F.col("score") >= F.col("top") * share).orderBy(F.desc("score"), "path").limit(most).drop("top")


def related(results: DataFrame, mode: str, memories: DataFrame, scope: DataFrame, vectors: DataFrame, query: list[float], cap: int = RELATED_CAP) -> DataFrame:
    """id, cosine of active records that fit a task's file results: scoped ones must cover a file of the window, unscoped ones be closer to the task. Nothing if the best result is below the mode's floor."""
    enough = results.agg(F.max("score").alias("top")).where(F.col("top") >= CONFIDENCE_FLOORS[mode])
    paths = file_window(results).join(F.broadcast(enough), F.lit(True), "left_semi").select("path")
    active = memories.where("status = 'active'").join(vectors.select("id", "vec"), "id").select("id", "get_count", cosine(F.array(*map(F.lit, query)), F.col("vec")).alias("cosine"))
    scoped = active.join(scope_matches(paths, scope).select(F.col("memory_id").alias("id")).distinct(), "id", "left_semi").where(F.col("cosine") >= SCOPED_COSINE)
    free = active.join(scope.select(F.col("memory_id").alias("id")), "id", "left_anti").where(F.col("cosine") >= UNSCOPED_COSINE).join(F.broadcast(enough), F.lit(True), "left_semi")
    return scoped.unionByName(free).orderBy(F.desc("cosine"), F.desc("get_count"), "id").limit(cap).select("id", "cosine")


def surface_by_file(paths: DataFrame, memories: DataFrame, scope: DataFrame, cap: int = SURFACE_CAP) -> DataFrame:
    """id, path, specificity of active records whose file scope covers an edited path: narrowest pattern first, then use, recency, id."""
    hit = scope_matches(paths, scope).withColumn("specificity", t.pattern_specificity("value"))
    best = hit.groupBy(F.col("memory_id").alias("id")).agg(F.max_by("path", F.struct("specificity", "path")).alias("path"), F.max("specificity").alias("specificity"))
    out = best.join(memories.where("status = 'active'").select("id", "get_count", "updated_ms"), "id")
    return out.orderBy(F.desc("specificity"), F.desc("get_count"), F.desc("updated_ms"), "id").limit(cap).select("id", "path", "specificity")


def generic_tags(memories: DataFrame, scope: DataFrame, least: int = GENERIC_TAG_LIMIT) -> DataFrame:
    """Tags of so many active records that they tell nothing."""
    active = scope.where("kind = 'tag'").join(memories.where("status = 'active'").select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return active.groupBy(F.col("value").alias("tag")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def tag_overlap(paths: DataFrame, memories: DataFrame, scope: DataFrame, least: int = GENERIC_TAG_LIMIT) -> DataFrame:
    """(id, score): a point for each token that a tag shares with the edited paths; generic tags are left out whole."""
    tokens = paths.select(F.explode(t.normalise_tag("path")).alias("token")).distinct()
    active = scope.where("kind = 'tag'").join(memories.where("status = 'active'").select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("memory_id", F.col("value").alias("tag"))
    own = active.join(generic_tags(memories, scope, least).select("tag"), "tag", "left_anti").distinct()
    hits = own.select(F.col("memory_id").alias("id"), "tag", F.explode(t.normalise_tag("tag")).alias("token")).join(tokens, "token")
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("score"))


def workflow_rules(memories: DataFrame, scope: DataFrame, limit: int | None = None) -> DataFrame:
    """Active decisions and how-tos with a tag and no file scope: pinned, use, recency, id."""
    of = lambda k: scope.where(F.col("kind") == k).select(F.col("memory_id").alias("id"))
    m = memories.where("status = 'active' and type in ('decision', 'how-to')").join(of("tag"), "id", "left_semi").join(of("file"), "id", "left_anti")
    return m.orderBy(F.desc("pinned"), F.desc("get_count"), F.desc("updated_ms"), "id").limit(limit) if limit else m


def pending_rewrite(memories: DataFrame, since_ms: int | None = None, limit: int = 25) -> DataFrame:
    """Candidates never rewritten that aren't captures: surest first, then newest."""
    m = memories.where("status = 'candidate' and rewritten_ms is null and type != 'capture'")
    if since_ms is not None:
        m = m.where((F.col("updated_ms") >= since_ms) | (F.col("last_accessed_ms") >= since_ms))
    return m.orderBy(F.desc("confidence"), F.desc("updated_ms"), "id").limit(limit)


def pending_captures(memories: DataFrame, low: bool = False, limit: int = 15, signal: Column | None = None) -> DataFrame:
    """Candidate captures by signal; those without any only if asked for. signal: another measure than the body's signals."""
    m = memories.where("status = 'candidate' and type = 'capture'").withColumn("signal", rules.signal_score("body") if signal is None else signal)
    return (m if low else m.where("signal >= 1")).orderBy(F.desc("signal"), F.desc("updated_ms"), "id").limit(limit)


def capture_contexts(captures: DataFrame, provenance: DataFrame, transcripts: DataFrame, evidence: DataFrame, radius: int = 3) -> DataFrame:
    """captures (id, ...) with context (kind, turns, user_turn, snippet): the transcript within `radius` turns of where it comes from if there is
    any, else the recorded prompt with the answer after it, else nothing but the body.

    provenance (id, session, turn), transcripts (session, turn, role, text), evidence (session, turn, text, snippet). Captures are
    few when they come here; a window holds at most 2 * radius + 1 turns.
    """
    at = captures.select("id").join(provenance.where("session is not null and turn is not null"), "id")
    near = transcripts.join(at.select("id", "session", F.col("turn").alias("centre")), "session").where(F.abs(F.col("turn") - F.col("centre")) <= radius)
    near = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pair = at.join(evidence, ["session", "turn"]).groupBy("id").agg(F.min(F.struct(F.col("text").alias("user_turn"), "snippet")).alias("pair"))
    out = captures.join(near, "id", "left").join(pair, "id", "left")
    kind = F.when(F.col("turns").isNotNull(), "transcript").when(F.col("pair").isNotNull(), "evidence").otherwise("body-only")
    own = F.when(F.col("turns").isNull(), F.col("pair"))
    return out.withColumn("context", F.struct(kind.alias("kind"), "turns", own["user_turn"].alias("user_turn"), own["snippet"].alias("snippet"))).drop("turns", "pair")


def recall_stores(memories: DataFrame, scope: DataFrame, vectors: DataFrame, query: list[float], now_ms: int, each: int = 8, limit: int = 30) -> DataFrame:
    """(repo, id, score): the best `each` records of every store together, the best `limit` of all; no tier is lifted."""
    scored = recall(memories, scope, vectors, query, now_ms, limit=None, pool=None).join(memories.select("id", "repo"), "id")
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "id")
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= each).orderBy(F.desc("score"), "repo", "id").limit(limit).select("repo", "id", "score")


def pinned_briefing(memories: DataFrame, scope: DataFrame, now_ms: int, top: int = 5) -> DataFrame:
    """Pinned records, and sure decisions and gotchas without file scope: confidence * exp(-age / 60 days)."""
    filed = scope.where("kind = 'file'").select(F.col("memory_id").alias("id"))
    active = memories.where("status = 'active'")
    both = active.where("pinned").unionByName(active.where("not pinned and type in ('decision', 'gotcha') and confidence >= 0.9").join(filed, "id", "left_anti").select(memories.columns))
    score = F.col("confidence") * F.exp(-(F.lit(now_ms) - F.col("updated_ms")) / DAY_MS / 60)
    return both.select("id", "type", "title", score.alias("score")).orderBy(F.desc("score"), "id").limit(top)


def digest_top(memories: DataFrame, k: int = 5) -> DataFrame:
    """The k surest active records of each type: confidence, recency, id."""
    w = Window.partitionBy("type").orderBy(F.desc("confidence"), F.desc("updated_ms"), "id")
    return memories.where("status = 'active'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("type", "n", "id", "confidence")


def digest_counts(memories: DataFrame, tier: Column | None = None) -> DataFrame:
    """One row of counts: by status, pinned among active, captures by tier (by the body's signals, unless another is given)."""
    own = rules.capture_tier("body") if tier is None else tier
    tier, capture = F.col("tier"), (F.col("status") == "candidate") & (F.col("type") == "capture")
    return memories.select("status", "type", "pinned", t.once(F.when(capture, own)).alias("tier")).agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("active", "candidate", "deprecated")),
        F.count_if((F.col("status") == "active") & F.col("pinned")).alias("pinned_active"),
        *(F.count_if(capture & (tier == k)).alias(f"captures_{k}") for k in ("high", "low")),
    )


def scope_digest(memories: DataFrame, scope: DataFrame) -> DataFrame:
    """Active records with their file scopes, sorted and joined; empty for none."""
    s = scope.where("kind = 'file'").groupBy(F.col("memory_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("files"))
    return memories.where("status = 'active'").join(s, "id", "left").select("id", "title", F.coalesce("files", F.lit("")).alias("files"))


def extract_tags(texts: DataFrame, most: int = 5) -> DataFrame:
    """(id, n, tag): the words of four letters or more that a text has most often; ties by word."""
    # A text is one row, so its words are counted there: sorted, a word's count is the way from its first place to the next word's.
    words = texts.select("id", t.once(F.array_sort(t.tag_words("body"))).alias("w")).where("size(w) > 0")
    starts = F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (x != F.get("w", i - 1)), F.struct(x.alias("tag"), i.alias("i")))), lambda x: x.isNotNull())
    words = words.select("id", F.size("w").alias("size"), t.once(starts).alias("s"))
    counts = F.transform("s", lambda x, k: F.struct((-(F.coalesce(F.get("s", k + 1)["i"], F.col("size")) - x["i"])).cast("long").alias("less"), x["tag"].alias("tag")))
    counts = F.filter(counts, lambda x: t.is_tag(x["tag"]))
    best = words.select("id", F.slice(F.array_sort(counts), 1, most).alias("b"))
    return best.select("id", F.posexplode("b").alias("n", "b")).select("id", (F.col("n") + 1).alias("n"), "b.tag", (-F.col("b.less")).alias("count"))


def validate_types(memories: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, errors) of records whose type is unknown or whose extra fields break its contract. registry (type, field, required, allowed); fields are a map."""
    known = memories.join(registry.select("type").distinct(), "type", "left_anti").select("id", F.concat(F.lit("unknown type "), "type").alias("e"))
    rows = memories.join(registry.where("field is not null"), "type").withColumn("v", F.try_element_at("type_fields", F.col("field")))
    missing = rows.where("required and v is null").select("id", F.concat(F.lit("missing "), "field").alias("e"))
    wrong = rows.where("v is not null and allowed is not null and not array_contains(allowed, v)").select("id", F.concat(F.lit("bad value of "), "field").alias("e"))
    return known.unionByName(missing).unionByName(wrong).groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("errors"))


def aging_actions(memories: DataFrame, now_ms: int, low_signal_days: int = 14, candidate_days: int = 90, deprecated_days: int = 180, merged_days: int = 90, trashed_days: int = 90, low_confidence: float = 0.4, tier: Column | None = None) -> DataFrame:
    """(id, current_status, new_status, reason): what an aging sweep would do; low-signal captures are judged first, so each record has one action.
    tier: of captures, by the body's signals unless another is given."""
    age = lambda d: F.col("updated_ms") < now_ms - d * DAY_MS
    status = F.col("status")
    low = (F.col("type") == "capture") & (status == "candidate") & age(low_signal_days) & ((rules.capture_tier("body") if tier is None else tier) == "low")
    reason = (
        F.when(low, F.lit(f"aging: low-signal capture untouched >{low_signal_days}d"))
        .when((status == "candidate") & age(candidate_days) & (F.col("confidence") < low_confidence), F.format_string(f"aging: low-confidence candidate (%.2f < {low_confidence}) for >{candidate_days}d", "confidence"))
        .when((status == "candidate") & age(candidate_days), F.lit(f"aging: candidate for >{candidate_days}d"))
        .when((status == "deprecated") & age(deprecated_days), F.lit(f"aging: deprecated for >{deprecated_days}d"))
        .when((status == "merged_into") & age(merged_days), F.lit(f"aging: merged_into for >{merged_days}d"))
        .when((status == "trashed") & age(trashed_days), F.lit(f"aging: trashed >{trashed_days}d"))
    )
    rows = memories.withColumn("reason", reason).where("reason is not null")
    return rows.select("id", status.alias("current_status"), F.when(status == "trashed", "purged").otherwise("trashed").alias("new_status"), "reason")


def drain_actions(captures: DataFrame, keepers: DataFrame) -> DataFrame:
    """(id, action, reason) for a backlog (id, type, status, body): what is no candidate capture stays, and so does a trimmed body
    that a keeper has; the others go by rule and tier of the routed prompt. Repeated bodies are judged each time."""
    # Bodies meet by digest, so that none is shuffled. What rules are asked about is worked out once, and of candidate captures alone.
    digest = F.sha2(F.regexp_replace("body", r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", ""), 256).alias("digest")
    own = F.coalesce((F.col("status") == "candidate") & (F.col("type") == "capture"), F.lit(False))
    rows = captures.select("id", own.alias("own"), digest, t.once(F.when(own, t.routed_prompt("body"))).alias("prompt"))
    rows = rows.select("id", "own", "digest", "prompt", t.once(rules.stripped("prompt")).alias("bare"))
    verdict = F.coalesce(rules.structural_reject("prompt", "bare"), F.when(rules.capture_tier("prompt") == "low", "low-tier"), F.lit("signal"))
    rows = rows.select("id", "own", "digest", t.once(F.when(F.col("own"), verdict)).alias("verdict"))
    rows = rows.join(keepers.select(digest, F.lit(1).alias("kept")).distinct(), "digest", "left")
    reason = F.when(~F.col("own"), "not-candidate-capture").when(F.col("kept") == 1, "keeper").otherwise(F.col("verdict"))
    action = F.when(~F.col("own") | (F.col("kept") == 1) | (F.col("verdict") == "signal"), "keep").otherwise("trash")
    return rows.select("id", action.alias("action"), reason.alias("reason"))


def triage(memories: DataFrame, reject: Column | None = None) -> DataFrame:
    """(id, action, reason): extracted candidates are deprecated as noise or become captures. reject: why a body is noise, by all structural rules
    unless others are given."""
    rows = memories.where("status = 'candidate' and source = 'extracted' and type != 'capture'").withColumn("reason", rules.structural_reject("body") if reject is None else reject)
    return rows.select("id", F.when(F.col("reason").isNotNull(), "deprecate").otherwise("retype").alias("action"), "reason")
