"""Queries over suggestions' quality, scope trailers, review, projects and their graph, with their twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import looks, rules, text
from ..operators import code, graph, library, memory, pooled, ranking, reconcile, stats, suggest, tables
from ..sources import files as sources
from ..sources import ignore
from ..streaming import sink
from . import store_queries, text_queries
from .views import NOW_MS, TASK, Views, with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = sql
        return f

    return keep


# -- scope trailers -----------------------------------------------------------------------------------------------------
_ADDED = (
    "<scopeFiles>src/a.ts, src/b.ts ,src/a.ts</scopeFiles>\n\n  <scopeTags>[\"x\", \" y \", \"\"]</scopeTags>\n</invoke>\n",
    "see <scopeTags>none</scopeTags> in the text",
    "<scopeTags>one,two</scopeTags>\nand more prose",
    "<scopeFiles>{broken</scopeFiles>\n<confidence>0.9</confidence>",
    "\n<source>s</source>",
)
_TRAILER_RE2 = rules.TRAILER.replace("(?s)", "").replace("'", "''")


def _added() -> str:
    return "CASE id % 6 " + " ".join(f"WHEN {k} THEN '" + x.replace("\n", "\\n") + "'" for k, x in enumerate(_ADDED)) + " ELSE '' END"


_VALUES = "list_distinct(list_filter(list_transform(CASE WHEN starts_with({0}, '[') OR starts_with({0}, '{{') THEN coalesce(TRY_CAST(json_extract_string(TRY_CAST({0} AS JSON), '$[*]') AS VARCHAR[]), []) ELSE string_split({0}, ',') END, lambda x: trim(x)), lambda x: x <> ''))"
_TRAILERS = with_views(
    "memories",
    f"b AS (SELECT id, body || chr(10) || replace({_added()}, '\\n', chr(10)) AS body FROM memories), t AS (SELECT id, body, regexp_extract(body, '{_TRAILER_RE2}', 2, 's') AS tr, regexp_extract(body, '{_TRAILER_RE2}', 1, 's') AS head FROM b), "
    "p AS (SELECT *, trim(regexp_extract(tr, '<scopeFiles>(.*?)</scopeFiles>', 1, 's')) AS f, trim(regexp_extract(tr, '<scopeTags>(.*?)</scopeTags>', 1, 's')) AS g FROM t), "
    f"v AS (SELECT id, tr <> '' AS matched, {_VALUES.format('f')} AS files, {_VALUES.format('g')} AS tags, CASE WHEN tr = '' THEN body WHEN regexp_replace(head, '\\s+$', '') = '' THEN '' ELSE regexp_replace(head, '\\s+$', '') || chr(10) END AS body FROM p) "
    "SELECT id, matched, array_to_string(list_sort(files), ',') AS files, array_to_string(list_sort(tags), ',') AS tags, sha256(body) AS body FROM v",
)


@query("legacy_scope", _TRAILERS)
def legacy_scope(v: Views):
    """Scope lines at the end of all records' bodies."""
    m = v.memories.select("id", F.concat("body", F.lit("\n"), F.expr(_added())).alias("body"))
    x = m.select("id", rules.legacy_scope("body").alias("x"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return x.select("id", "x.matched", join("x.files").alias("files"), join("x.tags").alias("tags"), F.sha2("x.body", 256).alias("body"))


# -- suggestions --------------------------------------------------------------------------------------------------------
def _scored(v: Views):
    files = v.files
    ranked = files.select((F.col("ordinal") % 20).alias("query"), "path", ((F.col("ordinal") * 7919) % 1009).cast("double").alias("score"))
    truth = files.where("ordinal % 3 = 0").select((F.col("ordinal") % 20).alias("query"), "path")
    return suggest.quality(suggest.ranks(ranked), truth)


_QUALITY = "f AS (SELECT * FROM files), r AS (SELECT ordinal % 20 AS query, path, row_number() OVER (PARTITION BY ordinal % 20 ORDER BY (ordinal * 7919) % 1009 DESC, path) AS n FROM f), tr AS (SELECT ordinal % 20 AS query, path FROM f WHERE ordinal % 3 = 0), q AS (SELECT tr.query, count(r.path) AS hits, count(*) AS n FROM tr LEFT JOIN r ON r.query = tr.query AND r.path = tr.path AND r.n <= 5 GROUP BY tr.query)"


@query("rank_quality", with_views("files", f"{_QUALITY} SELECT query, (hits > 0)::INT AS hit, hits / 5 AS precision, hits / n AS recall FROM q"))
def rank_quality(v: Views):
    """Hit, precision and recall of the first five against known answers."""
    return _scored(v)


@query("rank_quality_mean", with_views("files", f"{_QUALITY} SELECT avg((hits > 0)::INT) AS hit, avg(hits / 5) AS precision, avg(hits / n) AS recall FROM q"))
def rank_quality_mean(v: Views):
    """Their means."""
    return suggest.mean_quality(_scored(v))


@query("suggest_door")
def suggest_door(v: Views):
    """The checked call from a file, with its answer's circumstances; tests compare it with the ranker."""
    origin = v.files.orderBy("ordinal").first().path
    found, asked = suggest.suggest({"files": v.files, "docs": v.docs, "functions": v.functions, "imports": v.imports, "calls": v.file_calls, "entry_files": v.entry_files}, TASK, origin=f"./{origin}", limit=20)
    return found.withColumn("origin", F.lit(asked["origin"]))


# -- review and recall --------------------------------------------------------------------------------------------------
_CAPTURES = "c AS (SELECT id, id % 60 AS session, id % 7 AS turn FROM memories WHERE status = 'candidate')"


@query(
    "capture_contexts",
    with_views(
        "memories turns",
        f"{_CAPTURES}, w AS (SELECT c.id, count(*) AS n, min(t.turn) AS lo, max(t.turn) AS hi FROM c JOIN turns t ON t.session = c.session AND t.session % 3 > 0 AND abs(t.turn - c.turn) <= 3 GROUP BY c.id), "
        "e AS (SELECT c.id, min(text) AS user_turn FROM c JOIN turns t ON t.session = c.session AND t.turn = c.turn AND t.role = 'user' GROUP BY c.id) "
        "SELECT c.id, CASE WHEN w.n IS NOT NULL THEN 'transcript' WHEN e.id IS NOT NULL THEN 'evidence' ELSE 'body-only' END AS kind, coalesce(w.n, 0)::BIGINT AS n, w.lo, w.hi, sha256(CASE WHEN w.n IS NULL THEN e.user_turn END) AS user_turn FROM c LEFT JOIN w USING (id) LEFT JOIN e USING (id)",
    ),
)
def capture_contexts(v: Views):
    """Where candidates come from: transcript, else the recorded prompt, else nothing. A third of the transcripts is gone."""
    own = v.memories.where("status = 'candidate'").select("id")
    at = own.select("id", (F.col("id") % 60).alias("session"), (F.col("id") % 7).alias("turn"))
    prompts = v.turns.where("role = 'user'").select("session", "turn", "text", F.lit(None).cast("string").alias("snippet"))
    x = memory.capture_contexts(own, at, v.turns.where("session % 3 > 0"), prompts)
    turns = F.col("context.turns")
    return x.select("id", "context.kind", F.coalesce(F.size(turns), F.lit(0)).cast("long").alias("n"), F.array_min(F.transform(turns, lambda x: x["turn"])).alias("lo"), F.array_max(F.transform(turns, lambda t: t["turn"])).alias("hi"), F.sha2("context.user_turn", 256).alias("user_turn"))


@query("recall_stores")
def recall_stores(v: Views):
    """The best records of every store together; tests compare it with a loop over the stores."""
    return memory.recall_stores(v.memories, v.scope, v.vectors, v.query_vector, NOW_MS).withColumn("score", F.round("score", 9))


@query("bootstrap_totals", with_views("turns", "s AS (SELECT session, count(*) FILTER (role = 'user') AS created, count(*) FILTER (role <> 'user') AS appended, max(turn) AS rejected, session % 9 = 0 AS bad FROM turns GROUP BY session ORDER BY session % 50, session LIMIT 80) SELECT count(*) FILTER (NOT bad) AS sessions, coalesce(sum(created) FILTER (NOT bad), 0)::BIGINT AS created, coalesce(sum(appended) FILTER (NOT bad), 0)::BIGINT AS appended, coalesce(sum(rejected) FILTER (NOT bad), 0)::BIGINT AS rejected, count(*) FILTER (bad) AS failed FROM s"))
def bootstrap_totals(v: Views):
    """What a first run over the earliest eighty sessions made."""
    done = v.turns.groupBy("session").agg(F.count_if(F.col("role") == "user").alias("created"), F.count_if(F.col("role") != "user").alias("appended"), F.max("turn").alias("rejected"))
    done = done.withColumn("error", F.when(F.col("session") % 9 == 0, "broken"))
    return stats.bootstrap_totals(v.turns.select("session", (F.col("session") % 50).alias("started")).distinct(), done, 80)


# -- projects and their graph -------------------------------------------------------------------------------------------
@query(
    "node_details",
    with_views(
        "memories files",
        "SELECT 'memory:' || repo || ':' || id AS id, 'memory' AS kind, repo, title AS label, type AS first FROM memories UNION ALL SELECT 'file:r:' || path, 'file', 'r', path, path FROM files "
        "UNION ALL SELECT 'symbol:r:' || path || '::f', 'symbol', 'r', path || '::f', path FROM files UNION ALL SELECT 'project:r:', 'project', 'r', 'r', ''",
    ),
)
def node_details(v: Views):
    """Details of all records, files, a symbol of each, a project, a record that isn't there and a broken id."""
    m = v.memories.select("repo", "id", "title", "type", "status", F.substring("body", 1, 50).alias("excerpt"))
    ids = m.select(F.concat_ws(":", F.lit("memory"), "repo", "id").alias("id")).unionByName(v.files.select(F.concat(F.lit("file:r:"), "path").alias("id"))).unionByName(v.files.select(F.concat(F.lit("symbol:r:"), "path", F.lit("::f")).alias("id")))
    more = v.spark.range(1).select(F.explode(F.array(F.lit("project:r:"), F.lit("memory:src0:-5"), F.lit("broken"))).alias("id"))
    d = graph.node_details(ids.unionByName(more), m)
    return d.select("id", "kind", "repo", "label", F.coalesce(*(F.try_element_at("fields", F.lit(k)) for k in ("type", "path", "file"))).alias("first"))


@query("cluster_labels", "SELECT 's' || s_suppkey AS repo, CASE s_suppkey % 3 WHEN 0 THEN substring('s' || s_suppkey, 1, 8) ELSE 'w' || s_suppkey END AS label FROM supplier UNION ALL SELECT 'global', 'global' UNION ALL SELECT 'abcdefghij', 'abcdefgh'")
def cluster_labels(v: Views):
    """Names of projects and of stores of records alone."""
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    code_ = v.table("supplier").select(key.alias("repo"), F.when(F.col("s_suppkey") % 3 == 0, "/").otherwise(F.concat(F.lit("/home/w"), F.col("s_suppkey").cast("string"), F.lit("/"))).alias("worktree"))
    own = code_.select("repo").limit(3).unionByName(v.spark.range(1).select(F.explode(F.array(F.lit("global"), F.lit("abcdefghij"))).alias("repo")))
    return graph.cluster_labels(code_, own)


@query("graph_bridge", with_views("memories scope files", "p AS (SELECT m.repo, s.memory_id, s.value FROM scope s JOIN memories m ON m.id = s.memory_id WHERE s.kind = 'file' AND s.value LIKE '%.ts') SELECT DISTINCT 'memory:' || repo || ':' || memory_id AS source, 'file:' || repo || ':' || value AS target, 'anchors' AS rel FROM p"))
def graph_bridge(v: Views):
    """Records anchored to files, as a graph's edges."""
    files = v.scope.where("kind = 'file' and value like '%.ts'").select("repo", F.col("value").alias("path")).distinct()
    return graph.build("bridge", {"memories": v.memories, "scope": v.scope, "files": files})[1]


_BY_TYPE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in looks.TYPE_COLOURS.items()) + f" ELSE '{looks.OTHER}' END"


@query(
    "node_looks",
    with_views(
        "memories",
        f"SELECT 'm' || id AS id, type AS category, {_BY_TYPE} AS colour, CASE WHEN type = 'capture' THEN 0.16 ELSE round(0.4 + 0.6 * confidence, 9) END::DOUBLE AS alpha, CASE WHEN type = 'capture' THEN 2.5 ELSE round(least(18.0, greatest(2.5, 2.0 + pinned::INT * 7 + log2(get_count + 1) * 2.2 + confidence * 6)), 6) END::DOUBLE AS size FROM memories "
        "UNION ALL SELECT 'k' || i, k, c, 0.95, z FROM (VALUES (0, 'project', '#ffd11a', 12.0), (1, 'dir', '#2ee6e6', 8.0), (2, 'file', '#39d0ff', 5.0), (3, 'symbol', '#c77dff', 4.0)) x(i, k, c, z)",
    ),
)
def node_looks(v: Views):
    """Category, colour, brightness and size of all records, and of a node of each other kind."""
    m = v.memories.select(F.concat(F.lit("m"), "id").alias("id"), F.lit("memory").alias("kind"), "type", "confidence", "pinned", "get_count")
    kinds = v.spark.range(4).select(F.concat(F.lit("k"), "id").alias("id"), F.element_at(F.array(*map(F.lit, ("project", "dir", "file", "symbol"))), (F.col("id") + 1).cast("int")).alias("kind"))
    both = m.unionByName(kinds, allowMissingColumns=True)
    return both.select("id", looks.node_category().alias("category"), looks.node_colour().alias("colour"), F.round(looks.node_alpha(), 9).alias("alpha"), F.round(looks.node_size(), 6).alias("size"))


@query("package_roots", "SELECT s_suppkey AS repo, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['src', 'lib'] WHEN 1 THEN ['pkg'] WHEN 2 THEN ['code'] ELSE [''] END) AS root FROM supplier")
def package_roots(v: Views):
    """Package roots of repositories with one kind of settings each, or none."""
    body = (
        F.when(F.col("s_suppkey") % 4 == 0, "[tool.x]\nwhere = [\"src\", 'lib']")
        .when(F.col("s_suppkey") % 4 == 1, "[options]\npackage_dir =\n  = pkg")
        .when(F.col("s_suppkey") % 4 == 2, 'setup(package_dir={"": "code"})')
        .otherwise("nothing")
    )
    path = F.element_at(F.array(*map(F.lit, ("pyproject.toml", "setup.cfg", "setup.py", "setup.py"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    repos = v.table("supplier").select(F.col("s_suppkey").alias("repo"))
    return code.package_roots(repos, v.table("supplier").select(F.col("s_suppkey").alias("repo"), path.alias("path"), body.alias("body")))


# -- upkeep -------------------------------------------------------------------------------------------------------------
_MOVES = "a AS (SELECT doc_id, 'n' || doc_id AS note FROM documents WHERE doc_id % 3 = 0), m AS (SELECT doc_id AS o, doc_id + 7 AS n FROM documents WHERE doc_id % 6 = 0)"


@query("relink_annotations", f"WITH {_MOVES} SELECT doc_id, note FROM a WHERE doc_id NOT IN (SELECT o FROM m) UNION ALL SELECT n, note FROM a JOIN m ON m.o = a.doc_id WHERE n NOT IN (SELECT doc_id FROM a WHERE doc_id NOT IN (SELECT o FROM m))")
def relink_annotations(v: Views):
    """Annotations after renames."""
    d = v.table("documents")
    a = d.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("note"))
    return reconcile.relink_annotations(a, d.where("doc_id % 6 = 0").select(F.col("doc_id").alias("old_path"), (F.col("doc_id") + 7).alias("new_path")))


@query("write_chunks", with_views("turns", "o AS (SELECT session, text, turn FROM turns WHERE turn % 2 = 0), n AS (SELECT session, turn AS id, text FROM turns WHERE session % 2 = 0) SELECT session, id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session = n.session AND o.text = n.text)"))
def write_chunks(v: Views):
    """Chunks of captured sessions that need a vector."""
    old = v.turns.where("turn % 2 = 0").select("session", F.col("turn").alias("id"), "text", F.array(F.lit(1.0)).alias("vec"))
    return sources.write_chunks(old, v.turns.where("session % 2 = 0").select("session", F.col("turn").alias("id"), "text"))[1].select("session", "id")


@query("indexed_doc_score", text_queries.SQL["doc_score"])
def indexed_doc_score(v: Views):
    """Scores of documents from a stored token table."""
    return ranking.indexed_doc_scores(ranking.token_index(v.docs), ranking.task_tokens(v.spark, TASK))


@query("indexed_search", store_queries.SQL["full_text"])
def indexed_search(v: Views):
    """The match set from a stored index."""
    return library.search_index(v.spark, v.stored_texts(), "the of", limit=1 << 30, forms=store_queries.FORMS).select("source", "id")


# -- small column functions ---------------------------------------------------------------------------------------------
_PATCH = "'*** Begin Patch' || chr(10) || '*** Update File: src/' || doc_id || '.ts' || chr(10) || '@@ x' || chr(10) || '*** Add File: a b' || (doc_id % 3) || chr(10) || '*** Update File: src/' || doc_id || '.ts' || chr(10) || '*** Move to: ' || source || '/n' || chr(10) || ' *** Delete File: no' || chr(10) || '*** End Patch'"


@query("patch_paths", rf"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({_PATCH}, '(?m)^\*\*\* (?:Add File|Update File|Delete File|Move to): (.+)$', 1))), ',') AS paths FROM documents")
def patch_paths(v: Views):
    """Paths of a patch made of each document."""
    patch = F.expr(_PATCH.replace("||", ",").join(("concat(", ")")))
    return v.table("documents").select("doc_id", F.array_join(F.array_sort(text.patch_paths(patch)), ",").alias("paths"))


@query("safe_messages", r"SELECT doc_id, sha256(substring(trim(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g')), 1, 300)) AS message, CASE WHEN doc_id % 3 = 0 THEN 'a.b:' || doc_id END AS tag FROM documents")
def safe_messages(v: Views):
    """Messages and tags fit for a log."""
    tag = F.concat(F.lit("a.b:"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(" x"))
    return v.table("documents").select("doc_id", F.sha2(text.safe_message(F.coalesce("text", F.lit(""))), 256).alias("message"), text.safe_tag(tag).alias("tag"))


@query("tool_summaries", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN left('run ' || repeat('x', (event_id % 200)::INT), 120) WHEN 1 THEN 'f' || event_id WHEN 2 THEN 'p' || event_id END AS summary FROM events")
def tool_summaries(v: Views):
    """A line for each call of a tool."""
    i = F.col("event_id").cast("string")
    quoted = lambda k, x: F.concat(F.lit(f'{{"{k}": "'), x, F.lit('"}'))
    args = F.when(F.col("event_id") % 4 == 0, quoted("command", F.concat(F.lit("run "), F.expr("repeat('x', cast(event_id % 200 as int))")))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"path": "no", "file_path": "f'), i, F.lit('"}'))).when(F.col("event_id") % 4 == 2, quoted("pattern", F.concat(F.lit("p"), i))).otherwise(F.lit('{"other": 1}'))
    return v.table("events").select("event_id", text.tool_summary(F.when(F.col("event_id") % 4 == 0, "Bash").otherwise("Read"), args).alias("summary"))


_EXTENSIONS = ("ts", "PY", "h", "hpp", "c", "mjs", "md", "cxx")


@query(
    "languages",
    f"SELECT p_partkey, (['typescript', 'python', 'c', 'cpp', 'c', 'typescript', NULL, 'cpp'])[p_partkey % 8 + 1] AS language, CASE WHEN p_partkey % 8 IN (2, 3) THEN 'x' || p_partkey || '.c,x' || p_partkey || '.cc,x' || p_partkey || '.cpp,x' || p_partkey || '.cxx' ELSE '' END AS companions FROM part",
)
def languages(v: Views):
    """Language of paths, and the sources that may belong to headers."""
    path = F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return v.table("part").select("p_partkey", text.language(path).alias("language"), F.array_join(text.companion_sources(path), ",").alias("companions"))


@query("retention_days", "SELECT p_partkey, least(greatest(CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 130 - 20 ELSE 30 END, 0), 90)::INT AS days FROM part")
def retention_days(v: Views):
    """Days of retention within their bounds."""
    asked = F.when(F.col("p_partkey") % 7 > 0, (F.col("p_partkey") % 130 - 20).cast("int"))
    return v.table("part").select("p_partkey", text.retention_days(asked).cast("int").alias("days"))


@query("blast_tiers", f"SELECT target, key, hop, split_part(key, '::', 1) AS file, split_part(key, '::', 2) AS name, false AS exported FROM ({store_queries.SQL['blast_radius']})")
def blast_tiers(v: Views):
    """Callers of each region with file and name."""
    none = v.spark.createDataFrame([], "file string, qualified_name string, exported boolean")
    targets = v.table("region").select(F.concat(F.lit("region::r"), F.col("r_regionkey").cast("string")).alias("target"))
    return graph.blast_report(v.calls, none, targets).select("target", "key", "hop", "file", "name", "exported")


@query("project_graph", f"SELECT 'node' AS part, 'file' AS kind, count(*) AS n FROM part UNION ALL SELECT 'edge', 'imports', count(*) FROM ({store_queries.SQL['file_edges']})")
def project_graph(v: Views):
    """Nodes and edges of the whole project by kind, without its symbols."""
    nodes, edges = graph.project_graph(v.files, v.imports, v.functions, v.file_calls.withColumn("kind", F.lit("call")), "off")
    count = lambda df, part, kind: df.groupBy(F.lit(part).alias("part"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "node", "kind").unionByName(count(edges, "edge", "rel"))


# -- files, models, tables and streams ----------------------------------------------------------------------------------
_RULES = "promo*/\n*_1*.ts\n!*_1[05]*.ts\n"


@query("kept_files", with_views("paths", r"SELECT path FROM paths WHERE NOT regexp_matches(path, '(^|/)promo[^/]*/') AND NOT (regexp_matches(path, '(^|/)[^/]*_1[^/]*\.ts$') AND NOT regexp_matches(path, '(^|/)[^/]*_1[05][^/]*\.ts$'))"))
def kept_files(v: Views):
    """Files that a repository's ignore rules leave."""
    return ignore.kept(v.files, ignore.rules(v.spark.range(1).select(F.lit(ignore.RULE_FILE).alias("path"), F.lit(_RULES).alias("body"))))


@query("pooled_embeddings")
def pooled_embeddings(v: Views):
    """First lines of all documents by a model that is made of them; tests compare with numpy."""
    titles = v.docs.select("path", F.col("title").alias("text"))
    path = f"{graph.shared_dir(v.spark)}/token-model-{uuid.uuid4().hex}"
    pooled.write_model(pooled.fit_tokens(titles, dim=32), path)
    return pooled.embed(titles, path).select("path", F.transform("vec", lambda x: F.round(x.cast("double"), 4)).alias("vec"))


@query("sql_symbols", with_views("paths", "SELECT path, 'make' || string_split(string_split(path, '/')[-1], '_')[1] AS name, 2 AS line FROM paths"))
def sql_symbols(v: Views):
    """Functions of all files by the table function, with an extractor of one's own for their language."""

    def toy(path: str, body: str) -> list[tuple]:
        return [(path, "function", line[3:], None, None, n, n, None) for n, line in enumerate(body.split("\n"), 1) if line.startswith("fn ")]

    tables.register(v.spark, {"typescript": toy}, name="symbols_of_one_kind")
    name = F.substring_index(F.substring_index("path", "/", -1), "_", 1)
    files = v.files.select("path", F.concat(F.lit("// x\nfn make"), name, F.lit("\n")).alias("body"))
    files.createOrReplaceTempView("files_with_bodies")
    return v.spark.sql("SELECT path, name, line FROM symbols_of_one_kind(TABLE(SELECT path, body FROM files_with_bodies) PARTITION BY path)")


@query("stored_calls", with_views("tool_calls", f"SELECT tool, status, count(*) AS n, max(ts) AS latest FROM tool_calls WHERE ts >= {NOW_MS} - 14 * 86400000::BIGINT GROUP BY tool, status"))
def stored_calls(v: Views):
    """Calls by tool after a stream has stored them with two weeks of retention, and its last batch was tried again."""
    path = f"{graph.shared_dir(v.spark)}/calls-{uuid.uuid4().hex}"
    schema = v.table("events").schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    calls = v.calls_of(stream)
    sink.store_calls(calls, path, f"{path}-offsets", days=14, clock=lambda: NOW_MS).awaitTermination()
    sink.store_batch(v.calls_of(v.table("events")), 0, path, NOW_MS, 14)
    return sink.read_calls(v.spark, path, NOW_MS, 14).groupBy("tool", "status").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))
