"""Queries over identifiers, rules and rankings, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as t
from ..operators import memory, ranking
from ..sources.spread import spread
from .views import TASK, Views, with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = sql
        return f

    return keep


def _list(xs) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]"


def sql_stem(x: str) -> str:
    return (
        f"CASE WHEN length({x}) <= 3 OR regexp_matches({x}, '(ss|us|is|os|as)$') THEN NULL WHEN regexp_matches({x}, 'ies$') AND length({x}) > 4 THEN {x}[:-4] || 'y' "
        f"WHEN regexp_matches({x}, '(xes|ches|shes|sses|zes)$') AND length({x}) > 4 THEN {x}[:-3] WHEN regexp_matches({x}, 's$') THEN {x}[:-2] END"
    )


def sql_tokens(v: str) -> str:
    """The tokenizer as one DuckDB expression; the order of its result is not that of appearance."""
    camel = r"list_filter(string_split(regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '), lambda p: p <> '')"
    words = f"flatten(list_transform(list_filter(string_split_regex(s, '[^a-zA-Z0-9]+'), lambda w: w <> ''), lambda w: list_concat([lower(w)], list_transform({camel}, lambda p: lower(p)))))"
    snake = "list_filter(string_split_regex(s, '[_-]+'), lambda p: p <> '')"
    joined = f"CASE WHEN len({snake}) > 1 AND regexp_matches(array_to_string({snake}, ''), '^[a-zA-Z0-9]+$') THEN [lower(array_to_string({snake}, ''))] ELSE [] END"
    raw = rf"flatten(list_transform(list_filter(string_split_regex({v}, '[/\\]+'), lambda s: s <> ''), lambda s: list_concat({joined}, {words})))"
    return f"list_distinct(list_filter(flatten(list_transform({raw}, lambda k: [k, {sql_stem('k')}])), lambda k: k IS NOT NULL AND k <> '' AND NOT regexp_matches(k, '^[a-z]$')))"


STOP = _list(t.TASK_STOPWORDS)
TOKENS = f"list_filter({sql_tokens(repr(TASK))}, lambda k: NOT list_contains({STOP}, k))"
TRIGRAMS = lambda x: f"CASE WHEN length({x}) >= 3 THEN list_distinct(list_transform(range(1, length({x}) - 1), lambda i: lower({x})[i:i + 2])) ELSE [] END"


@query("tokenize_paths", with_views("paths", f"SELECT path, array_to_string(list_sort({sql_tokens('path')}), ' ') AS tokens FROM paths"))
def tokenize_paths(v: Views):
    """Tokens of all paths."""
    return v.files.select("path", F.array_join(F.array_sort(t.tokenize("path")), " ").alias("tokens"))


@query("task_tokens", with_views("docs", f"SELECT path, array_to_string(list_sort(list_filter({sql_tokens('title')}, lambda k: NOT list_contains({STOP}, k))), ' ') AS tokens FROM docs"))
def task_tokens(v: Views):
    """Task tokens of document titles."""
    return v.docs.select("path", F.array_join(F.array_sort(t.tokenize_task("title")), " ").alias("tokens"))


@query("plural_stem", f"SELECT DISTINCT w AS word, {sql_stem('w')} AS stem FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM documents)")
def plural_stem(v: Views):
    """Singulars of all ASCII words of the documents."""
    words = v.table("documents").select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("word")).distinct()
    return words.select("word", t.plural_stem("word").alias("stem"))


@query("trigram_similarity", with_views("paths", f"SELECT path, len(list_intersect({TRIGRAMS('name')}, {TRIGRAMS("'redwidgets'")})) / nullif(len(list_distinct(list_concat({TRIGRAMS('name')}, {TRIGRAMS("'redwidgets'")}))), 0)::DOUBLE AS sim FROM paths"))
def trigram_similarity(v: Views):
    """Trigram overlap of part names with one word."""
    return v._paths.select("path", t.jaccard(t.trigrams("name"), t.trigrams(F.lit("redwidgets"))).alias("sim"))


@query(
    "fuzzy_token_match",
    with_views(
        "paths",
        f"""q AS (SELECT unnest({TOKENS}) AS query), i AS (SELECT path AS id, unnest({sql_tokens('path')}) AS token FROM paths),
p AS (SELECT id, query, token, len(list_intersect({TRIGRAMS('token')}, {TRIGRAMS('query')})) AS k, len(list_distinct(list_concat({TRIGRAMS('token')}, {TRIGRAMS('query')}))) AS u FROM i, q)
SELECT id, query, max(k / u::DOUBLE) AS sim FROM p WHERE u > 0 AND k / u::DOUBLE >= 0.4 GROUP BY id, query""",
    ),
)
def fuzzy_token_match(v: Views):
    """Best fuzzy overlap of each file with each task token."""
    items = v.files.select(F.col("path").alias("id"), F.posexplode(t.tokenize("path")).alias("ordinal", "token"))
    queries = v.spark.range(1).select(F.explode(t.tokenize_task(F.lit(TASK))).alias("query"))
    return ranking.fuzzy_tokens(items, queries).select("id", "query", "sim")


_CODE = f"""tk AS (SELECT {TOKENS} AS tk),
own AS (SELECT path, 5 * len(list_intersect({sql_tokens('path')}, tk)) + CASE WHEN list_contains(tk, regexp_replace(string_split(path, '/')[-1], '\\.[a-z]+$', '')) THEN 4 ELSE 0 END AS s FROM paths, tk),
fn AS (SELECT file AS path, least(sum(len(list_intersect({sql_tokens('qualified_name')}, tk)) * CASE WHEN exported THEN 3 ELSE 1 END), 12) AS s FROM functions, tk GROUP BY file),
cc AS (SELECT DISTINCT string_split(from_key, '::')[1] AS a, string_split(to_key, '::')[1] AS b FROM file_calls),
con AS (SELECT a AS file, b AS other FROM cc WHERE a <> b UNION SELECT b, a FROM cc WHERE a <> b),
fan AS (SELECT string_split(to_key, '::')[1] AS path, max(n) AS n FROM (SELECT to_key, count(DISTINCT from_key) AS n FROM file_calls GROUP BY to_key) GROUP BY 1),
sc AS (SELECT own.path, own.s + coalesce(fn.s, 0) + CASE WHEN e.path IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN fan.n > 5 THEN 1 ELSE 0 END AS score FROM own LEFT JOIN fn USING (path) LEFT JOIN entry_files e USING (path) LEFT JOIN fan USING (path))"""
_DOC = f"ds AS (SELECT path, 8 * len(list_intersect({sql_tokens('title')}, tk)) + 5 * len(list_intersect({sql_tokens('path')}, tk)) + len(list_intersect({sql_tokens('body')}, tk)) AS score FROM docs, tk)"
_VIEWS = "files functions file_calls entry_files docs"
_ORDER = "ORDER BY score DESC, kind DESC, length(path), path LIMIT 60"


@query("fan_in", with_views("file_calls", "SELECT string_split(to_key, '::')[1] AS file, max(n) AS fan_in FROM (SELECT to_key, count(DISTINCT from_key) AS n FROM file_calls GROUP BY to_key) GROUP BY 1"))
def fan_in(v: Views):
    """Callers of each file's most called function."""
    return ranking.fan_in(v.file_calls)


@query("connected_files", with_views("file_calls", "cc AS (SELECT DISTINCT string_split(from_key, '::')[1] AS a, string_split(to_key, '::')[1] AS b FROM file_calls) SELECT a AS file, b AS other FROM cc WHERE a <> b UNION SELECT b, a FROM cc WHERE a <> b"))
def connected_files(v: Views):
    """Files that call each other."""
    return ranking.connected_files(v.file_calls)


@query("resolve_imports", with_views("files imports", "f AS (SELECT path, regexp_replace(path, '\\.[^./]+$', '') AS stem FROM files) SELECT i.from_path, i.to_path, min(f.path) AS target FROM imports i JOIN f ON f.path = i.to_path OR f.stem = i.to_path OR f.stem = i.to_path || '/index' GROUP BY i.from_path, i.to_path HAVING count(DISTINCT f.path) = 1"))
def resolve_imports(v: Views):
    """Imports that name one file."""
    return ranking.resolve_imports(v.imports, v.files).select("from_path", "to_path", "target")


@query("doc_score", with_views("docs", f"tk AS (SELECT {TOKENS} AS tk), {_DOC} SELECT path, score::DOUBLE AS score FROM ds WHERE score > 0"))
def doc_score(v: Views):
    """Documents by task tokens in title, path and body."""
    return ranking.doc_scores(v.docs, ranking.task_tokens(v.spark, TASK))


@query("suggest_fast", with_views(_VIEWS, f"{_CODE}, {_DOC} SELECT path, kind, score::DOUBLE AS score FROM (SELECT path, 'file' AS kind, score FROM sc WHERE score > 0 UNION ALL SELECT path, 'doc', score FROM ds WHERE score > 0) {_ORDER}"))
def suggest_fast(v: Views):
    """The pool of the fast ranker, before the second pass."""
    return ranking.suggest_fast(v.files, v.docs, v.functions, v.imports, v.file_calls, v.entry_files, TASK, limit=60, connected=False)


@query(
    "suggest_fast_second_pass",
    with_views(
        _VIEWS,
        f"""{_CODE}, {_DOC}, top AS (SELECT path FROM sc JOIN files USING (path) WHERE score > 0 ORDER BY score DESC, ordinal LIMIT 1),
more AS (SELECT other AS path FROM con JOIN top ON con.file = top.path),
s2 AS (SELECT coalesce(a.path, m.path) AS path, coalesce(a.score, 0) + CASE WHEN m.path IS NOT NULL THEN 2 ELSE 0 END AS score FROM (SELECT * FROM sc WHERE score > 0) a FULL JOIN more m ON a.path = m.path)
SELECT path, kind, score::DOUBLE AS score FROM (SELECT path, 'file' AS kind, score FROM s2 UNION ALL SELECT path, 'doc', score FROM ds WHERE score > 0) {_ORDER}""",
    ),
)
def suggest_fast_second_pass(v: Views):
    """The pool of the fast ranker."""
    return ranking.suggest_fast(v.files, v.docs, v.functions, v.imports, v.file_calls, v.entry_files, TASK, limit=60)


@query("suggest_anchored")
def suggest_anchored(v: Views):
    """The fast ranker from an anchor file: imports, calls and directory count as well. Tests compare it with a loop."""
    anchor = v.files.orderBy("ordinal").first().path
    return ranking.suggest_fast(v.files, v.docs, v.functions, v.imports, v.file_calls, v.entry_files, TASK, anchor=anchor, limit=60)


_NEEDLES = f"(SELECT {TOKENS})"


@query(
    "content_scan",
    with_views(
        "docs",
        f"""l AS (SELECT path, unnest(string_split(body, chr(10))) AS text, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line FROM docs WHERE strlen(body) <= 500000),
h AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM l WHERE len(list_filter({_list(TASK.split())}, lambda k: contains(lower(text), k))) > 0)
SELECT path, line::INT AS line FROM h WHERE n <= 3""",
    ),
)
def content_scan(v: Views):
    """First lines of documents that hold task tokens."""
    return ranking.content_hits(v.docs, ranking.task_tokens(v.spark, TASK)).select("path", "line")


@query("suggest_deep")
def suggest_deep(v: Views):
    """The deep ranker over files and documents; its parts have twins of their own."""
    return ranking.suggest_deep(v.files, v.docs, v.functions, v.imports, v.file_calls, v.entry_files, v.docs, TASK, limit=60, pool=200)


@query("entry_pick", with_views("entry_files files", "SELECT path, row_number() OVER (ORDER BY path) - 1 AS ordinal FROM entry_files ORDER BY 2 LIMIT 8"))
def entry_pick(v: Views):
    """The first eight entry files."""
    from pyspark.sql.window import Window

    c = v.entry_files.withColumn("ordinal", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("path")) - 1)
    return ranking.entry_pick(c, v.files)


def _re(p: str) -> str:
    """A Java pattern as RE2 text inside a string literal."""
    return p.replace("'", "''").replace("🧠", "🧠")


_B = "body"
_STANDING = f"regexp_matches({_B}, '{_re(rules.STANDING_DIRECTIVE)}')"
_m = lambda p: f"regexp_matches({_B}, '{_re(p)}')"
_T = r"regexp_replace(body, '^\s+|\s+$', '', 'g')"
_LINES = rf"list_filter(string_split({_T}, chr(10)), lambda x: regexp_matches(x, '\S'))"
_FIRST = rf"regexp_replace(lower(string_split_regex({_T}, '\s+')[1]), '[.,]$', '')"
_GATE = f"""CASE WHEN {_m(rules.INTERRUPT)} THEN 'interrupt-marker'
WHEN {_m(rules.ROLEPLAY_MARK)} OR {_m(rules.ROLEPLAY_VERB)} AND {_m(rules.ROLEPLAY_NOUN)} THEN 'duo-roleplay'
WHEN length({_T}) < 200 AND {_m(rules.RESUME)} AND NOT {_STANDING} THEN 'resume-kickoff'
WHEN length(regexp_extract(body, '{_re(rules.SCREENSHOT)}')) > length({_T}) * 0.5 THEN 'screenshot-path'
WHEN len({_LINES}) >= 3 AND len(list_filter({_LINES}, lambda x: regexp_matches(x, '{_re(rules.STRUCTURED_LINE)}'))) / len({_LINES}) > 0.6 THEN 'structured-blob'
WHEN {_m(rules.PASTED)} OR {_m(rules.PASTED_AGENTS)} THEN 'pasted-doc'
WHEN {_m(rules.PSEUDO)} THEN 'harness-pseudo-prompt'
WHEN {_m(rules.HANDOFF)} THEN 'workflow-handoff'
WHEN {_m(rules.FINDINGS)} OR {_m(rules.FINDINGS_ASK)} THEN 'findings-dump'
WHEN {_m(rules.ERROR_LOG)} OR {_m(rules.ERROR_START)} THEN 'error-log'
WHEN {_m(rules.UI_TWEAK)} AND NOT {_STANDING} THEN 'ui-micro-tweak'
WHEN list_contains({_list(rules.ACKNOWLEDGED)}, {_FIRST}) OR regexp_matches({_FIRST}, '^\\d+$') OR {_m(rules.CONTROL)} THEN 'process-control-or-vague-ack'
WHEN contains(body[1:200], '?') AND NOT {_STANDING} THEN 'question'
WHEN length({_T}) < 25 THEN 'filler' END"""
_SIGNAL = " + ".join(f"CASE WHEN {_m(p)} THEN 1 ELSE 0 END" for p in (rules.STANDING_DIRECTIVE, rules.RATIONALE, rules.CORRECTION_SHAPE))


@query("gate_reasons", with_views("turns", f"SELECT session, turn, {_GATE} AS reason FROM (SELECT session, turn, text AS body FROM turns)"))
def gate_reasons(v: Views):
    """The first structural rule that each turn meets."""
    return v.turns.select("session", "turn", rules.structural_reject("text").alias("reason"))


@query("signal_tier", with_views("turns", f"SELECT session, turn, s AS signal, CASE WHEN s >= 1 THEN 'high' ELSE 'low' END AS tier FROM (SELECT session, turn, {_SIGNAL} AS s FROM (SELECT session, turn, text AS body FROM turns))"))
def signal_tier(v: Views):
    """Signals of each turn."""
    return v.turns.select("session", "turn", rules.signal_score("text").alias("signal"), rules.capture_tier("text").alias("tier"))


@query("injected_prompts", with_views("turns", f"SELECT session, turn, len(list_filter({_list(rules.INJECTED_PREFIXES)}, lambda p: starts_with(ltrim(text), p))) > 0 OR regexp_matches(string_split(ltrim(text), chr(10))[1], '{_re(rules.SKILL_HEADING)}') AS injected FROM turns"))
def injected_prompts(v: Views):
    """Turns that a harness wrote."""
    return v.turns.select("session", "turn", rules.is_injected("text").alias("injected"))


@query("noise_reasons", with_views("memories", "SELECT status AS reason, false AS noise, count(*) AS n FROM memories GROUP BY status UNION ALL SELECT 'aging: low-signal capture', true, 1"))
def noise_reasons(v: Views):
    """Whether deprecation reasons are noise."""
    r = v.memories.groupBy(F.col("status").alias("reason")).agg(F.count(F.lit(1)).alias("n")).unionByName(v.spark.range(1).select(F.lit("aging: low-signal capture").alias("reason"), F.lit(1).cast("long").alias("n")))
    return r.select("reason", rules.is_noise_reason("reason").alias("noise"), "n")


@query("body_excerpt", with_views("docs", r"b AS (SELECT path, trim(regexp_replace(trim(body), '\s+', ' ', 'g')) AS b FROM docs) SELECT path, CASE WHEN length(b) <= 280 THEN b ELSE regexp_replace(b[1:280], '\s+\S*$', '') || '…' END AS excerpt FROM b"))
def body_excerpt(v: Views):
    """Excerpts of documents."""
    return v.docs.select("path", t.excerpt("body").alias("excerpt"))


@query("body_hashes", with_views("docs", "SELECT path, sha256(title || chr(10) || chr(10) || body) AS hash, sha256('lib' || chr(0) || path)[1:16] AS short FROM docs"))
def body_hashes(v: Views):
    """Digests and short ids of documents."""
    return v.docs.select("path", t.body_hash("title", "body").alias("hash"), t.short_hash(F.lit("lib"), "path").alias("short"))


_S = "trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')"
_CUT = "regexp_replace(s[1:40], '-[^-]*$', '')"


@query("slugs", with_views("docs", f"x AS (SELECT path, {_S} AS s FROM docs) SELECT path, CASE WHEN length(s) <= 40 THEN s WHEN length({_CUT}) >= 20 THEN {_CUT} ELSE regexp_replace(s[1:40], '-+$', '') END AS slug FROM x"))
def slugs(v: Views):
    """Slugs of document titles."""
    return v.docs.select("path", t.slug("title").alias("slug"))


@query("pattern_specificity", with_views("scope", "SELECT DISTINCT value, CASE WHEN NOT regexp_matches(value, '[\\]\\[*?{]') THEN 1000000000 + length(value) ELSE (length(regexp_extract(value, '^[^\\]\\[*?{]*'))) * 1000 - (length(value) - length(replace(value, '**', ''))) // 2 END AS specificity FROM scope"))
def pattern_specificity(v: Views):
    """Specificity of scope values."""
    return v.scope.select("value").distinct().select("value", t.pattern_specificity("value").alias("specificity"))


@query("doc_values", with_views("docs", "SELECT path, 'doc' AS kind, CASE WHEN regexp_matches(body, '(?im)^\\s*(?:status|version)\\s*:') THEN 1 ELSE 0 END AS has_status FROM docs"))
def doc_values(v: Views):
    """Kind and status header of documents."""
    return v.docs.select("path", t.doc_type("path").alias("kind"), t.doc_status("body").isNotNull().cast("int").alias("has_status"))


_NT = lambda x: f"list_distinct(list_filter(list_transform(string_split_regex(lower({x}), '[-_./\\s]+'), lambda k: CASE WHEN ends_with(k, 'ies') AND length(k) > 4 THEN k[:-4] || 'y' WHEN (ends_with(k, 'ses') OR ends_with(k, 'xes')) AND length(k) > 4 THEN k[:-3] WHEN (ends_with(k, 'ches') OR ends_with(k, 'shes')) AND length(k) > 5 THEN k[:-3] WHEN ends_with(k, 's') AND NOT ends_with(k, 'ss') AND length(k) > 2 THEN k[:-2] ELSE k END), lambda k: length(k) > 1))"


@query("tag_normalise", with_views("scope", f"SELECT DISTINCT value, array_to_string(list_sort({_NT('value')}), ' ') AS tokens FROM scope"))
def tag_normalise(v: Views):
    """Tokens of scope values."""
    return v.scope.select("value").distinct().select("value", F.array_join(F.array_sort(t.normalise_tag("value")), " ").alias("tokens"))


_TAGW = f"list_filter(string_split_regex(lower(body), '[^a-z0-9_-]+'), lambda w: length(w) >= 4 AND NOT list_contains({_list(t.TAG_STOPWORDS)}, w))"
TAGS_SQL = f"tg AS (SELECT id, unnest({_TAGW}) AS tag FROM memories), tc AS (SELECT id, tag, count(*) AS count FROM tg GROUP BY id, tag), tr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, tag) AS n FROM tc)"


@query("extract_tags", with_views("memories", f"{TAGS_SQL} SELECT id, n::INT AS n, tag, count FROM tr WHERE n <= 5"))
def extract_tags(v: Views):
    """Tags of all records."""
    return memory.extract_tags(spread(v.table("documents")).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body")))


@query("capture_titles")
def capture_titles(v: Views):
    """Sanitised titles of all turns; tests hold literal cases."""
    return v.turns.select("session", "turn", t.capture_title("text", "text").alias("title"))
