"""The driver's tables as the engine's relations, once for Spark and once, as SQL text, for the twins.

events are tool calls and surfacings, documents with labels are memories, embeddings are vectors, part gives files, functions and imports,
conversations are session turns, and orders, customers, suppliers, nations and regions make a call graph.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..operators.graph import shared_dir
from ..operators.search import write_index
from ..sources.spread import safe_unions, spread

_stored: dict[tuple[str, str], str] = {}

#: 2024-01-31 00:00 UTC in milliseconds: the `now` of all queries.
NOW_MS = 1_706_659_200_000
DAY_MS = 86_400_000
TASK = "red widget steel bolt thing"
TYPES = ("decision", "gotcha", "how-to", "constraint", "capture")
TOOLS = {"view": "recall_memory", "click": "get_memory", "purchase": "record_memory", "signup": "suggest_files", "error": "extract_session"}


#: Milliseconds of the events' times, which have no zone.
MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"


@dataclass(frozen=True)
class Views:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        safe_unions(self.spark)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored_texts(self) -> str:
        """Where the positional index of the documents is: written once for a session and a folder of tables, then read by every search."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _stored:
            path = f"{shared_dir(self.spark)}/text-index-{uuid.uuid4().hex}"
            write_index(self.texts, path)
            _stored[key] = path
        return _stored[key]

    def stored_vectors(self) -> str:
        """Where the cell index of the vectors is, likewise."""
        key = (self.spark.sparkContext.applicationId, f"{self.sf_dir}#vectors")
        if key not in _stored:
            path = f"{shared_dir(self.spark)}/vector-index-{uuid.uuid4().hex}"
            vectors.write_index(self.vectors, path)
            _stored[key] = path
        return _stored[key]

    @property
    def texts(self) -> DataFrame:
        return self.table("documents").select("source", F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    # -- calls of tools -------------------------------------------------------------------------------------------------
    @property
    def tool_calls(self) -> DataFrame:
        return self.calls_of(self.table("events"))

    @staticmethod
    def calls_of(e: DataFrame) -> DataFrame:
        """Events, of a table or a stream, as calls of tools."""
        tool = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in TOOLS.items()))
        return e.select(
            "event_id",
            F.expr(MILLIS).alias("ts"),
            tool.alias("tool"),
            F.col("value").alias("dur_ms"),
            F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
            F.when(F.col("event_id") % 3 == 0, "fresh").when(F.col("event_id") % 3 == 1, "reindexed").otherwise("stale").alias("cache_status"),
            F.get_json_object("props", "$.k").cast("int").alias("result_count"),
            F.when(F.col("event_id") % 20 == 0, 1).otherwise(0).alias("synthetic"),
            F.when(F.col("event_id") % 17 != 0, F.col("user_id").cast("string")).alias("session_id"),
            (F.col("user_id") % 8).alias("repo_key"),
        )

    @property
    def surface(self) -> DataFrame:
        e = self.table("events").where("event_type in ('signup', 'purchase')")
        return e.select(F.col("event_id").alias("ordinal"), F.expr(MILLIS).alias("ts"), F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 50).alias("memory_id"), F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("file"))

    @property
    def gets(self) -> DataFrame:
        e = self.table("events").where("event_type = 'click'")
        return e.select(F.expr(MILLIS).alias("ts"), F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 50).alias("memory_id"))

    # -- structure ------------------------------------------------------------------------------------------------------
    @property
    def _paths(self) -> DataFrame:
        name = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))), "")
        return self.table("part").select("p_partkey", "p_size", name.alias("name"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("/"), name, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"))

    @property
    def files(self) -> DataFrame:
        return self._paths.select("path", F.col("p_partkey").alias("ordinal"), F.sha2("name", 256).alias("content_hash"))

    @property
    def functions(self) -> DataFrame:
        return self._paths.where("p_partkey % 3 = 0").select(F.concat(F.lit("make"), "name").alias("qualified_name"), F.col("path").alias("file"), (F.col("p_size") % 2 == 0).alias("exported"))

    @property
    def imports(self) -> DataFrame:
        p = self._paths
        n = p.agg(F.count(F.lit(1)).alias("n"))
        to = p.select(F.col("p_partkey").alias("to"), F.regexp_replace("path", r"\.ts$", "").alias("to_path"))
        return p.crossJoin(F.broadcast(n)).select(F.col("path").alias("from_path"), ((F.col("p_partkey") * 3 + 1) % F.col("n")).alias("to")).join(to.hint("merge"), "to").select("from_path", "to_path")

    @property
    def file_calls(self) -> DataFrame:
        p = self._paths
        n = p.agg(F.count(F.lit(1)).alias("n"))
        to = p.select(F.col("p_partkey").alias("to"), F.concat("path", F.lit("::make"), "name").alias("to_key"))
        calls = p.crossJoin(F.broadcast(n)).select(F.concat("path", F.lit("::make"), "name").alias("from_key"), ((F.col("p_partkey") % 97) * 7 % F.col("n")).alias("to"))
        return calls.join(to.hint("merge"), "to").select("from_key", "to_key")

    @property
    def entry_files(self) -> DataFrame:
        return self._paths.where("p_partkey % 50 = 0").select("path")

    @property
    def docs(self) -> DataFrame:
        return spread(self.table("documents")).select(F.concat(F.lit("docs/"), "source", F.lit("/note_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), F.coalesce("text", F.lit("")).alias("body"))

    @property
    def calls(self) -> DataFrame:
        key = lambda k, c: F.concat(F.lit(f"{k}::{k[0]}"), F.col(c).cast("string"))
        pairs = (("orders", "o_orderkey", "customer", "o_custkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "n_nationkey", "region", "n_regionkey"))
        out = None
        for a, ak, b, bk in pairs:
            df = self.table(a).select(key(a, ak).alias("from_key"), key(b, bk).alias("to_key"))
            out = df if out is None else out.unionByName(df)
        loose = self.table("supplier").select(key("supplier", "s_suppkey").alias("from_key"), F.concat(F.lit("::n"), F.col("s_nationkey").cast("string")).alias("to_key"))
        return out.unionByName(loose)

    @property
    def cyclic(self) -> DataFrame:
        s = self.table("supplier")
        n = s.agg(F.count(F.lit(1)).alias("n"))
        return s.crossJoin(F.broadcast(n)).select(F.concat(F.lit("s::"), F.col("s_suppkey").cast("string")).alias("from_key"), F.concat(F.lit("s::"), ((F.col("s_suppkey") * 7 + 1) % F.col("n")).cast("string")).alias("to_key"))

    # -- records --------------------------------------------------------------------------------------------------------
    @property
    def memories(self) -> DataFrame:
        d = self.table("documents").join(self.table("labels"), "doc_id", "left")
        kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
        return d.select(
            F.col("doc_id").alias("id"),
            kind.alias("type"),
            F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "candidate").when(F.col("doc_id") % 3 == 0, "deprecated").when(F.col("doc_id") % 3 == 1, "merged_into").otherwise("trashed").alias("status"),
            F.coalesce("text", F.lit("")).alias("body"),
            F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("title"),
            ((F.col("doc_id") % 100) / 100).alias("confidence"),
            (F.col("doc_id") % 11 == 0).alias("pinned"),
            (F.lit(NOW_MS) - (F.col("doc_id") % 400) * DAY_MS).alias("updated_ms"),
            (F.lit(NOW_MS) - (F.col("doc_id") % 90) * DAY_MS).alias("last_accessed_ms"),
            F.when(F.col("doc_id") % 13 == 0, F.lit(NOW_MS)).alias("rewritten_ms"),
            (F.col("doc_id") % 23).alias("get_count"),
            F.col("source").alias("repo"),
        )

    @property
    def scope(self) -> DataFrame:
        m = self.table("documents").select("doc_id", "source", "lang")
        tag = m.where("doc_id % 2 = 0").select(F.col("source").alias("repo"), F.col("doc_id").alias("memory_id"), F.lit("tag").alias("kind"), F.concat("lang", F.lit("-services"), (F.col("doc_id") % 40).cast("string")).alias("value"))
        file = m.where("doc_id % 3 = 0").select(F.col("source").alias("repo"), F.col("doc_id").alias("memory_id"), F.lit("file").alias("kind"), F.when(F.col("doc_id") % 30 == 0, F.concat(F.lit("src/"), "lang", F.lit("/**"))).otherwise(F.concat(F.lit("src/"), "lang", F.lit("/f"), (F.col("doc_id") % 20).cast("string"), F.lit(".ts"))).alias("value"))
        return tag.unionByName(file)

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))

    @property
    def query_vector(self) -> list[float]:
        return [float(x) for x in self.vectors.where("id = 0").first().vec]

    # -- sessions -------------------------------------------------------------------------------------------------------
    @property
    def turns(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("session"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    @property
    def touches(self) -> DataFrame:
        return self.table("conversations").where("(conv_id * 7 + turn) % 5 = 0").select(F.col("conv_id").alias("session"), "turn", F.concat(F.lit("src/f"), (F.col("turn") % 3).cast("string"), F.lit(".ts")).alias("path"))


_TOOL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOOLS.items()) + " END"
_TYPE = f"[{', '.join(repr(x) for x in TYPES)}]"
_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')"
#: The same relations as common table expressions.
SQL = {
    "tool_calls": f"SELECT event_id, epoch_us(ts) // 1000 AS ts, {_TOOL} AS tool, value AS dur_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE event_id % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'reindexed' ELSE 'stale' END AS cache_status, CAST(json_extract_string(props, '$.k') AS INT) AS result_count, CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS synthetic, CASE WHEN event_id % 17 != 0 THEN user_id::VARCHAR END AS session_id, user_id % 8 AS repo_key FROM events",
    "surface": "SELECT event_id AS ordinal, epoch_us(ts) // 1000 AS ts, user_id::VARCHAR AS session_id, event_id % 50 AS memory_id, 'f' || (event_id % 7) AS file FROM events WHERE event_type IN ('signup', 'purchase')",
    "gets": "SELECT epoch_us(ts) // 1000 AS ts, user_id::VARCHAR AS session_id, event_id % 50 AS memory_id FROM events WHERE event_type = 'click'",
    "paths": f"SELECT p_partkey, p_size, {_NAME} AS name, 'src/' || lower(p_type) || '/' || replace(p_brand, '#', '_') || '/' || {_NAME} || '_' || p_partkey || '.ts' AS path FROM part",
    "files": "SELECT path, p_partkey AS ordinal, sha256(name) AS content_hash FROM paths",
    "functions": "SELECT 'make' || name AS qualified_name, path AS file, p_size % 2 = 0 AS exported FROM paths WHERE p_partkey % 3 = 0",
    "imports": "SELECT a.path AS from_path, regexp_replace(b.path, '\\.ts$', '') AS to_path FROM paths a JOIN paths b ON b.p_partkey = (a.p_partkey * 3 + 1) % (SELECT count(*) FROM part)",
    "file_calls": "SELECT a.path || '::make' || a.name AS from_key, b.path || '::make' || b.name AS to_key FROM paths a JOIN paths b ON b.p_partkey = (a.p_partkey % 97) * 7 % (SELECT count(*) FROM part)",
    "entry_files": "SELECT path FROM paths WHERE p_partkey % 50 = 0",
    "docs": "SELECT 'docs/' || source || '/note_' || doc_id || '.md' AS path, string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(text, '') AS body FROM documents",
    "calls": " UNION ALL ".join(f"SELECT '{a}::{a[0]}' || {ak} AS from_key, '{b}::{b[0]}' || {bk} AS to_key FROM {a}" for a, ak, b, bk in (("orders", "o_orderkey", "customer", "o_custkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "n_nationkey", "region", "n_regionkey"))) + " UNION ALL SELECT 'supplier::s' || s_suppkey, '::n' || s_nationkey FROM supplier",
    "cyclic": "SELECT 's::' || s_suppkey AS from_key, 's::' || ((s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier)) AS to_key FROM supplier",
    "memories": f"SELECT doc_id AS id, ({_TYPE})[doc_id % 5 + 1] AS type, CASE WHEN quality = 1 THEN 'active' WHEN quality = 0 THEN 'candidate' WHEN doc_id % 3 = 0 THEN 'deprecated' WHEN doc_id % 3 = 1 THEN 'merged_into' ELSE 'trashed' END AS status, coalesce(text, '') AS body, 'note ' || doc_id AS title, (doc_id % 100) / 100.0::DOUBLE AS confidence, doc_id % 11 = 0 AS pinned, {NOW_MS} - (doc_id % 400) * {DAY_MS} AS updated_ms, {NOW_MS} - (doc_id % 90) * {DAY_MS} AS last_accessed_ms, CASE WHEN doc_id % 13 = 0 THEN {NOW_MS} END AS rewritten_ms, doc_id % 23 AS get_count, source AS repo FROM documents LEFT JOIN labels USING (doc_id)",
    "scope": "SELECT source AS repo, doc_id AS memory_id, 'tag' AS kind, lang || '-services' || (doc_id % 40) AS value FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, doc_id, 'file', CASE WHEN doc_id % 30 = 0 THEN 'src/' || lang || '/**' ELSE 'src/' || lang || '/f' || (doc_id % 20) || '.ts' END FROM documents WHERE doc_id % 3 = 0",
    "vectors": "SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings",
    "turns": "SELECT conv_id AS session, turn, role, coalesce(text, '') AS text FROM conversations",
    "touches": "SELECT conv_id AS session, turn, 'src/f' || (turn % 3) || '.ts' AS path FROM conversations WHERE (conv_id * 7 + turn) % 5 = 0",
}
_NEEDS = {name: ("paths",) for name in ("files", "functions", "imports", "file_calls", "entry_files")}


def with_views(names: str, sql: str, recursive: bool = False) -> str:
    """sql after the named relations; `sql` may begin with expressions of its own, ended by a line that starts with SELECT."""
    wanted: list[str] = []
    for name in names.split():
        for n in (*_NEEDS.get(name, ()), name):
            if n not in wanted:
                wanted.append(n)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    body = sql.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
