"""Scans of files and records, and their sinks. Everything is read and written by Spark's own readers and writers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

#: Folders and files that scans pass over.
PRUNED = "node_modules dist build out .next .svelte-kit .turbo coverage vendor .venv venv target .cache .git .worktrees release tmp".split()
DOC_EXTENSIONS = "md mdx markdown txt rst adoc".split()
SECRET = r"(^|/)\.env[^/]*$|(^|/)[^/]*(secret|credential)[^/]*$|(^|/)[^/]*\.key[^/]*$"
MOST_BYTES, BINARY_HEAD = 1_000_000, 8000
STORE = "^([0-9a-f]{16}|global)$"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, content) of all files below root, without pruned folders; path is relative. Spark passes over names that begin with a dot or an underscore."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(base)}/", "")
    pruned = "(^|/)(" + "|".join(map(re.escape, PRUNED)) + ")/"
    return raw.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), "content").where(~F.col("path").rlike(pruned))


def texts(scanned: DataFrame) -> DataFrame:
    """(path, body, content_hash) of files that are valid UTF-8."""
    return scanned.where(F.expr("is_valid_utf8(content)")).select("path", F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("content_hash"))


def documents(scanned: DataFrame, include: str | None = None, exclude: str | None = None, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents (path, body, content_hash, modified) and what was skipped (path, reason). An owner's exclude beats include, which beats the patterns of secrets."""
    p = F.col("path")
    own = scanned.where(F.lower(p).rlike(r"\.(" + "|".join(DOC_EXTENSIONS) + ")$"))
    if exclude:
        own = own.where(~p.rlike(exclude))
    own = own.where((p.rlike(include) if include else F.lit(False)) | ~F.lower(p).rlike(SECRET))
    head = F.hex(F.substring(F.col("content"), 1, BINARY_HEAD))
    reason = F.when(F.col("length") > most, "oversize").when(head.rlike("^(?:..)*?00"), "binary").when(~F.expr("is_valid_utf8(content)"), "non-utf8")
    judged = own.withColumn("reason", reason)
    return judged.where("reason is null").select("path", F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).alias("content_hash"), "modified"), judged.where("reason is not null").select("path", "reason")


def load_docs(files: DataFrame, limit: int = 8) -> DataFrame:
    """(path, title, body, score) of the Markdown files worth reading first."""
    p = F.lower("path")
    score = F.when(p.rlike(r"(^|/)readme\.md$"), 100).when(p.contains("architecture"), 90).when(p.contains("plan"), 80).when(p.startswith("docs/shared/"), 70).otherwise(10)
    title = F.regexp_extract("body", "(?m)^# (.*)$", 1)
    return files.where(p.endswith(".md")).select("path", F.when(title == "", F.col("path")).otherwise(F.trim(title)).alias("title"), "body", score.alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def manifests(files: DataFrame) -> DataFrame:
    """(path, name, version, main, module, framework) of package manifests; electron before next before vite."""
    j = F.from_json("body", "name string, version string, main string, module string, dependencies map<string,string>, devDependencies map<string,string>")
    m = files.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("m", j)
    has = lambda n: F.coalesce(F.map_contains_key("m.dependencies", n), F.lit(False)) | F.coalesce(F.map_contains_key("m.devDependencies", n), F.lit(False))
    return m.select("path", "m.name", "m.version", "m.main", "m.module", F.when(has("electron"), "electron").when(has("next"), "next").when(has("vite"), "vite").alias("framework"))


def write_store(df: DataFrame, path: str, keys: tuple[str, ...] = ("repo_key",)) -> None:
    """Replaces the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_store(spark: SparkSession, path: str, repo_key: str | None = None) -> DataFrame:
    """A store, of one repository if given: only its partition is read."""
    df = spark.read.parquet(path)
    return df if repo_key is None else df.where(F.col("repo_key") == repo_key)


def stores(df: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Keys of stores: sixteen hexadecimal digits, or global."""
    return df.select("repo_key").distinct().where(F.col("repo_key").rlike(STORE) & ~F.col("repo_key").isin(*without))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): each file whole, its lines numbered from 0; one file is one session's log."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.length(F.trim("value")) > 0)


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed lines (path, line, fields of schema); broken ones are left out."""
    parsed = lines.withColumn("j", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where(F.try_parse_json("value").isNotNull() & F.col("j").isNotNull())
    return parsed.select("path", "line", "j.*")


TRANSCRIPT = "type string, turn int, isSidechain boolean, isCompactSummary boolean, summary string, message struct<role:string,content:string>, payload struct<type:string,role:string,content:string,message:string>"


def transcripts(lines: DataFrame) -> DataFrame:
    """(session, turn, role, text, tool_uses, is_summary) of session logs in either dialect. Side chains are dropped; a line without a turn of its own has its number among the parsed lines."""
    rows = json_lines(lines, TRANSCRIPT).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1).where("not coalesce(isSidechain, false)")
    blocks = "array<struct<type:string,text:string,name:string,input:string,id:string>>"
    content = F.coalesce("message.content", "payload.content", "payload.message", "summary")
    parts = F.from_json(content, blocks)
    listed = content.startswith("[") & parts.isNotNull()
    text = F.when(listed, F.array_join(F.transform(F.filter(parts, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: b["text"]), "\n")).otherwise(content)
    uses = F.when(listed, F.transform(F.filter(parts, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("name"), b["input"].alias("args"))))
    role = F.coalesce("message.role", "payload.role", F.when(F.col("type").isin("user", "assistant", "system"), F.col("type")).when(F.col("type") == "summary", "system"))
    out = rows.select(F.regexp_extract("path", r"([^/]+?)(?:\.jsonl?)?$", 1).alias("session"), F.coalesce("turn", "n").alias("turn"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"), uses.alias("tool_uses"), F.coalesce("isCompactSummary", F.col("type") == "summary").alias("is_summary"))
    return out.where("role is not null")


def events(lines: DataFrame, schema: str, now_ms: int, days: int = 90) -> DataFrame:
    """Events of a log that are not older than `days`."""
    return json_lines(lines, schema).where(F.col("ts") >= now_ms - days * 86_400_000)


def vectors(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """Stored vectors of one model; those of a wrong length or with gaps are left out."""
    df = spark.read.parquet(path).where(F.col("model") == model)
    return df.where((F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x.cast("double"))))


MEMORY = "id string, type string, status string, title string, version int, created_at string, updated_at string, source string, confidence double, pinned boolean, tags array<string>, files array<string>, body string"


def memory_markdown(files: DataFrame) -> DataFrame:
    """Records of Markdown files (path, body) with a header of `key: value` lines, lists in brackets or by dashes; files without a header are left out."""
    lists = ("tags", "files")

    def value(x: str):
        x = x.strip()
        if x[:1] in "[{\"":
            try:
                return json.loads(x)
            except ValueError:
                pass
        return [p.strip().strip("'\"") for p in x[1:-1].split(",") if p.strip()] if x[:1] == "[" else x.strip("'\"")

    def one(body: str) -> dict | None:
        m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?(.*)\Z", body or "", re.S)
        if not m:
            return None
        out: dict = {"body": m[2].lstrip("\n")}
        key = None
        for line in m[1].split("\n"):
            if (item := re.match(r"\s+-\s+(.*)$", line)) and key:
                out[key] = [*(out[key] if isinstance(out.get(key), list) else []), value(item[1])]
            elif pair := re.match(r"(\w+):\s*(.*)$", line.rstrip()):
                key = pair[1]
                out[key] = value(pair[2]) if pair[2] else []
        return out

    def run(batches):
        names = MEMORY.replace(",", "").split()[::2]
        for pdf in batches:
            rows = [r for r in map(one, pdf["body"]) if r]
            df = pd.DataFrame([{n: r.get(n) if r.get(n) != [] or n in lists else None for n in names} for r in rows], columns=names)
            for c in lists:
                df[c] = df[c].map(lambda x: x if isinstance(x, list) else [] if x is None or x != x else [x])
            df["version"] = pd.to_numeric(df["version"], errors="coerce").astype("Int32")
            df["confidence"] = pd.to_numeric(df["confidence"], errors="coerce")
            df["pinned"] = df["pinned"].map(lambda x: str(x).lower() == "true").astype(bool)
            yield df

    return files.select("body").mapInPandas(run, MEMORY)


def memory_export(memories: DataFrame) -> DataFrame:
    """(id, value): records as Markdown with a header; what memory_markdown reads."""
    keys = ("id", "type", "status", "title", "version", "created_at", "updated_at", "source", "confidence", "pinned")
    head = F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.to_json(F.array(F.col(k).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(k).cast("string")))) - 2)) for k in keys), F.concat(F.lit("tags: "), F.to_json("tags")), F.concat(F.lit("files: "), F.to_json("files")))
    return memories.select("id", F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), "body").alias("value"))


def register_source(sources: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (source, root) with new ones in place of those of the same id, and pairs whose roots lie in one another."""
    out = sources.join(new.select("source"), "source", "left_anti").select(sources.columns).unionByName(new.select(sources.columns))
    a, b = out.alias("a"), out.alias("b")
    inside = F.startswith(F.concat("b.root", F.lit("/")), F.concat("a.root", F.lit("/"))) & (F.col("a.source") != F.col("b.source"))
    return out, a.join(b, inside).select(F.col("a.source").alias("outer"), F.col("b.source").alias("inner"))


def remove_source(sources: DataFrame, source: str) -> DataFrame:
    """The registry without a source; as it was if there is none of that id."""
    return sources.where(F.col("source") != source)


def update_source(sources: DataFrame, source: str, values: dict) -> DataFrame:
    """The registry with some columns of a source changed; its id stays."""
    own = {c: F.when(F.col("source") == source, F.lit(x)).otherwise(F.col(c)) for c, x in values.items() if c != "source"}
    return sources.withColumns(own) if own else sources


def write_sessions(stored: DataFrame, captured: DataFrame) -> DataFrame:
    """Session records (session, ...) after a capture: a session's newest record replaces the one before."""
    return captured.unionByName(stored.join(captured.select("session"), "session", "left_anti").select(captured.columns))


def write_chunks(stored: DataFrame, captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (session, id, text, vec) after a capture of chunks (session, id, text), and those of them that need a vector: a chunk whose
    text the session had before keeps its vector, wherever it stood. Other sessions' chunks stay."""
    digest = F.sha2("text", 256)
    have = stored.select("session", digest.alias("digest"), "vec").groupBy("session", "digest").agg(F.first("vec", ignorenulls=True).alias("vec"))
    now = captured.select("session", "id", "text", digest.alias("digest")).join(have, ["session", "digest"], "left").select("session", "id", "text", "vec")
    rest = stored.join(captured.select("session").distinct(), "session", "left_anti").select("session", "id", "text", "vec")
    return rest.unionByName(now), now.where("vec is null").select("session", "id", "text")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value): a JSON text for each node and edge, for a writer of lines."""
    one = lambda df, k: df.select(F.lit(k).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value"))
    return one(nodes, "node").unionByName(one(edges, "edge"))
