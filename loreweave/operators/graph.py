"""Reachability over calls, and the edges and nodes of the project graph."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from . import pairs

SYMBOL_LIMIT = 3500
LEAST_SIMILARITY, NEIGHBOURS = 0.65, 2
#: Hops of a search that are planned at once.
UNROLLED = 5
_own_dir: list[str] = []
#: Vectors in a part of the search for edges, at least.
BLOCK = 2048
#: Values of a record that stand in each of its rows, at most; members of a block and of a part of records that share a value; tasks for each core.
WIDE, MEMBERS, PART, TASKS_EACH = 64, 128, 4096, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a local master; on a cluster that is an error, as its
    machines don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="loreweave-"))
        folder = _own_dir[0]
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: a loop's lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blast_radius(calls: DataFrame, targets: DataFrame, max_hops: int = 5) -> DataFrame:
    """(target, key, hop): every caller that reaches a target over resolved calls, with the fewest hops.

    calls (from_key, to_key), targets (target). All targets at once; the target itself is hop 0 and left out. Up to UNROLLED hops are one lazy
    plan: each hop's pairs are distinct and made once (its exchange is reused by the next hop and by the result), and the fewest hops count.
    Deeper searches write each hop's frontier, drop what was seen, and end when nothing new is found.
    """
    if max_hops <= UNROLLED:
        edges = calls.where(~F.col("to_key").startswith("::")).select(F.col("to_key").alias("key"), "from_key").distinct()
        walks, found = targets.select("target", F.col("target").alias("key")).distinct(), []
        for hop in range(1, max_hops + 1):
            walks = walks.join(edges, "key").select("target", F.col("from_key").alias("key")).where("key != target").distinct()
            found.append(walks.withColumn("hop", F.lit(hop)))
        every = functools.reduce(DataFrame.unionByName, found) if found else walks.withColumn("hop", F.lit(0)).limit(0)
        return every.groupBy("target", "key").agg(F.min("hop").alias("hop"))
    edges = cut(calls.where(~F.col("to_key").startswith("::")).select("from_key", "to_key").distinct(), "calls")
    seen = frontier = cut(targets.select("target", F.col("target").alias("key"), F.lit(0).alias("hop")).distinct(), "hop")
    for hop in range(1, max_hops + 1):
        found = frontier.join(edges, frontier.key == edges.to_key).select("target", F.col("from_key").alias("key")).distinct()
        frontier = cut(found.join(seen, ["target", "key"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def blast_report(calls: DataFrame, functions: DataFrame, targets: DataFrame, max_hops: int = 5) -> DataFrame:
    """blast_radius with file, name, exported (of any definition), and the first call site on a key one hop nearer; ordered by hop, file, name within a target."""
    hit = blast_radius(calls, targets, max_hops)
    out = hit.withColumns({"file": t.key_file("key"), "name": t.key_name("key")})
    marks = functions.groupBy(F.concat_ws("::", "file", "qualified_name").alias("key")).agg(F.max("exported").alias("exported"))
    out = out.join(marks, "key", "left").withColumn("exported", F.coalesce("exported", F.lit(False)))
    if "line" in calls.columns:
        nearer = hit.select("target", F.col("key").alias("to_key"), (F.col("hop") + 1).alias("hop")).unionByName(targets.select("target", F.col("target").alias("to_key"), F.lit(1).alias("hop")))
        site = calls.join(nearer, "to_key").groupBy("target", "hop", F.col("from_key").alias("key")).agg(F.min(F.struct("line", "col")).alias("call_site"))
        out = out.join(site, ["target", "hop", "key"], "left")
    return out


def unresolved(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """target, unresolved, confidence: unresolved calls of the target's name, or of its last part if that is dotted."""
    names = targets.select("target", F.element_at(F.split(t.key_name("target"), r"\."), -1).alias("name"))
    loose = calls.where(F.col("to_key").startswith("::")).select(F.element_at(F.split(t.key_name("to_key"), r"\."), -1).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    out = names.join(loose, "name", "left").select("target", F.coalesce("n", F.lit(0)).alias("unresolved"))
    return out.withColumn("confidence", F.when(F.col("unresolved") == 0, "full").otherwise("partial"))


def overloads(functions: DataFrame) -> DataFrame:
    """key, n of names defined more than once in a file."""
    return functions.groupBy(F.concat_ws("::", "file", "qualified_name").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def file_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """source, target of imports that resolve to one file; repeated edges once, externals dropped."""
    from .ranking import resolve_imports

    return resolve_imports(imports, files).select(F.col("from_path").alias("source"), F.col("target")).distinct()


def symbol_edges(calls: DataFrame) -> DataFrame:
    """source, target, kind of resolved calls."""
    return calls.where(~F.col("to_key").startswith("::")).select(F.col("from_key").alias("source"), F.col("to_key").alias("target"), "kind").distinct()


def project_graph(files: DataFrame, imports: DataFrame, functions: DataFrame, calls: DataFrame, symbols: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and edges (source, target, rel) of a project; symbols only up to SYMBOL_LIMIT of them unless asked for."""
    nodes = files.select(t.node_id("file", "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("label"))
    edges = file_edges(imports, files).select(t.node_id("file", "source").alias("source"), t.node_id("file", "target").alias("target"), F.lit("imports").alias("rel"))
    if symbols == "on" or symbols == "auto" and functions.count() <= SYMBOL_LIMIT:
        key = F.concat_ws("::", "file", "qualified_name")
        nodes = nodes.unionByName(functions.select(t.node_id("symbol", key).alias("id"), F.lit("symbol").alias("kind"), F.col("qualified_name").alias("label")).distinct())
        edges = edges.unionByName(symbol_edges(calls).select(t.node_id("symbol", "source").alias("source"), t.node_id("symbol", "target").alias("target"), F.lit("calls").alias("rel")))
        edges = edges.unionByName(functions.select(t.node_id("file", "file").alias("source"), t.node_id("symbol", key).alias("target"), F.lit("contains").alias("rel")).distinct())
    return nodes, present_edges(edges, nodes)


def node_details(ids: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, kind, repo, label, fields) of node ids kind:repo:rest. Of memories by their record, which has to be there; of files, directories,
    symbols and projects by the id itself. memories (repo, id, title, type, status, excerpt); ids that are none are left out."""
    of = lambda k: F.regexp_extract("id", "(?s)^([a-z]+):([^:]*):(.*)$", k)
    x = ids.select("id", of(1).alias("kind"), of(2).alias("repo"), of(3).alias("rest")).where(F.col("kind").isin("memory", "file", "dir", "symbol", "project"))
    m = memories.select(F.col("repo"), F.col("id").cast("string").alias("rest"), "title", F.create_map(F.lit("type"), "type", F.lit("status"), "status", F.lit("excerpt"), "excerpt").alias("fields"))
    own = x.where("kind = 'memory'").join(m, ["repo", "rest"]).select("id", "kind", "repo", F.col("title").alias("label"), "fields")
    symbol = F.when(F.col("rest").contains("::"), F.create_map(F.lit("file"), F.substring_index("rest", "::", 1), F.lit("name"), F.expr("substring(rest, instr(rest, '::') + 2)"))).otherwise(F.create_map(F.lit("name"), "rest"))
    other = x.where("kind != 'memory'").select("id", "kind", "repo", F.when(F.col("rest") == "", F.col("repo")).otherwise(F.col("rest")).alias("label"), F.when(F.col("kind") == "symbol", symbol).otherwise(F.create_map(F.lit("path"), "rest")).alias("fields"))
    return own.unionByName(other)


def cluster_labels(projects: DataFrame, memories: DataFrame) -> DataFrame:
    """(repo, label): the last part of a project's path (repo, worktree), or eight characters of its key; stores of records alone by their key."""
    short, last = F.substring("repo", 1, 8), F.try_element_at(F.filter(F.split("worktree", "/"), lambda x: x != ""), F.lit(-1))
    code = projects.select("repo", F.coalesce(last, short).alias("label"))
    rest = memories.select("repo").distinct().join(code, "repo", "left_anti").select("repo", F.when(F.col("repo") == "global", "global").otherwise(short).alias("label"))
    return code.distinct().unionByName(rest)


def build(mode: str, store: dict[str, DataFrame], repo: str | None = None, semantic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and edges (source, target, rel) of a view of all stores or of one.

    memory: records with their links and shared scopes, and on demand similar ones; file: files with their imports; dir: top
    directories with the edges between them; bridge: records anchored to files. store: files and imports, or memories (id, title, repo), links, scope and vectors.
    """
    own = lambda k: store[k] if repo is None or "repo" not in store[k].columns else store[k].where(F.col("repo") == repo)
    if mode in ("memory", "bridge"):
        m = own("memories").select("id", "title", "repo")
        nodes = m.select(F.concat_ws(":", F.lit("memory"), "repo", "id").alias("id"), F.lit("memory").alias("kind"), F.col("title").alias("label"))
        name = lambda df, a, b, rel: df.join(m.select(F.col("id").alias(a), F.concat_ws(":", F.lit("memory"), "repo", "id").alias("s")), a).join(m.select(F.col("id").alias(b), F.concat_ws(":", F.lit("memory"), "repo", "id").alias("t")), b).select(F.col("s").alias("source"), F.col("t").alias("target"), rel.alias("rel"))
        if mode == "bridge":
            files = own("files")
            at = anchor_edges(own("scope"), files)
            edges = at.select(F.concat_ws(":", F.lit("memory"), "repo", "source").alias("source"), F.concat_ws(":", F.lit("file"), "repo", "target").alias("target"), F.lit("anchors").alias("rel"))
            anchored = files.select(F.concat_ws(":", F.lit("file"), "repo", "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("label"))
            return nodes.join(edges.select(F.col("source").alias("id")), "id", "left_semi").unionByName(anchored.join(edges.select(F.col("target").alias("id")), "id", "left_semi")), edges
        edges = name(link_edges(store["links"], m), "source", "target", F.col("rel")).unionByName(name(scope_edges(own("scope")), "source", "target", F.lit("scope")))
        if semantic:
            edges = edges.unionByName(name(semantic_edges(store["vectors"].join(m, "id", "left_semi")), "source", "target", F.lit("semantic")))
        return nodes, edges
    if mode == "file":
        return project_graph(own("files"), own("imports"), store["functions"], store["calls"], "off")
    if mode == "dir":
        nodes, edges = dir_rollup(own("files"), file_edges(own("imports"), own("files")))
        return nodes.select(t.node_id("dir", "dir").alias("id"), F.lit("dir").alias("kind"), F.col("dir").alias("label")), edges.select(t.node_id("dir", "source").alias("source"), t.node_id("dir", "target").alias("target"), F.lit("imports").alias("rel"))
    raise ValueError(f"mode has to be memory, bridge, file or dir, not {mode!r}")


def present_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = lambda c: nodes.select(F.col("id").alias(c)).hint("merge")  # nodes grow with the project, and their packed columns look small
    return edges.join(ids("source"), "source", "left_semi").join(ids("target"), "target", "left_semi").select(edges.columns)


def scope_edges(scope: DataFrame) -> DataFrame:
    """Pairs of records of one store that share a scope value (repo, memory_id, kind, value), each pair once with the number of values shared.

    A value shared by n records makes n - 1 edges, from its first record to the others: who shares a value is connected, and the edges
    grow with the records, not their pairs.
    """
    first = scope.groupBy("repo", "kind", "value").agg(F.min("memory_id").alias("source"), F.count_distinct("memory_id").alias("n")).where("n > 1")
    pairs = scope.join(first, ["repo", "kind", "value"]).where("memory_id != source").select("repo", "source", F.col("memory_id").alias("target"), "kind", "value").distinct()
    return pairs.groupBy("repo", "source", "target").agg(F.count(F.lit(1)).alias("weight"))


def shared_scope_pairs(scope: DataFrame, most: int | None = None) -> DataFrame:
    """All pairs (repo, source, target, weight) of records that share scope values; `most` leaves out values of more records, whose pairs would grow with their square.

    Records with the same values are one class, dealt into blocks of members. Blocks meet by value, and two blocks are taken at the first value that
    they share, where the number of their shared values is known from their lists: a pair of records is made in one task, once, and never shuffled.
    Blocks of a value are dealt into parts of at most PART members that stream past the value's others. Pairs of blocks are shuffled before their
    records are paired: in the task that joins, the rows made of a block and all that it meets would be held at once, and those grow with the value.
    Records of more than WIDE values don't carry their list along: their pairs are counted by a shuffle.
    """
    s = scope.select("repo", "memory_id", "kind", "value").dropna().distinct()
    if most is not None:
        s = s.join(s.groupBy("repo", "kind", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most), ["repo", "kind", "value"], "left_semi")
    s = s.select("repo", "memory_id", F.concat(F.length("kind").cast("string"), F.lit(":"), "kind", "value").alias("term"))
    own = s.groupBy("repo", "memory_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    narrow = _class_pairs(own.where(F.size("terms") <= WIDE))
    wide = own.where(F.size("terms") > WIDE).select("repo", "memory_id", F.explode("terms").alias("term"))
    a, b = wide.alias("a"), own.select("repo", "memory_id", (F.size("terms") > WIDE).alias("wide"), F.explode("terms").alias("term")).alias("b")
    met = a.join(b.hint("merge"), ["repo", "term"]).where(F.col("a.memory_id") != F.col("b.memory_id")).where(~F.col("b.wide") | (F.col("a.memory_id") < F.col("b.memory_id")))
    ends = [f(F.col("a.memory_id"), F.col("b.memory_id")).alias(c) for f, c in ((F.least, "source"), (F.greatest, "target"))]
    return narrow.unionByName(met.select("repo", *ends).groupBy("repo", "source", "target").agg(F.count(F.lit(1)).alias("weight")))


def _class_pairs(own: DataFrame) -> DataFrame:
    """(repo, source, target, weight) for records (repo, memory_id, terms in order) that share terms, each pair once."""
    n = F.row_number().over(Window.partitionBy("repo", "terms").orderBy("memory_id"))
    blocks = own.withColumn("k", F.floor((n - 1) / MEMBERS)).groupBy("repo", "terms", "k").agg(F.sort_array(F.collect_list("memory_id")).alias("members"))
    rows = blocks.select("repo", F.explode("terms").alias("term"), "terms", "members", F.element_at("members", 1).alias("first"))
    parts = rows.groupBy("repo", "term").agg(F.sum(F.size("members")).alias("n")).where("n > 1").select("repo", "term", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = rows.join(parts.hint("merge"), ["repo", "term"])
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS_EACH * cores)  # few bytes make much work here
    side = lambda df, x: df.select("repo", "term", "part", *(F.col(c).alias(f"{x}_{c}") for c in ("terms", "members", "first"))).repartition(tasks, "repo", "term", "part")
    a = side(rows.withColumn("part", F.pmod(F.xxhash64("first"), F.col("parts")).cast("int")), "a")
    b = side(rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "b")
    met = a.join(b.hint("merge"), ["repo", "term", "part"]).where("a_first <= b_first").withColumn("shared", F.array_intersect("a_terms", "b_terms"))
    met = met.where(F.element_at("shared", 1) == F.col("term")).select("repo", "a_first", "b_first", "a_members", "b_members", F.size("shared").cast("long").alias("weight"))
    met = met.repartition(tasks, "repo", "a_first", "b_first")
    pairs = met.select("repo", "a_first", "b_first", "b_members", "weight", F.explode("a_members").alias("x")).select("repo", "a_first", "b_first", "weight", "x", F.explode("b_members").alias("y"))
    return pairs.where("a_first < b_first or x < y").select("repo", F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "weight")


def link_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst, rel_type) to present records."""
    return links.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel_type").alias("rel"))


def anchor_edges(scope: DataFrame, files: DataFrame) -> DataFrame:
    """Records anchored to files of their repository."""
    own = scope.where("kind = 'file'")
    return own.join(files, (own.repo == files.repo) & (own.value == files.path)).select(own.repo, own.memory_id.alias("source"), files.path.alias("target")).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(source, target, sim): the k most similar vectors of each query of at least `least`; ties by target. vectors (id, vec) of unit length,
    queries likewise; null and empty ones have no neighbours, nor have vectors of different lengths.

    Exact: parts of the query set meet all vectors, which stream past them, and each part gives k rows for each query. The work grows with
    queries times vectors.
    """
    return _all_pairs(queries, vectors, k, least)


def _all_pairs(queries: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    g = lambda df: df.select(F.lit(0).alias("g"), "id", "vec")
    return pairs.best(g(queries), g(vectors), k, least, part=pairs.part_rows(queries.count(), BLOCK))


def semantic_edges(vectors: DataFrame, k: int = NEIGHBOURS, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(source, target, sim): every vector (id, vec; unit length) with its k most similar ones of at least `least`, ties by target, each
    unordered pair once; the source is the smaller id of those that have the other among theirs. Null and empty vectors have no edges,
    nor have vectors of different lengths.

    Exact, as the graph asks for: the products grow with the square of the vectors.
    """
    near = _all_pairs(vectors, vectors, k, least)
    once = near.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min("source").alias("source"), F.first("sim").alias("sim"))
    return once.select("source", F.when(F.col("source") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("target"), "sim")


def hot_spots(edges: DataFrame, top: int = 5) -> DataFrame:
    """Targets with the most inbound edges."""
    return edges.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(top)


def directory_levels(files: DataFrame, ignored: tuple[str, ...] = (".git", "node_modules", "dist", "build", "coverage", "vendor")) -> DataFrame:
    """(top, second) of all paths; top-level files have neither."""
    p = F.split("path", "/")
    return files.select(F.element_at(p, 1).alias("top"), F.when(F.size(p) > 2, F.get(p, F.lit(1))).alias("second"), F.size(p).alias("n")).where("n > 1").where(~F.col("top").isin(*ignored)).select("top", "second").distinct()


def dir_rollup(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files per top directory, and edges between different top directories, each once."""
    top = lambda c: F.when(F.col(c).contains("/"), F.substring_index(c, "/", 1)).otherwise(".")
    nodes = files.groupBy(top("path").alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    return nodes, edges.select(top("source").alias("source"), top("target").alias("target")).where("source != target").distinct()
