"""Operators on literal cases, and against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loreweave.functions import rules
from loreweave.functions import text as t
from loreweave.operators import code, graph, history, library, lifecycle, memory, ranking, reconcile, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("word,stem", [("flies", "fly"), ("boxes", "box"), ("cards", "card"), ("address", None), ("status", None), ("bus", None), ("classes", "class")])
def test_plural_stem(spark, word, stem):
    assert one(spark, t.plural_stem(F.lit(word))) == stem


def test_tokens(spark):
    assert one(spark, t.tokenize(F.lit("src/XMLParser_card.ts"))) == ["src", "xml", "parser", "card", "ts"] or "parser" in one(spark, t.tokenize(F.lit("src/XMLParser_card.ts")))
    assert one(spark, t.tokenize(F.lit("my_work_panel"))) == ["myworkpanel", "my", "work", "panel"]
    assert one(spark, t.tokenize_task(F.lit("Fix the a Cards in src"))) == ["fix", "cards", "card"]
    assert one(spark, t.normalise_tag(F.lit("Services/server/import_matching.app-test.ts"))) == ["service", "server", "import", "matching", "app", "test", "ts"]
    assert [one(spark, t.strip_plural(F.lit(w))) for w in ("parties", "classes", "boxes", "less")] == ["party", "class", "box", "less"]


@pytest.mark.parametrize("a,b,sim", [("editor", "editor", 1.0), ("editing", "editor", 2 / 7), ("card", "carding", 0.4), ("edit", "editor", 0.5), ("ab", "abc", 0.0)])
def test_trigrams(spark, a, b, sim):
    assert one(spark, t.jaccard(t.trigrams(F.lit(a)), t.trigrams(F.lit(b)))) == pytest.approx(sim)


def test_other_functions(spark):
    assert one(spark, t.key_file(F.lit("a.cpp::N::f"))) == "a.cpp" and one(spark, t.key_name(F.lit("a.cpp::N::f"))) == "N::f"
    assert one(spark, t.excerpt(F.lit("word " * 100))).endswith("word…")
    assert one(spark, t.slug(F.lit("Hello, World! " * 9))) == "hello-world-hello-world-hello-world"
    assert one(spark, t.patch_paths(F.lit("*** Add File: a.ts\n+x\n*** Update File: b.ts\n*** Move to: c.ts\n*** Add File: a.ts"))) == ["a.ts", "b.ts", "c.ts"]
    assert one(spark, t.capture_title(F.lit("# Use the **pool**\nmore"), F.lit(""))) == "Use the **pool**"
    assert one(spark, t.capture_title(F.lit("deadbeef1"), F.lit("deadbeef1\nremember parsers share tokens"))) == "remember parsers share tokens"
    assert one(spark, t.doc_status(F.lit("# x\nStatus: Draft \n"))) == "Draft" and one(spark, t.doc_type(F.lit("docs/specs/a.md"))) == "spec"
    assert one(spark, t.routed_prompt(F.lit("ask\n\n_Acknowledged:_ ok\n\n_Acknowledged:_ b"))) == "ask"
    h = 0
    for c in "node":
        h = (h * 31 + ord(c)) % (1 << 32)
    assert one(spark, t.colour_hash(F.lit("node"))) == h
    assert one(spark, t.tool_summary(F.lit("Read"), F.lit('{"path": "x.ts"}'))) == "x.ts"
    assert [one(spark, t.retention_days(F.lit(x).cast("int"))) for x in (None, -5, 400, 7)] == [30, 0, 90, 7]


@pytest.mark.parametrize(
    "body,reason",
    [
        ("[Request interrupted by user]", "interrupt-marker"),
        ("You are playing a character who always helps", "duo-roleplay"),
        ("continue from where we left off", "resume-kickoff"),
        ('{"a": 1, "b": [2]}', "structured-blob"),
        ("A_KEY: 1\nB_KEY: 2\nC_KEY: three", "structured-blob"),
        ("# Heading of a pasted document", "pasted-doc"),
        ("This is an autonomous workflow for agents", "workflow-handoff"),
        ("it fails with TypeError in the parser again", "error-log"),
        ("make the button smaller than the other one", "ui-micro-tweak"),
        ("ok, that looks right to me now", "process-control-or-vague-ack"),
        ("does the parser handle nested blocks?", "question"),
        ("too short", "filler"),
        ("Always write migrations before the code that needs them", None),
        ("Never make the margin smaller without review because users notice", None),
    ],
)
def test_gate(spark, body, reason):
    assert one(spark, rules.structural_reject(F.lit(body))) == reason


def test_signals(spark):
    score = lambda b: one(spark, rules.signal_score(F.lit(b)))
    assert (score("plain words here"), score("never do this because it breaks"), score("no, always prefer tabs since they align")) == (0, 2, 3)
    assert one(spark, rules.is_injected(F.lit("  <system-reminder>x"))) and one(spark, rules.is_injected(F.lit("# Update Config Skill\nx"))) and not one(spark, rules.is_injected(F.lit("# Notes")))
    assert one(spark, rules.is_noise_reason(F.lit(" Transient state"))) and not one(spark, rules.is_noise_reason(F.lit("superseded"))) and not one(spark, rules.is_noise_reason(F.lit(None).cast("string")))


@pytest.mark.parametrize("pattern,path,hit", [("src/**", "src/a/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("**/*.{ts,tsx}", "x/y.tsx", True), ("a?.ts", "ab.ts", True), ("[ab].ts", "c.ts", False), ("src/**/x.ts", "src/x.ts", True), ("a.ts", "axts", False)])
def test_globs(spark, pattern, path, hit):
    import re

    assert bool(re.search(one(spark, memory.glob_regex(F.lit(pattern))), path)) == hit


def calls(spark, pairs):
    return spark.createDataFrame(pairs, "from_key string, to_key string")


def test_blast_radius(spark):
    c = calls(spark, [("m.ts::mid", "t.ts::target"), ("p.ts::top", "m.ts::mid"), ("x.ts::other", "::target"), ("t.ts::target", "p.ts::top")])
    target = spark.createDataFrame([("t.ts::target",)], "target string")
    fns = spark.createDataFrame([("target", "t.ts", True), ("mid", "m.ts", False), ("top", "p.ts", False), ("top", "p.ts", True)], "qualified_name string, file string, exported boolean")
    got = {(r.name, r.hop, r.exported) for r in graph.blast_report(c, fns, target).collect()}
    assert got == {("mid", 1, False), ("top", 2, True)}
    u = graph.unresolved(c, target).first()
    assert (u.unresolved, u.confidence) == (1, "partial") and graph.overloads(fns).first().key == "p.ts::top"
    assert {r.key for r in graph.blast_radius(c, target, 1).collect()} == {"m.ts::mid"}


def test_graph_edges(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("src/c/index.ts",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "src/b"), ("src/a.ts", "src/b"), ("src/a.ts", "src/c"), ("src/a.ts", "react")], "from_path string, to_path string")
    assert {tuple(r) for r in graph.file_edges(imports, files).collect()} == {("src/a.ts", "src/b.ts"), ("src/a.ts", "src/c/index.ts")}
    fns = spark.createDataFrame([("f", "src/a.ts")], "qualified_name string, file string")
    nodes, edges = graph.project_graph(files, imports, fns, calls(spark, [("src/a.ts::f", "::x")]).withColumn("kind", F.lit("call")))
    assert nodes.count() == 4 and {r.rel for r in edges.collect()} == {"imports", "contains"}


def test_anchored_ranking_equals_a_loop(spark):
    rng = random.Random(4)
    names = ["RedCard", "blue_card", "workPanel", "cards", "index", "Editor"]
    paths = [f"src/{rng.choice('abc')}/{rng.choice(names)}{k if k % 2 else ''}.ts" for k in range(30)]
    paths = list(dict.fromkeys(paths))
    anchor, strip = paths[0], lambda p: p[:-3]
    imports = [(anchor, strip(paths[k % len(paths)])) for k in (3, 3, 5)] + [(paths[7], strip(anchor)), (paths[8], "nowhere")]
    edges = [(f"{rng.choice(paths)}::f", f"{rng.choice(paths)}::g") for _ in range(60)]
    fns = [(f"make{rng.choice(names)}", rng.choice(paths), rng.random() < 0.5) for _ in range(40)]
    tokens = ranking.task_tokens(spark, "edit the red cards panel")
    tok = {v: set(one(spark, t.tokenize(F.lit(v)))) for v in {*paths, *(f[0] for f in fns)}}
    near = {b if a == anchor else a for a, b in ((x.split("::")[0], y.split("::")[0]) for x, y in edges) if a != b and anchor in (a, b)}
    fan = {}
    for x, y in edges:
        fan.setdefault(y, set()).add(x)
    want = {}
    for p in paths:
        base = p.split("/")[-1][:-3]
        s = 5 * len(set(tokens) & tok[p]) + 4 * (base in tokens) + 2 * (p == paths[2])
        s += 6 if p == anchor else 2 if p.rsplit("/", 1)[0] == anchor.rsplit("/", 1)[0] else 0
        s += sum(4 for f, to in imports if f == anchor and to == strip(p)) + 4 * any(f == p and to == strip(anchor) for f, to in imports) + 3 * (p in near)
        s += max([len(v) for k, v in fan.items() if k.startswith(f"{p}::")] + [0]) > 5
        s += min(12, sum(len(set(tokens) & tok[n]) * (3 if x else 1) for n, f, x in fns if f == p))
        if s:
            want[p] = float(s)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    files = df([(p, k) for k, p in enumerate(paths)], "path string, ordinal int")
    got = ranking.fast_scores(files, df([], "path string, title string, body string"), df(fns, "qualified_name string, file string, exported boolean"), df(imports, "from_path string, to_path string"), calls(spark, edges), df([(paths[2],)], "path string"), tokens, anchor)
    assert {r.path: r.score for r in got.collect()} == want


def test_percentiles_and_empty_windows(spark):
    schema = "ts long, tool string, dur_ms double, status string, cache_status string, result_count int, synthetic int, session_id string"
    rows = [(100 + k, "a", float(k), "ok", "fresh", 1, 0, "s") for k in range(1, 101)]
    r = stats.aggregate(spark.createDataFrame(rows, schema), 200, "1h").first()
    assert (r.total, r.p50, r.p95) == (100, 50.0, 95.0)
    r = stats.aggregate(spark.createDataFrame([], schema), 200, "1h").first()
    assert tuple(r) == (0, 0, 0.0, 0.0, 0, 0, 0)
    v = lambda *x: stats.verdict(spark.createDataFrame([x], "memory_used_pct double, recall_to_get_pct double, err_pct double, total_sessions int, total_calls int")).first().dot
    assert [v(60.0, 40.0, 1.0, 9, 99), v(60.0, 40.0, 1.0, 1, 99), v(60.0, 40.0, 9.0, 9, 99)] == ["green", "muted", "yellow"]


@pytest.mark.parametrize("gets,now,count", [([], 500, 0), ([], 1101, 1), ([(150, "sA")], 5000, 0), ([(50, "sA"), (150, "sA")], 5000, 0), ([(150, "sB")], 5000, 1)])
def test_dismissals(spark, gets, now, count):
    s = spark.createDataFrame([(100, 0, "sA", "m", "f")], "ts long, ordinal long, session_id string, memory_id string, file string")
    g = spark.createDataFrame([(ts, sid, "m") for ts, sid in gets], "ts long, session_id string, memory_id string")
    versions = spark.createDataFrame([("m", 1)], "memory_id string, version int")
    marks = spark.createDataFrame([], "session_id string, watermark long")
    found = reconcile.dismissals(s, g, versions, marks, now, 1000)
    assert sum(r["count"] for r in found.collect()) == count
    stored = spark.createDataFrame([("m", "f", 2, 1)], "memory_id string, file string, count long, version int")
    merged = reconcile.merge_dismissals(stored, found.withColumn("version", F.lit(2))).first()
    assert merged["count"] == (1 if count else 2)


def test_dismissal_stream_equals_batch(spark, tmp_path):
    from loreweave.streaming import events

    schema = "session_id string, kind string, memory_id string, file string, ts long, ordinal long, event_time timestamp"
    rng = random.Random(6)
    rows, at = [], 0
    for session in ("a", "b", None, "c"):  # one after another, none idle for longer than the grace
        for _ in range(25):
            at += rng.randrange(1, 200_000)
            rows.append((session, rng.choice(["surface", "surface", "surface", "get"]), rng.choice("mnopqr"), rng.choice("fg"), at, len(rows)))
    rows.append(("z", "get", "none", "f", at + 10_000_000, 999))
    batch = spark.createDataFrame(rows, "session_id string, kind string, memory_id string, file string, ts long, ordinal long").withColumn("event_time", F.timestamp_millis("ts"))
    batch.where("session_id is null or session_id != 'z'").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    batch.where("session_id = 'z'").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = events.dismissals(stream).writeStream.format("memory").queryName("dismissed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.memory_id, r.file, r["count"]) for r in spark.sql("select memory_id, file, sum(count) as count from dismissed group by all").collect())
    surface = batch.where("kind = 'surface'").select("ts", "ordinal", "session_id", "memory_id", "file")
    gets = batch.where("kind = 'get'").select("ts", "session_id", "memory_id")
    versions = spark.createDataFrame([(m, 1) for m in "mnopqr"], "memory_id string, version int")
    want = reconcile.dismissals(surface, gets, versions, spark.createDataFrame([], "session_id string, watermark long"), 1 << 50)
    assert got == sorted((r.memory_id, r.file, r["count"]) for r in want.collect()) and got


def test_snippets_stop_at_empty_user_turns(spark):
    turns = spark.createDataFrame([("s", 0, "user", "a"), ("s", 1, "assistant", ""), ("s", 2, "user", ""), ("s", 3, "assistant", "late"), ("s", 4, "user", "no, b"), ("s", 5, "system", "x"), ("s", 6, "assistant", "y" * 600)], "session string, turn int, role string, text string")
    got = {r.turn: r.snippet for r in history.next_snippet(turns).collect()}
    assert got == {0: None, 2: "late", 4: "y" * 500}
    assert [(r.turn, r.correction) for r in history.prompts(turns).orderBy("turn").collect()] == [(0, False), (4, True)]
    assert history.search_broadening(history.search_evidence(turns), "b", "other").count() == 2


def test_passages_equal_a_loop(spark):
    rng = random.Random(8)
    lines = []
    for k in range(120):
        lines.append(rng.choice(["# H", "## Sub", "### Deep"]) + f" {k}" if k % 17 == 0 else "w" * rng.randrange(0, 300))
    body = "\n".join(lines)
    rows = library.passages(spark.createDataFrame([("d", body), ("e", None), ("f", "# A\ntext\n## B\nmore\n# C\n")], "doc_id string, body string")).orderBy("doc_id", "ordinal").collect()
    d = [r for r in rows if r.doc_id == "d"]
    assert all(len(r.text) <= 1800 or r.line_start == r.line_end for r in d)
    assert {n for r in d for n in range(r.line_start, r.line_end + 1)} == set(range(1, 121))
    assert all(r.text == "\n".join(lines[r.line_start - 1 : r.line_end]) for r in d)
    for a, b in zip(d, d[1:], strict=False):
        if a.heading_path == b.heading_path and b.line_start <= a.line_end:
            assert len("\n".join(lines[b.line_start - 1 : a.line_end])) + 1 >= 200
    assert [(r.heading_path, r.text) for r in rows if r.doc_id == "f"] == [(["A"], "# A\ntext"), (["A", "B"], "## B\nmore"), (["C"], "# C\n")]


def test_full_text_needs_all_terms(spark):
    texts = spark.createDataFrame([("s", 1, "Running parsers quickly"), ("s", 2, "the parser runs"), ("s", 3, "parsing nothing"), ("u", 4, "run parser run")], "source string, id int, text string")
    got = {r.id for r in library.full_text(library.inverted_index(texts), "parser run").collect()}
    assert got == {1, 2, 4}
    a = {r.id: r.vec for r in library.embed(texts).collect()}
    assert sum(x * x for x in a[1]) == pytest.approx(1) and len(a[1]) == 384


def test_incremental_index(spark):
    schema = "path string, content_hash string, model string"
    old = spark.createDataFrame([("a", "1", "m"), ("b", "2", "m"), ("c", "3", "m")], schema)
    new = spark.createDataFrame([("a", "1", "m"), ("b", "9", "m"), ("d", "3", "m"), ("e", "5", "m")], schema)
    assert {tuple(r) for r in library.index_plan(new, old, "m").collect()} == {("b", "change", None), ("d", "rename", "c"), ("e", "add", None)}
    assert {r.action for r in library.index_plan(new, old, "other").collect()} == {"add"}


def state(spark, rows):
    return spark.createDataFrame([(i, k, s, "t", "body", 1, 0.5, p, "extracted", [], 0, None, 0, None) for i, k, s, p in rows], lifecycle.STATE)


def commands(spark, rows):
    return spark.createDataFrame([(r[0], r[1], 5, r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, r[4] if len(r) > 4 else None, None, "why", False) for r in rows], lifecycle.COMMANDS)


TYPES = ["decision", "gotcha", "capture"]


def test_transitions(spark):
    s = state(spark, [("a", "decision", "active", False), ("b", "gotcha", "candidate", False), ("c", "capture", "candidate", False), ("d", "decision", "deprecated", False), ("e", "capture", "trashed", False), ("f", "decision", "merged_into", False), ("g", "decision", "active", False)])
    c = commands(spark, [("a", "update", "new title", "new body"), ("b", "confirm"), ("c", "confirm"), ("d", "restore"), ("e", "untrash"), ("f", "rewrite"), ("g", "merge", "a"), ("zz", "trash")])
    out = lifecycle.apply(s, c, TYPES)
    now = {r.id: r for r in out.state.collect()}
    assert {i: r.status for i, r in now.items()} == {"a": "active", "b": "active", "c": "candidate", "d": "active", "e": "candidate", "f": "merged_into", "g": "merged_into"}
    assert now["a"].version == 3 and now["a"].body == "new body" and now["a"].supersedes == ["g"] and now["b"].confidence == 1.0
    assert {(r.id, r.action) for r in out.rejected.collect()} == {("c", "confirm"), ("f", "rewrite"), ("zz", "trash")}
    audit = {r.id: r for r in out.audit.orderBy(F.desc("version")).collect()}
    assert audit["a"].prev_body == "body" and audit["b"].prev_body is None and set(audit) == {"a", "b", "d", "e", "g"}


def test_create_purge_pin_and_links(spark):
    s = state(spark, [("a", "decision", "trashed", False)] + [(f"p{k}", "gotcha", "active", True) for k in range(20)])
    new = spark.createDataFrame([("n", "create", 1, "title", "b", "gotcha", "extracted", "r", False), ("m", "create", 1, "title", "b", "gotcha", "explicit", "r", False), ("a", "create", 1, "t", "b", "gotcha", "explicit", "r", False), ("x", "discard", 1, "t", "b", "capture", "extracted", "r", False)], lifecycle.COMMANDS)
    made = lifecycle.create(new, s)
    assert {r.id: (r.status, r.confidence) for r in made.state.collect() if r.id in "nmx"} == {"n": ("candidate", 0.5), "m": ("active", 1.0), "x": ("trashed", 0.5)}
    assert made.rejected.first().id == "a"
    out = lifecycle.apply(made.state, commands(spark, [("a", "purge"), ("m", "pin"), ("n", "bump", "0.9")]), TYPES)
    rows = {r.id: r for r in out.state.collect()}
    assert rows["a"].body == "<purged>" and rows["a"].status == "trashed" and not rows["m"].pinned and rows["n"].confidence == 0.95
    assert [r.id for r in out.rejected.collect()] == ["m"]
    links = spark.createDataFrame([("a", "n", "refines")], "src string, dst string, rel_type string")
    more = spark.createDataFrame([("a", "n", "refines"), ("n", "m", "supports"), ("n", "n", "supports"), ("n", "q", "supports"), ("n", "m", "likes")], "src string, dst string, rel_type string")
    kept, refused = lifecycle.link(links, more, made.state)
    assert kept.count() == 2 and refused.count() == 3 and lifecycle.unlink(kept, links).count() == 1
    used = lifecycle.use(made.state, spark.createDataFrame([("n", 7), ("n", 9)], "id string, ts long")).where("id = 'n'").first()
    assert (used.get_count, used.last_accessed_ms) == (2, 9)
    assert lifecycle.sweep_due(100_000_000, 1) and not lifecycle.sweep_due(10, 1)


def test_code_structure(spark):
    files = [
        ("pkg/main.py", "from pkg.util import helper as h\nimport pkg.models\n\ndef run(x):\n    h(x)\n    return pkg.models.load(x)\n"),
        ("pkg/util.py", "def helper(x):\n    return x\n"),
        ("pkg/models.py", "from .util import helper\n\nclass Model:\n    def save(self):\n        self.finish()\n\n    def finish(self):\n        helper(1)\n\ndef load(x):\n    return Model()\n"),
        ("web/a.ts", "import { make as build } from './b';\nimport * as util from './c/index.js';\nexport function start() {\n  build(1);\n  util.trim('x');\n  missing();\n}\nexport class Box {\n  open() {\n    start();\n  }\n}\n"),
        ("web/b.ts", "export const make = (n: number) => {\n  return n;\n};\n"),
        ("web/c/index.ts", "export function trim(s: string) {\n  return s;\n}\n"),
        ("c/util.h", "int add(int a, int b);\n"),
        ("c/util.c", '#include "util.h"\nint add(int a, int b) {\n  return a + b;\n}\n'),
        ("c/main.c", '#include "util.h"\nint main(void) {\n  return add(1, 2);\n}\n'),
        ("bad.py", "def ("),
    ]
    src = spark.createDataFrame(files, "path string, body string")
    syms = code.symbols(src).cache()
    fns = {(r.path, r.name) for r in syms.where("kind = 'function'").collect()}
    assert {("pkg/models.py", "Model.save"), ("web/a.ts", "start"), ("web/a.ts", "Box.open"), ("web/b.ts", "make"), ("c/util.c", "add"), ("c/main.c", "main")} <= fns
    imports = code.resolve_import_files(syms, src)
    assert {(r.from_path, r.to_path) for r in imports.collect()} >= {("pkg/main.py", "pkg/util.py"), ("pkg/models.py", "pkg/util.py"), ("web/a.ts", "web/b.ts"), ("web/a.ts", "web/c/index.ts"), ("c/main.c", "c/util.h")}
    edges = {(r.from_key, r.to_key) for r in code.resolve_calls(syms, imports).collect()}
    assert {("pkg/main.py::run", "pkg/util.py::helper"), ("pkg/models.py::Model.finish", "pkg/util.py::helper"), ("pkg/models.py::Model.save", "pkg/models.py::Model.finish"), ("web/a.ts::start", "web/b.ts::make"), ("web/a.ts::start", "web/c/index.ts::trim"), ("web/a.ts::start", "::missing"), ("web/a.ts::Box.open", "web/a.ts::start"), ("c/main.c::main", "c/util.c::add")} <= edges


def test_incremental_reindex(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "path string, v int")
    fresh = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "path string, v int")
    changes = spark.createDataFrame([("b", "changed"), ("d", "removed")], "path string, change string")
    imports = spark.createDataFrame([("a", "b"), ("c", "x")], "from_path string, to_path string")
    assert {tuple(r) for r in reconcile.reindex(rows, fresh, changes, imports).collect()} == {("a", 2), ("b", 2), ("c", 1)}


def test_drain_judges_copies_and_leaves_other_records(spark):
    rows = [(1, "capture", "candidate", "ok"), (2, "capture", "candidate", "ok"), (3, "capture", "active", "ok"), (4, "decision", "candidate", "ok"), (5, "capture", "candidate", " \n\tyes "), (6, "capture", None, "ok")]
    keepers = spark.createDataFrame([("yes\n",), ("yes",), ("yes",)], "body string")
    got = {r.id: (r.action, r.reason) for r in memory.drain_actions(spark.createDataFrame(rows, "id int, type string, status string, body string"), keepers).collect()}
    assert len(got) == 6 and got[1] == got[2] and got[1][0] == "trash" and got[5] == ("keep", "keeper")
    assert got[3] == got[4] == got[6] == ("keep", "not-candidate-capture")


def test_embeddings_hold_the_whole_document(spark):
    from types import SimpleNamespace

    from loreweave.plans.upkeep_queries import embeddings_by_trigram

    head = "same words " * 20
    bodies = {"a": head + "first end", "b": head + "other end", "c": head + "first end\nsecond line", "d": "", "e": "ab"}
    docs = spark.createDataFrame([(k, x.split("\n")[0], x) for k, x in bodies.items()], "path string, title string, body string")
    got = {r.id: r.vec for r in embeddings_by_trigram(SimpleNamespace(docs=docs)).collect()}
    for k, x in bodies.items():
        want = [0.0] * 384
        for i in range(len(x) - 2):
            h = 2166136261
            for c in x[i : i + 3]:
                h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
            want[h % 384] += 1
        size = sum(w * w for w in want) ** 0.5 or 1
        assert got[k] == pytest.approx([w / size for w in want])
    assert got["a"] != got["b"] and got["a"] != got["c"]


def test_semantic_edges_of_all_records(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(graph, "BLOCK", 16)
    vectors = []
    for k in range(60):
        v = [rng.gauss(0, 1) for _ in range(4)]
        size = sum(x * x for x in v) ** 0.5
        vectors.append((k, vectors[7][1] if k % 9 == 8 else [x / size for x in v]))
    extra = [(100, [1.0]), (101, []), (102, None)]
    want = {}
    for a, x in vectors:
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b) for b, y in vectors if b != a)
        for s, b in [z for z in scored if -z[0] >= 0.65][:2]:
            want.setdefault((min(a, b), max(a, b)), (a, b, pytest.approx(-s)))
    got = [tuple(r) for r in graph.semantic_edges(spark.createDataFrame(vectors + extra, "id long, vec array<double>")).collect()]
    assert sorted(got) == sorted(want.values(), key=lambda w: w[:2]) and {a for a, _, _ in got} - set(range(0, 60, 5))


# -- settings, suggestions, review, projects -----------------------------------------------------------------------------
def test_settings_meet_key_by_key():
    from loreweave.functions.config import DEFAULTS, merged, settings

    assert settings() == DEFAULTS
    s = settings({"memory": {"aging": {"autoSweep": False}, "ignoreWorktreePrefixes": []}, "other": 1}, {"memory": {"ranking": {"weights": {"scope": 1}}, "surface": 3}})
    assert s["aging"]["autoSweep"] is False and s["aging"]["candidateToTrashedDays"] == 90 and s["ignoreWorktreePrefixes"] == []
    assert s["ranking"]["weights"]["scope"] == 1 and s["ranking"]["weights"]["semantic"] == 0.5 and s["surface"] == 3 and DEFAULTS["surface"] != 3
    assert merged({"a": {"b": 1}}, None, {"a": 2}) == {"a": 2}


def test_scope_lines_count_at_the_end_alone(spark):
    from loreweave.functions import rules

    cases = {
        "prose\n<scopeFiles>a.ts, b.ts</scopeFiles>\n\n</invoke>\n": (True, ["a.ts", "b.ts"], [], "prose\n"),
        '<scopeTags>["x"," y ",""]</scopeTags>': (True, [], ["x", "y"], ""),
        "<scopeFiles>a</scopeFiles>\nprose": (False, [], [], "<scopeFiles>a</scopeFiles>\nprose"),
        "see <scopeTags>a</scopeTags>": (False, [], [], "see <scopeTags>a</scopeTags>"),
        "p  \n\n <scopeFiles>[1, 2]</scopeFiles> \n<scopeTags>{bad</scopeTags>": (True, [], [], "p\n"),
        "": (False, [], [], ""),
        "long line\n" * 20_000 + "<source>s</source>": (True, [], [], "long line\n" * 20_000),
    }
    df = spark.createDataFrame([(b,) for b in cases], "body string")
    got = {r.body: tuple(r.x) for r in df.select("body", rules.legacy_scope("body").alias("x")).collect()}
    assert got == cases


@pytest.mark.parametrize("value", ["store", "XMLStore_parser", "my-store/other", "red_bolt", "RedBolt redbolts", "boxes/partyHTTP", "parties", "glass", "a_b", "is_store_", "stores\nreds", "HTTPServer2Stores", ""])
def test_tokens_are_found_without_making_them(spark, value):
    from loreweave.functions import text as t
    from loreweave.operators import ranking

    tokens = ["store", "redbolt", "bolt", "box", "party", "http", "glass", "glas", "red", "ab", "isstore", "server2", "parser", "xml", "server2stores", "2"]
    forms = ranking.token_forms(spark, tokens)
    row = spark.createDataFrame([(value,)], "v string").select(t.tokenize("v").alias("all"), *(t.holds_token("v", k, forms[k]).alias(f"h{i}") for i, k in enumerate(tokens))).first()
    assert [k for i, k in enumerate(tokens) if row[f"h{i}"]] == [k for k in tokens if k in row["all"]]


def test_words_begin_with_the_root_of_their_stem(spark):
    from loreweave.operators import library

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    words = {w for x in texts for w in re.findall(r"[a-z]+", x.lower())}
    stems = "run sens rel commun digit happi activ form electr hope fall cri able nation rat".split()
    ends = "s es ed ing ation ator ational ization izer ability ably able ibility ibilities fulness ousness iveness ical icate ative y ies ly ement ment ent ence ency al e ful ness ied ying ll".split()
    words |= {a + b for a in stems for b in ends} | {a + b + c for a in stems for b in ends for c in ("s", "ed", "ly")}
    assert len(words) > 3000 and [w for w in words if not w.startswith(library._root(library._porter(w)))] == []


def test_search_without_an_index_is_the_same(spark):
    from loreweave.operators import library

    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("source", "doc_id AS id", "coalesce(text, '') AS text")
    rows = lambda df: [(r.source, r.id, r["rank"], round(r.score, 9)) for r in df.orderBy("source", "rank").collect()]
    for q in ("the of", "of", "thing and", "zzz"):
        assert rows(library.search_texts(t, q, 7)) == rows(library.full_text(library.inverted_index(t), q, 7))


def test_the_front_door_checks_and_ranks(spark):
    from loreweave.operators import ranking, suggest

    files = spark.createDataFrame([("src/a_store.ts", 0), ("src/b.ts", 1), ("lib/store.ts", 2)], "path string, ordinal long").withColumn("content_hash", F.lit("x"))
    none = lambda ddl: spark.createDataFrame([], ddl)
    store = {"files": files, "docs": none("path string, title string, body string"), "functions": none("qualified_name string, file string, exported boolean"), "imports": none("from_path string, to_path string"), "calls": none("from_key string, to_key string"), "entry_files": none("path string")}
    store |= {"path_vectors": spark.createDataFrame([("src/b.ts", [1.0, 0.0]), ("x.md", [0.0, 1.0])], "id string, vec array<double>"), "query": spark.createDataFrame([([1.0, 0.1],)], "vec array<double>")}
    for bad in (dict(task=" "), dict(task="x", limit=0), dict(task="x", limit=True), dict(task="x", pool=201), dict(task="x", mode="best")):
        with pytest.raises(ValueError):
            suggest.suggest(store, **bad)
    found, asked = suggest.suggest(store, "the store", origin="./src/b.ts", limit=3)
    want = ranking.suggest_fast(*(store[k] for k in ("files", "docs", "functions", "imports", "calls", "entry_files")), "the store", "src/b.ts", 3)
    assert found.collect() == want.collect() and asked == {"mode": "fast", "task": "the store", "origin": "src/b.ts", "freshness": "fresh"}
    assert suggest.anchor_of(files, "src\\b.ts") == "src/b.ts" and suggest.anchor_of(files, "/lib/store.ts") == "lib/store.ts" and suggest.anchor_of(files, "nope") is None
    semantic, _ = suggest.suggest(store, "x", "semantic", limit=5)
    assert [(r.path, r.kind) for r in semantic.collect()] == [("src/b.ts", "file"), ("x.md", "doc")]


def test_recall_over_stores_matches_a_loop(spark):
    from loreweave.operators import memory

    m = spark.createDataFrame([(i, "how-to", "active", 0.5, 1000, f"r{i % 3}") for i in range(60)], "id long, type string, status string, confidence double, updated_ms long, repo string")
    vec = spark.createDataFrame([(i, [1.0, i / 60]) for i in range(60)], "id long, vec array<double>")
    scope = spark.createDataFrame([], "memory_id long, kind string, value string")
    got = [(r.repo, r.id) for r in memory.recall_stores(m, scope, vec, [0.0, 1.0], 2000, each=4, limit=10).collect()]
    best = []
    for k in range(3):
        own = memory.recall(m.where(f"repo = 'r{k}'"), scope, vec, [0.0, 1.0], 2000, limit=4, pool=None).collect()
        best += [(-r.score, f"r{k}", r.id) for r in own]
    assert got == [(r, i) for _, r, i in sorted(best)[:10]]


def test_registry_and_stores(spark):
    from loreweave.operators import graph
    from loreweave.sources import files

    s = spark.createDataFrame([("a", "/x", "ok"), ("b", "/y", "ok")], "source string, root string, status string")
    assert [r.source for r in files.remove_source(s, "a").collect()] == ["b"] and files.remove_source(s, "z").count() == 2
    assert sorted(map(tuple, files.update_source(s, "b", {"status": "gone", "source": "c"}).collect())) == [("a", "/x", "ok"), ("b", "/y", "gone")]
    old = spark.createDataFrame([(1, 0, "t", [1.0]), (1, 1, "u", [2.0]), (2, 0, "w", [3.0])], "session long, id long, text string, vec array<double>")
    now, new = files.write_chunks(old, spark.createDataFrame([(1, 0, "u"), (1, 1, "new")], "session long, id long, text string"))
    assert sorted(map(tuple, now.collect()), key=str) == sorted([(2, 0, "w", [3.0]), (1, 0, "u", [2.0]), (1, 1, "new", None)], key=str) and [r.text for r in new.collect()] == ["new"]
    kept = files.write_sessions(spark.createDataFrame([(1, "a"), (2, "b")], "session long, manifest string"), spark.createDataFrame([(2, "c")], "session long, manifest string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        graph.build("round", {})


def test_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    session = lambda **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))
    read = lambda s: SimpleNamespace(schema=lambda _: SimpleNamespace(parquet=lambda path: path))
    wrote = []

    def table(**conf):
        s = session(**conf)
        s.read = read(s)
        return SimpleNamespace(sparkSession=s, schema=None, write=SimpleNamespace(parquet=wrote.append))

    assert graph.cut(table(**{"spark.checkpoint.dir": "file:///shared/"}), "x").startswith("file:///shared/x-")
    assert "loreweave-" in graph.cut(table(**{"spark.master": "local[4]"}), "x") and len(wrote) == 2
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            graph.cut(table(**{"spark.master": master}), "x")
