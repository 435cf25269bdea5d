"""Structure of source files: imports, functions, calls, and what they resolve to.

Python files are read with the standard `ast` module, TypeScript and C by patterns over lines with braces counted. Each file is one
row and handled alone; resolution is joins.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

SYMBOL = "path string, kind string, name string, callee string, exported boolean, line int, end_line int, specifier string"
_TS_FUNCTION = re.compile(r"^\s*(?P<export>export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*\(|^\s*(?P<export2>export\s+)?(?:const|let|var)\s+(?P<name2>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>")
_TS_CLASS = re.compile(r"^\s*(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)")
_TS_METHOD = re.compile(r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*([\w$]+)\s*\([^;]*\)\s*(?::[^{]+)?\{\s*$")
_TS_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\*\s+as\s+(?P<space>[\w$]+)|\{(?P<names>[^}]*)\})?\s*from\s*['\"](?P<from>[^'\"]+)['\"]")
_C_FUNCTION = re.compile(r"^(?!\s*(?:if|for|while|switch|return|else|do)\b)(?P<static>static\s+)?[\w:<>,*&\s]+?[\s*&](?P<name>[\w:~]+)\s*\([^;{}]*\)\s*(?:const\s*)?(?P<end>\{|;)")
_CALL = re.compile(r"(?<![\w$.])(new\s+)?([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function typeof await new super constructor sizeof import require elif not and or in is lambda print defined".split())


def _python(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []

    def calls(node, owner):
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                name = ast.unparse(x.func) if isinstance(x.func, (ast.Name, ast.Attribute)) else ""
                if re.fullmatch(r"[\w.]+", name):
                    kind = "method" if "." in name else "call"
                    out.append((path, kind, owner, name.removeprefix("self.") if name.startswith("self.") and name.count(".") == 1 else name, None, x.lineno, x.end_lineno, None))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((path, "function", node.name, None, not node.name.startswith("_"), node.lineno, node.end_lineno, None))
            calls(node, node.name)
        elif isinstance(node, ast.ClassDef):
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    out.append((path, "function", f"{node.name}.{m.name}", None, not m.name.startswith("_"), m.lineno, m.end_lineno, None))
                    calls(m, f"{node.name}.{m.name}")
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(path, "import", a.asname or a.name, "*", None, node.lineno, None, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out += [(path, "import", a.asname or a.name, a.name, None, node.lineno, None, module) for a in node.names]
    return out


def _braced(path: str, source: str, lang: str) -> list[tuple]:
    """Functions by their opening lines, ended by counting braces; calls inside belong to the function that holds them."""
    out: list[tuple] = []
    lines = source.split("\n")
    owner, owner_depth, owner_at, cls, cls_depth, depth = "", -1, 0, "", -1, 0
    for n, raw in enumerate(lines, 1):
        line = re.sub(r"//.*$|/\*.*?\*/", "", re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", '""', raw))
        name, exported, body = None, False, True
        if lang == "typescript":
            if (m := _TS_CLASS.match(line)) and cls_depth < 0:
                cls, cls_depth = m[2], depth
            elif m := _TS_FUNCTION.match(line):
                name, exported = m["name"] or m["name2"], bool(m["export"] or m["export2"])
            elif cls_depth >= 0 and depth == cls_depth + 1 and (m := _TS_METHOD.match(line)) and m[1] not in _KEYWORDS:
                name, exported = f"{cls}.{m[1]}", True
        elif depth == 0 and (m := _C_FUNCTION.match(line)) and m["name"] not in _KEYWORDS:
            name, exported, body = m["name"], not m["static"], m["end"] == "{"
        if name and owner_depth < 0:
            out.append((path, "function" if body else "declaration", name, None, exported, n, n, None))
            if body:
                owner, owner_depth, owner_at = name, depth, len(out) - 1
        elif owner_depth >= 0 and not name:
            for m in _CALL.finditer(line):
                last = re.split(r"\.|::", m[2])[-1]
                if last not in _KEYWORDS and m[2] not in _KEYWORDS:
                    out.append((path, "new" if m[1] else "method" if "." in m[2] else "call", owner, m[2].removeprefix("this."), None, n, n, None))
        elif name and owner_depth >= 0 and (rest := line.partition("=>")[2]):
            out += [(path, "call", owner, m[2], None, n, n, None) for m in _CALL.finditer(rest) if m[2] not in _KEYWORDS]
        depth += line.count("{") - line.count("}")
        if owner_depth >= 0 and depth <= owner_depth and ("}" in line or "{" not in line and line.rstrip().endswith((";", ")"))):
            row = out[owner_at]
            out[owner_at] = (*row[:6], n, row[7])
            owner, owner_depth = "", -1
        if cls_depth >= 0 and depth <= cls_depth and "}" in line:
            cls, cls_depth = "", -1
    if lang == "typescript":
        for m in _TS_IMPORT.finditer(source):
            at = source.count("\n", 0, m.start()) + 1
            if m["default"]:
                out.append((path, "import", m["default"], "default", None, at, None, m["from"]))
            if m["space"]:
                out.append((path, "import", m["space"], "*", None, at, None, m["from"]))
            for part in (m["names"] or "").split(","):
                names = part.replace("type ", "").strip().split(" as ")
                if names[0]:
                    out.append((path, "import", names[-1].strip(), names[0].strip(), None, at, None, m["from"]))
    else:
        out += [(path, "import", None, None, None, source.count("\n", 0, m.start()) + 1, None, m[1]) for m in re.finditer(r'(?m)^\s*#\s*include\s*"([^"]+)"', source)]
    return out


#: Extractors by language; callers may add their own.
ADAPTERS = {"python": _python, "typescript": lambda p, s: _braced(p, s, "typescript"), "c": lambda p, s: _braced(p, s, "c"), "cpp": lambda p, s: _braced(p, s, "c")}


#: What an adapter's language offers, by extension.
CAPABILITIES = {
    "python": ((".py",), ("functions", "imports", "calls", "package roots")),
    "typescript": ((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), ("functions", "imports", "calls")),
    "c": ((".c", ".h"), ("functions", "declarations", "includes", "calls", "companion sources")),
    "cpp": ((".cc", ".cpp", ".cxx", ".hh", ".hpp", ".hxx"), ("functions", "declarations", "includes", "calls", "companion sources")),
}


def package_roots(repos: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, root): where a repository's Python packages lie, by the first of pyproject.toml, setup.cfg and setup.py (repo, path, body) at its
    root that says so; else the root itself, an empty string."""
    quoted = lambda c: F.regexp_extract_all(c, F.lit("[\"']([^\"']+)[\"']"), 1)
    one = lambda p: F.filter(F.array(F.regexp_extract("body", p, 1)), lambda x: x != "")
    named = F.col("path")
    found = (
        F.when(named == "pyproject.toml", quoted(F.regexp_extract("body", r"\bwhere\s*=\s*\[([^\]]+)\]", 1)))
        .when(named == "setup.cfg", one(r"package_dir\s*=\s*\w*\s*=\s*([^\s;#]+)"))
        .when(named == "setup.py", one("package_dir\\s*=\\s*\\{[^}]*[\"']\\s*:\\s*[\"']([^\"']+)[\"']"))
    )
    order = F.when(named == "pyproject.toml", 0).when(named == "setup.cfg", 1).otherwise(2)
    said = files.select("repo", order.alias("o"), found.alias("roots")).where("size(roots) > 0").groupBy("repo").agg(F.min_by("roots", "o").alias("roots"))
    roots = F.coalesce("roots", F.array(F.lit("")))
    return repos.select("repo").distinct().join(said, "repo", "left").select("repo", F.explode(F.array_distinct(roots)).alias("root"))


def symbols(sources: DataFrame, adapters: dict | None = None) -> DataFrame:
    """Functions, declarations, calls and imports of source files (path, body); files of unknown languages and with syntax errors give none."""
    own = adapters or ADAPTERS
    names = SYMBOL.replace(",", "").split()[::2]

    def run(batches):
        for pdf in batches:
            rows = [r for p, lang, body in zip(pdf["path"], pdf["lang"], pdf["body"], strict=True) if lang in own for r in own[lang](p, body)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"line": "Int32", "end_line": "Int32", "exported": "boolean"})

    return sources.select("path", t.language("path").alias("lang"), F.coalesce("body", F.lit("")).alias("body")).where("lang is not null").mapInPandas(run, SYMBOL)


def _relative(base, spec):
    """A relative specifier joined to a directory, with . and .. taken out."""
    parts = F.filter(F.split(F.concat_ws("/", base, spec), "/"), lambda x: ~x.isin("", "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))), "/")


def resolve_import_files(syms: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("",)) -> DataFrame:
    """(from_path, name, member, to_path): imports with the file that each probe finds first; probes go by extension, index or package file, and package root."""
    i = syms.where("kind = 'import'").withColumn("lang", t.language("path"))
    folder = t.directory("path")
    plain = _relative(folder, F.col("specifier"))
    stem = F.regexp_replace(plain, r"\.(js|jsx|mjs)$", "")
    ts = F.concat(F.array(plain), F.transform(F.array(*map(F.lit, (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"))), lambda e: F.concat(stem, e)))
    dots = F.length(F.regexp_extract("specifier", r"^\.*", 0))
    tail = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.when(dots > 0, _relative(folder, F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), tail)))
    bases = F.array_compact(F.array(up, *(F.when(dots == 0, F.concat(F.lit(f"{r}/" if r else ""), tail)) for r in roots)))
    member = F.transform(bases, lambda b: F.concat_ws("/", F.nullif(b, F.lit("")), "callee"))
    py = F.flatten(F.transform(F.concat(member, bases), lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")))))
    c = F.array(plain, F.col("specifier"))
    probes = F.when(F.col("lang") == "typescript", F.when(F.col("specifier").startswith("."), ts)).when(F.col("lang") == "python", py).otherwise(c)
    x = i.select("path", "name", "callee", "specifier", F.posexplode(probes).alias("priority", "probe")).join(files.select(F.col("path").alias("probe")).distinct(), "probe")
    best = x.groupBy("path", "name", "callee", "specifier").agg(F.min_by("probe", "priority").alias("to_path"))
    return best.select(F.col("path").alias("from_path"), "name", F.col("callee").alias("member"), "to_path")


def resolve_calls(syms: DataFrame, imports: DataFrame) -> DataFrame:
    """(from_key, to_key, kind, line): each call with its best target.

    Dotted: member of an imported module, then the full name in the same file. Plain: an imported name, the same file, an included header or its
    companion source (exported only), a name exported once in all C files. A target must be the only live definition. What finds
    none goes to `::name`.
    """
    fn = syms.where("kind = 'function'").select("path", "name", "exported")
    one = fn.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.max("exported").alias("exported")).where("n = 1").drop("n")
    calls = syms.where("kind in ('call', 'method', 'new')").select("path", F.col("name").alias("caller"), "callee", "kind", "line").withColumn("call_id", F.monotonically_increasing_id())
    head, rest = F.substring_index("callee", ".", 1), F.expr("substring(callee, instr(callee, '.') + 1)")
    calls = calls.withColumns({"dotted": F.col("callee").contains("."), "head": head, "rest": rest})
    key = lambda p, n: F.concat_ws("::", p, n)

    def found(pairs: DataFrame, priority: int, exported: bool = False) -> DataFrame:
        """pairs: call_id, file, target."""
        own = one.where("exported") if exported else one
        return pairs.join(own.select(F.col("path").alias("file"), F.col("name").alias("target")), ["file", "target"]).select("call_id", F.lit(priority).alias("priority"), key("file", "target").alias("to_key"))

    imp = imports.select(F.col("from_path").alias("path"), F.col("name").alias("head"), "member", F.col("to_path").alias("file"))
    spaces = calls.where("dotted").join(imp, ["path", "head"]).select("call_id", "file", F.col("rest").alias("target"))
    inner = calls.where("dotted").select("call_id", F.col("path").alias("file"), F.col("callee").alias("target"))
    named = calls.where("not dotted").join(imp, ["path", "head"]).select("call_id", "file", F.when(F.col("member").isin("default", "*") | F.col("member").isNull(), F.col("callee")).otherwise(F.col("member")).alias("target"))
    method = calls.where("not dotted and caller like '%.%'").select("call_id", F.col("path").alias("file"), F.concat_ws(".", F.substring_index("caller", ".", 1), "callee").alias("target"))
    local = calls.where("not dotted").select("call_id", F.col("path").alias("file"), F.col("callee").alias("target"))
    heads = imports.where("name is null").select(F.col("from_path").alias("path"), F.explode(F.concat(F.array("to_path"), t.companion_sources("to_path"))).alias("file"))
    headed = calls.where("not dotted").join(heads, "path").select("call_id", "file", F.col("callee").alias("target"))
    c_only = one.where("exported").where(t.language("path").isin("c", "cpp")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("file")).where("n = 1")
    far = calls.where("not dotted").where(t.language("path").isin("c", "cpp")).join(c_only, calls.callee == c_only.name).select("call_id", "file", F.col("callee").alias("target"))
    all_ = found(spaces, 0).unionByName(found(inner, 1)).unionByName(found(named, 2)).unionByName(found(local, 3)).unionByName(found(method, 4)).unionByName(found(headed, 5, True)).unionByName(found(far, 6, True))
    w = Window.partitionBy("call_id").orderBy("priority", "to_key")
    best = all_.withColumn("n", F.row_number().over(w)).where("n = 1").select("call_id", "to_key")
    out = calls.join(best, "call_id", "left")
    loose = F.concat(F.lit("::"), F.element_at(F.split("callee", r"\."), -1))
    return out.select(key("path", "caller").alias("from_key"), F.coalesce("to_key", loose).alias("to_key"), "kind", "line")
