"""Ignore rules against git itself, pooled embeddings against numpy, and the table function."""

import os
import shutil
import subprocess

import numpy as np
import pytest

from loreweave.operators import code, pooled, tables
from loreweave.sources import ignore


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_ignore_rules_equal_git(spark, tmp_path):
    own = {
        ".gitignore": "# comment\n\n*.log\n!keep.log\n/only-root\nbuild/\ndoc/*.txt\n**/deep\na/**/z\ntrail/**\n\\#sharp\n\\!bang\nspace\\ \nsp   \n[ab].md\n[!x-z]q\nfoo*bar\nf?o\nnode_modules\n!/x/node_modules/keep\nst**r.c\n[[:digit:]]n\n",
        "sub/.gitignore": "!*.log\n/root.log\nlocal\n",
        "sub/more/.gitignore": "*\n!.gitignore\n!good.py\n",
        "out/.gitignore": "/*\n!/in\n",
    }
    names = "x.log keep.log only-root #sharp !bang sp space a.md c.md xq aq foobar foo/bar fooxbar fao fo deep a/z star.c st/r.c 3n xn f.py".split() + ["space "]
    dirs = ["", "a/", "a/b/", "a/b/c/", "build/", "x/build/", "doc/", "doc/api/", "trail/", "trail/in/", "sub/", "sub/more/", "sub/more/under/", "sub/local/", "x/node_modules/", "out/", "out/in/", "out/other/", "x/deep/", "only-root-not/"]
    files = {*own, *(d + n for d in dirs for n in [*names, "one.txt", "root.log", "good.py", "keep/k"])}
    made = set()
    for f in sorted(files, key=len):
        target = tmp_path / f
        try:
            os.makedirs(target.parent, exist_ok=True)
            target.write_text(own.get(f, "x"))
            made.add(f)
        except (NotADirectoryError, FileExistsError, IsADirectoryError):
            continue
    run = lambda *args: subprocess.run(["git", "-C", str(tmp_path), *args], capture_output=True, text=True, check=True, env={**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null"}).stdout
    run("init", "-q")
    want = set(run("ls-files", "-z", "--others", "--exclude-standard").split("\0")) - {""}
    paths = spark.createDataFrame([(f,) for f in made], "path string")
    rules = ignore.rules(spark.createDataFrame(list(own.items()), "path string, body string"))
    found = ignore.kept(paths, rules)
    got = {r.path for r in found.collect()}
    assert got - want == set() and want - got == set() and 0 < len(want) < len(made)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ignore.kept(paths, rules.limit(0)).count() == len(made)


def test_pooling_equals_numpy(spark, tmp_path):
    corpus = spark.createDataFrame([(f"red apple pie {w} red apple tart {w} blue sky cloud {w}",) for w in ("one", "two", "three", "four")] * 3, "text string")
    path = str(tmp_path / "model")
    pooled.write_model(pooled.fit_tokens(corpus, dim=16), path)
    names, matrix = pooled._load(spark, path)
    assert "apple" in names and matrix.shape[1] == 16 and np.allclose((matrix**2).sum(1), 1, atol=1e-5)
    rows = [(k, x) for k, x in enumerate(["Red apple APPLE", "sky, unknown-cloud", "", None, "nothing known"] * 40)]
    got = {r.id: r.vec for r in pooled.embed(spark.createDataFrame(rows, "id long, text string"), path, batch=7).collect()}
    for k, text in rows:
        own = [matrix[names.index(w)].astype(float) for w in pooled.tokens(text) if w in names]
        want = np.mean(own, 0) / np.linalg.norm(np.mean(own, 0)) if own else np.zeros(16)
        assert np.allclose(got[k], want, atol=1e-6)
    spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "token string, vec array<float>").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="one length"):
        pooled.embed(corpus, str(tmp_path / "bad"))


def test_symbols_in_sql_with_an_adapter_of_ones_own(spark):
    files = spark.createDataFrame([("pkg/a.py", "def run(x):\n    go(x)\n"), ("b.toy", "fn hello\nfn bye"), ("c.none", "x"), ("web/c.ts", "export function start() {\n  build(1);\n}\n"), (None, "x"), ("d.py", None)], "path string, body string")
    files.createOrReplaceTempView("files_of_a_test")

    def toy(path, body):
        return [(path, "function", line.split(" ")[1], None, None, n, n, None) for n, line in enumerate(body.split("\n"), 1)]

    tables.register(spark, {"toy": toy}, {".toy": "toy"})
    rows = spark.sql("SELECT path, kind, name, line FROM symbols(TABLE(SELECT path, body FROM files_of_a_test) PARTITION BY path) WHERE kind = 'function'").collect()
    assert {(r.path, r.name, r.line) for r in rows} == {("pkg/a.py", "run", 1), ("b.toy", "hello", 1), ("b.toy", "bye", 2), ("web/c.ts", "start", 1)}
    every = spark.sql("SELECT * FROM symbols(TABLE(SELECT path, body FROM files_of_a_test WHERE path NOT LIKE '%.toy'))")
    assert sorted(map(str, every.collect())) == sorted(map(str, code.symbols(files.where("path is not null")).collect()))
    with pytest.raises(Exception, match="path and body"):
        spark.sql("SELECT * FROM symbols(TABLE(SELECT path FROM files_of_a_test))").collect()
