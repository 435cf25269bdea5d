"""Merkle manifests, token counts and kd-tree clustering against loops, and their odd cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loreweave.llm import kmeans, merkle, token_counts

DOC = "doc_id long, source string, lang string, n_chars int, text string, hash string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# -- Merkle manifest ----------------------------------------------------------------------------------------------------
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    out = []
    for nodes in tree[:-1]:
        run = nodes[i // 8 * 8 :][:8]
        out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return out


def audited(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0], leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in own[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            path = way(trees[x], i) + way(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            folded = leaf((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))) if hit else leaf(r)
            for a, b in path:
                folded = h(a, folded, b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], h(*(a + b for a, b in path)), folded, folded == top[-1][0]))
    return out


key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("n", [1, 8, 9, 700])
def test_audit_equals_the_loop(spark, n):
    rng = random.Random(n)
    texts = ["Upper Case", "lower", "", None, "ÄÖ Ü", "x" * 50_000]
    rows = [(rng.choice([None, 7, k, k, k]), rng.choice([None, "s", "é"]), rng.choices([None, "", "en", "de"], [1, 1, 30, 3])[0], rng.choice([None, 3]), rng.choice(texts), "clash") for k in range(n)]
    rows += rows[: n // 9]
    rows += [(k, "s", f"lang{k}", 1, "T", "clash") for k in range(70)] if n == 9 else []
    got = [tuple(r) for r in merkle.audit(spark.createDataFrame(rows, DOC).repartition(5)).collect()]
    assert sorted(got, key=key) == sorted(audited(rows), key=key)


def test_manifest_proofs_and_empty_tables(spark):
    rows = [(k, "s", "en" if k % 3 else None, 1, f"T{k}", "x") for k in range(100)]
    docs = spark.createDataFrame(rows, DOC)
    found = {r.lang: (r.n_rows, r.subroot, r.root) for r in merkle.manifest(docs).collect()}
    want = {r[2]: r for r in audited(rows)}
    assert found["en"][0] == 66 and {v[1] for v in found.values()} == {r[2] for r in audited(rows)} and {v[2] for v in found.values()} == {r[3] for r in want.values()}
    good = merkle.proofs(docs)
    assert good.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 100
    empty = docs.limit(0)
    assert merkle.audit(empty).count() == 0 and merkle.manifest(empty).count() == 0


# -- token counts -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (500, 2)])
def test_spliced_counts_equal_whole_ones(spark, chunk, overlap):
    rng = random.Random(chunk)
    parts = ["a", "aa", " ", "  ", "\n", "▁", "é", "中文", "😀", "\0", "<s>", "</s>", "=", "the ", "ing", "0x", "\t", "Ⅻ"]
    texts = ["".join(rng.choices(parts[: rng.randint(1, len(parts))], k=rng.choice([1, 3, 50, 300, 2000]))) for _ in range(60)]
    texts += [None, "", "a" * 9001, " " * 5000, "ab" * 4000, "=-" * 1999, "x" + "a" * 3777 + "y" + " " * 2000 + "中" * 1500]
    rows = [(k % 50 if k % 50 else None, t, 1) for k, t in enumerate(texts)] + [(3, texts[3], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = [tuple(r) for r in token_counts.count_tokens(docs, MODEL, limit=900, chunk=chunk, overlap=overlap).collect()]
    encode = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode
    want = [(i, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 900) for i, t, _ in rows]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_counts_of_other_vocabularies_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Some words " * 9000), (2, None)], "doc_id long, text string")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = len(Tokenizer.from_file(path).encode("Some words " * 9000, add_special_tokens=False).ids)
    assert {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, path, chunk=100).collect()} == {(1, want), (2, 0)}
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0
    assert token_counts._counter(MODEL).cuts and not token_counts._counter(path).cuts


# -- clustering ---------------------------------------------------------------------------------------------------------
def lloyd(rows, k=8, rounds=10):
    most = kmeans.MOST
    kept = [(i, [math.floor(max(-most, min(most, 1024 * x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    x, c = np.array([v for _, v in kept], object), np.array([v for _, v in first], object)

    def assigned():
        d = np.stack([((x - z) ** 2).sum(1) for z in c], 1).astype(np.int64)
        return d.argmin(1), d.min(1).astype(object)

    for _ in range(rounds if kept else 0):
        own, _ = assigned()
        for z in np.unique(own):
            c[z] = np.array([int(s) // int((own == z).sum()) for s in x[own == z].sum(0)], object)
    if not kept:
        return []
    own, d = assigned()
    return [(kept[i][0], int(own[i]), int(d[i]), int(d[own == own[i]].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[own[i]])).encode()).hexdigest()) for i in range(len(kept))]


@pytest.mark.parametrize("case", ["ties", "clusters", "huge", "few"])
def test_clusters_equal_lloyd(spark, monkeypatch, case):
    monkeypatch.setattr(kmeans, "BLOCK", 150)
    rng = np.random.default_rng(7)
    if case == "ties":
        vectors = [rng.integers(-1, 2, 64) / 2 for _ in range(40)] * 8
    else:
        centres = rng.normal(size=(9, 64))
        vectors = [centres[rng.integers(9)] + rng.normal(size=64) * 0.1 for _ in range(500 if case != "few" else 5)]
    rows = [(None if i % 11 == 3 else i % 90, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1, None), (2, [1.0] * 63), (3, [None] + [1.0] * 63), (4, [float("nan")] * 64), (5, [float("inf")] * 64), (6, [])]
    rows += [(91, [1e300] * 64), (92, [-3e5] * 64), (93, [1e5] * 64)] if case == "huge" else []
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    assert sorted(map(tuple, kmeans.clusters(table).collect()), key=key) == sorted(lloyd(rows), key=key)


def test_clusters_of_nothing_and_pruning(spark):
    assert kmeans.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (8, 64))
    points = (centres[rng.integers(0, 8, 4000)] + rng.integers(-20, 20, (4000, 64))).astype(np.int32)
    tree, order = kmeans.Tree.build(points)
    whole, rows, _ = tree.filter(centres.astype(np.int64))
    assert sorted(order.tolist()) == list(range(4000)) and len(rows) < 1000 and sum(len(n) for _, n, _ in whole) < 400  # most nodes go whole
    to, distance = tree.assign(centres.astype(np.int64))
    gaps = ((points[order][:, None, :].astype(np.int64) - centres[None]) ** 2).sum(2)
    assert (to == gaps.argmin(1)).all() and (distance == gaps.min(1)).all()
