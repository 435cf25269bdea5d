"""Full text by phrases, against a loop over all texts."""

import math
import random
import re
import unicodedata

from loreweave.operators import library, search


def plain(text):
    out = []
    for c in (text or "").lower():
        d = unicodedata.normalize("NFD", c)
        if "̀" <= c <= "̱":
            continue
        out.append(d[0] if len(d) == 2 and d[0].isascii() and unicodedata.category(d[1]) == "Mn" else c)
    return "".join(out)


def words(text):
    out, run = [], ""
    for c in plain(text) + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            out.append(search.porter(run))
            run = ""
    return out


def loop(rows, query, limit):
    """Scores of all texts, text by text."""
    wanted = list(dict.fromkeys(tuple(words(p)) for p in query.split() if words(p)))
    own = {(s, i): words(t) for s, i, t in rows}
    own = {k: w for k, w in own.items() if w}
    tf = {k: [sum(tuple(w[j : j + len(p)]) == p for j in range(len(w))) for p in wanted] for k, w in own.items()}
    out = []
    for s in {s for s, _ in own}:
        keys = [k for k in own if k[0] == s]
        avg, df = sum(len(own[k]) for k in keys) / len(keys), [sum(tf[k][j] > 0 for k in keys) for j in range(len(wanted))]
        found = []
        for k in keys:
            if wanted and all(tf[k]):
                idf = [math.log1p((len(keys) - d + 0.5) / (d + 0.5)) for d in df]
                found.append((-sum(g * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own[k]) / avg)) for g, f in zip(idf, tf[k], strict=True)), k[1]))
        out += [(s, i, n, round(-x, 9)) for n, (x, i) in enumerate(sorted((round(x, 12), i) for x, i in found)[:limit])]
    return sorted(out)


def rows(df):
    return sorted((r.source, r.id, r["rank"], round(r.score, 9)) for r in df.collect())


CASES = ["foo-bar", "foo bar", "cafe", "café", "CAFÉ", "naïve/approach", "bar-foo cafe", "a-a", "run.run run", "“quoted phrase”", "-- !!", "", "x_y", "2024-01-05", "größte stadt", "the.of.it", "state-of-the-art thing"]


def test_all_ways_equal_the_loop(spark, tmp_path):
    rng = random.Random(5)
    pool = ["foo", "bar", "Foo-Bar", "bar then a foo", "café", "café", "CAFÉ", "naïve", "approach", "a", "running", "runs", "run", "quoted", "phrases", "x_y", "2024", "01", "05", "größte", "Städte", "the", "of", "it", "state", "art", "things", "ệ", "—", "\n", "foó"]
    data = [(rng.choice("st"), i, " ".join(rng.choices(pool, k=rng.choice([0, 1, 5, 40])))) for i in range(150)] + [("s", 900, None), ("s", 901, ""), ("u", 902, "?!"), ("s", 903, "foo bar " * 300)]
    texts = spark.createDataFrame(data, "source string, id int, text string")
    search.write_index(texts, str(tmp_path / "i"), buckets=4)
    index = search.postings(texts)
    for q in CASES:
        want = loop(data, q, 9)
        assert rows(search.search_texts(texts, q, 9)) == want, q
        assert rows(search.search_index(spark, str(tmp_path / "i"), q, 9, buckets=4)) == want, q
        assert rows(library.full_text(index, q, 9)) == want, q


def test_phrases_and_accents(spark):
    texts = spark.createDataFrame([("s", 1, "bar then a foo"), ("s", 2, "the foo bar"), ("s", 3, "Café au lait"), ("s", 4, "foo.bar")], "source string, id int, text string")
    ids = lambda q: {r.id for r in search.search_texts(texts, q).collect()}
    assert ids("foo-bar") == {2, 4} and ids("foo bar") == {1, 2, 4} and ids("cafe") == {3} and ids("CAFÉ") == {3}
    assert search.phrases(spark, 'Foo-bar "naïve" -- *') == [("foo", "bar"), ("naiv",)]


def test_a_stored_index_is_read_by_folder(spark, tmp_path):
    texts = spark.createDataFrame([("s", i, f"word{i % 50} other") for i in range(500)], "source string, id int, text string")
    search.write_index(texts, str(tmp_path / "i"))
    found, _ = search.read_index(spark, str(tmp_path / "i"), "word7")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert found.select("bucket").distinct().count() == 1 and found.count() == 10
