"""Queries against their twins on texts that the small tables lack: signals, rules that a twin leaves out, other forms of a word."""

import duckdb
import pytest

from loreweave.plans import QUERIES, SQL

BODIES = ["always run the tests", "A A A A A A A A the the the the the the", "No one likes the plain words of this note at all, never", "short", "# heading and some more words that go on", "is it so? and some more words that go on", "plain words without any sign of such a thing, quite long", None]


@pytest.fixture(scope="module")
def signalled(tmp_path_factory):
    """Tables in which every type has candidates with and without signals, old and new."""
    d, c = tmp_path_factory.mktemp("signalled"), duckdb.connect()
    c.execute("create table b (k int, body varchar)")
    c.executemany("insert into b values (?, ?)", list(enumerate(BODIES)))
    c.execute("create table documents as select i::bigint doc_id, body as text, 'en' as lang, 'src' || i % 3 as source, 0::bigint n_chars from range(1600) r(i) join b on (i // 5) % 8 = k")
    c.execute("create table labels as select doc_id, (doc_id % 2)::int quality, 0::int toxic from documents where doc_id % 7 < 5")
    for t in ("documents", "labels"):
        c.execute(f"copy {t} to '{d}/{t}.parquet' (format parquet)")
    return str(d), c


@pytest.mark.parametrize("name", ["aging_actions", "aging_by_signal", "digest_counts", "digest_by_signal", "pending_captures", "pending_by_signal", "sweep_state", "sweep_by_signal", "triage", "triage_all"])
def test_signals_as_in_the_twin(spark, signalled, name):
    d, c = signalled
    got, want = QUERIES[name](spark, d), c.execute(SQL[name])
    names = sorted(x[0] for x in want.description)
    assert sorted(got.columns) == names
    want = [dict(zip((x[0] for x in want.description), r, strict=True)) for r in want.fetchall()]
    rows = lambda rs: sorted(tuple(str(r[n]) for n in names) for r in rs)
    assert rows(got.collect()) == rows(want) and want


def test_signals_are_judged(spark, signalled):
    d, _ = signalled
    one = lambda q: QUERIES[q](spark, d).collect()
    assert one("digest_counts")[0].captures_high == 0 < one("digest_by_signal")[0].captures_high
    assert one("pending_by_signal")[0].signal > 0 and set(one("triage")) != set(one("triage_all"))


def test_other_words_of_a_stem_are_left_to_the_stems(spark, tmp_path):
    c = duckdb.connect()
    texts = ["the of it", "Thes, ofs - it", "the ofing it", "the of ited", "the of its it", "theing ofed it the of it", "the-of its", "", "it " * 300 + "the of"]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts * 2)]
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?, ?)", rows)
    c.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    got = {q: {tuple(r) for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("full_text", "full_text_phrase", "indexed_phrase", "indexed_search", "full_text_stems")}
    for q in set(got) - {"full_text_stems"}:
        assert got[q] == set(c.execute(SQL[q]).fetchall()), q
    assert got["full_text_stems"] > got["full_text_phrase"]


@pytest.mark.parametrize("name, side", [("fuzzy_token_match", "posexplode"), ("resolve_imports", "FileScan"), ("suggest_anchored", "explode"), ("project_graph", "FileScan")])
def test_what_grows_with_the_files_is_not_broadcast(spark, name, side):
    lines = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange HashedRelation" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            assert "TakeOrderedAndProject" in "".join(lines[i:below]) or not any(side in x for x in lines[i:below]), (name, line)


def test_passages_are_handed_on_in_parts():
    import pandas as pd

    from loreweave.operators import library

    docs = pd.DataFrame({"doc_id": [str(i) for i in range(40)], "body": ["word " * 20000] * 39 + [None]})
    parts = list(library._passages(library.MOST_CHARS, library.OVERLAP)(iter([docs])))
    assert len(parts) > 2 and max(p.text.str.len().sum() for p in parts) < 2 * library.HELD
    assert list(pd.concat(parts).doc_id.unique()) == list(docs.doc_id)
