"""The pipeline against a brute-force version that shares no code with its operators but the pseudonyms."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loreweave.llm import pseudonyms
from loreweave.llm.common import table
from loreweave.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def good(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(windows)
    repeats = len({j for i, x in enumerate(windows) if many[x] > 1 for j in range(i, i + 8)})
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = [c for c in t if c.isalpha()]
    bad = len(w) < 20 or 100 * repeats > 30 * len(w) or 10 * symbols > chars or chars < 2 * len(w) or chars > 25 * len(w)
    bad |= len(lines) >= 4 and 10 * (len(lines) - len(set(lines))) > 5 * len(lines)
    return not (bad or len(letters) >= 100 and 10 * sum(c.isupper() for c in letters) > 7 * len(letters))


def unlike(docs):
    """Of each group of documents linked by five-word shingles at 0.8 the one with the smallest id."""
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(docs):
        for j in sorted(docs):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


def clean(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for t in items:
        b = words(t)
        n = min(len(b), 13)
        windows.setdefault(n, set()).update(tuple(b[k : k + n]) for k in range(len(b) - n + 1))
    windows.pop(0, None)
    out = {}
    for i, t in docs.items():
        w = words(t)
        hit = {j for n, own in windows.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in own for j in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out


def brute(docs, items):
    """What each stage leaves, and the token ids of what the last packs."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    stages = [{i: t for i, t in docs.items() if good(t)}]
    stages.append(unlike(stages[-1]))
    stages.append(clean(stages[-1], items))
    stages.append({i: pseudonyms.pseudonymise(t, b"loreweave-demonstration-key")[0] for i, t in stages[-1].items()})
    stages.append({i: np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for i, t in stages[-1].items()})
    return stages


def packed(rows):
    """Token ids of each document, put together from the pieces; sequences have no gaps."""
    at, out = 0, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 4096 + r.offset == at
        at += r.length
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start * 4 == len(out.get(r.doc_id, b""))
        out[r.doc_id] = out.get(r.doc_id, b"") + r.ids
    return out


def test_each_stage_matches_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = brute({r.doc_id: r.text for r in docs.collect()}, [r.text for r in table(spark, SF, "benchmark").collect()])
    names = docs.columns
    for (name, stage), left in zip(corpus_pipeline.STAGES, want, strict=True):
        out = stage(spark, docs, SF)
        if name == "packing":
            assert packed(out.collect()) == left
            break
        rows = out.collect()
        assert out.columns == names and len(rows) == len(left) and {r.doc_id: r.text for r in rows} == left
        docs = spark.createDataFrame(rows, docs.schema)


def test_run_matches_brute_force(spark):
    want = brute({r.doc_id: r.text for r in table(spark, SF, "documents").collect()}, [r.text for r in table(spark, SF, "benchmark").collect()])
    assert packed(corpus_pipeline.run(spark, SF).collect()) == want[-1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_and_empty_tables(spark, name):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (None, text + " more", None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0)]
    stage = dict(corpus_pipeline.STAGES)[name]
    # Columns with the operators' own names.
    ddl = DOCS.replace("lang", "lw_row").replace("source", "q_text")
    for own in (DOCS, ddl):
        df = spark.createDataFrame(rows, own)
        out = stage(spark, df, SF)
        got = out.collect()
        if name == "packing":
            assert sum(r.start == 0 for r in got) == 5
            assert stage(spark, df.limit(0), SF).count() == 0
            continue
        assert out.columns == df.columns and stage(spark, df.limit(0), SF).count() == 0
        ids = Counter(r.doc_id for r in got)
        want = Counter({1: 2, None: 1} if name == "quality_rules" else {1: 2, None: 1, 2: 1, 3: 1})
        assert ids == want
