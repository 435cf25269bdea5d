"""Near-duplicates, decontamination and sharding against brute force, and their odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreweave.llm import components, contamination, minhash, sharding, words

DOCS = "doc_id long, text string, n_shingles long, kept string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, -1, "x") for i, t in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[a + 1 :]:
            if s and r and 100 * len(s & r) >= percent * len(s | r):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def near(rng, n=60, groups=5):
    rows, k = [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one"), (9004, "ONE"), (9005, "two words"), (9006, "Über über")], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 80))]
        for _ in range(n // groups):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
            rows.append((k, " ".join(own)))
            k += 7
    rows += [(k + 1 + i, rows[-1][1]) for i in range(4)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 5)  # groups span several blocks
    monkeypatch.setattr(minhash, "BLOCK_SIGNATURES", 3)
    rows = near(random.Random(1))
    got = {tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_chains_about_the_threshold_match_brute_force(spark, monkeypatch):
    """Members of a bucket that aren't like its smallest one, but like one another, are found as well."""
    monkeypatch.setattr(minhash, "BLOCK_SIGNATURES", 7)
    rng, rows = random.Random(4), []
    for g in range(4):
        w = [f"g{g}w{i}" for i in range(60)]
        for k in range(30):  # each a small step from the one before: ends are far apart
            rows.append((1000 * g + rng.randrange(1000), " ".join(w)))
            w[(7 * k) % 60] = f"g{g}n{k}"
            if k % 11 == 10:
                w[k % 60 : k % 60 + 6] = [f"g{g}cut{k}{i}" for i in range(6)]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == want and 8 < len({r[2] for r in want}) < len(rows)


def test_near_duplicates_odd_cases(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None)]
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True)], key=str)
    kept = minhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_shingles", "kept"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 3]


def test_near_duplicates_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, [(5, text), (4, text + " end"), (6, "w1 w2 w3")])).collect()}
    assert got == {5: 4, 4: 4, 6: 6}


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 1 << 63, 400, dtype=np.uint64)])
    low = minhash.minima(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    sig = np.ascontiguousarray(minhash.pack(low)).view(np.uint64)
    assert abs(minhash.estimate(sig[0], sig[1:])[0] - 1600 / 2400) < 0.2


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (0, 1)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\nÄß.é_", max_size=30)), max_size=8))
def test_words_match_patterns(texts):
    for kind, pattern in (("space", r"[^\x20\x09-\x0D]+"), ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words.split_words(pa.array(texts, pa.string()), kind)
        want = [re.findall(pattern, lower(t)) for t in texts]
        assert w.counts.tolist() == [len(x) for x in want]
        flat = [x for row in want for x in row]
        assert len(set(flat)) == len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(w.hash.tolist()))
        for n in (1, 3):
            hashes, first = words.shingles(w, n)
            assert [len(set(hashes[a:b].tolist())) for a, b in zip(first[:-1], first[1:], strict=True)] == [len({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} or ({tuple(x)} - {()})) for x in want]


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = pa.array(["a bb " + "c" * 50 + " dd", "E" * 33, " ".join("xyz"[k % 3] * (k % 21) for k in range(200))])
    whole = words.split_words(texts, "space").hash.tolist()
    monkeypatch.setattr(words, "PIECE", 16)
    assert words.split_words(texts, "space").hash.tolist() == whole


# -- decontamination ----------------------------------------------------------------------------------------------------
def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_hits(docs, items, window=13):
    out = set()
    for i, text in docs:
        w, hit, found = alnum(text), set(), set()
        for item, t in items:
            b = alnum(t)
            size = min(len(b), window)
            for s in range(len(b) - size + 1 if b else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == b[s : s + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(item))
        n = len(hit)
        out.add((i, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return out


def brute_matches(docs, items, window=13):
    """Longest verbatim matches: common stretches that can't be made longer at either end."""
    out = {}
    for i, text in docs:
        w, found = alnum(text), set()
        for item, t in items:
            b = alnum(t)
            for s in range(len(b)):
                for p in range(len(w)):
                    n = 0
                    while s + n < len(b) and p + n < len(w) and b[s + n] == w[p + n]:
                        n += 1
                    if n >= min(len(b), window) and not (s and p and b[s - 1] == w[p - 1]):
                        found.add((str(item), s, p, n))
        out[i] = sorted(found)
    return out


def contaminated_rows(rng):
    vocab = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((2, 5, 13, 14, 40))))) for i in range(12)]
    items += [(50, None), (51, " .. "), (52, "Short Item"), (1, items[1][1]), (60, items[3][1])]
    docs = [(100, None), (101, ""), (102, "--"), (103, "a short,item b")]
    for k in range(25):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            w[rng.randrange(len(w) + 1) : 0] = own[rng.randrange(3) :]
        docs.append((k, ", ".join(w).upper() if k % 3 == 0 else " ".join(w)))
    return docs, items


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_contamination_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_CHARS", block)
    docs, items = contaminated_rows(random.Random(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contamination(frame(spark, docs), bench)
    want = brute_hits(docs, items)
    assert {tuple(r) for r in got.drop("matches").collect()} == want
    longest = {r.doc_id: [(m.item_id, m.item_start, m.start + k, m.length) for m in r.matches for k in range(m.repeats)] for r in got.collect()}
    assert any(longest.values()) and {i: sorted(m) for i, m in longest.items()} == brute_matches(docs, items)
    assert all(m == sorted(m, key=lambda x: -x[3]) for m in longest.values())
    kept = contamination.decontaminate(frame(spark, docs), bench)
    assert kept.columns == ["doc_id", "text", "n_shingles", "kept"]
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if not r[-1]}


def test_contamination_of_a_very_long_text(spark):
    text = " ".join(f"w{i * i % 9973}" for i in range(400_000))
    item = " ".join(text.split()[250_000:250_300])
    got = contamination.contamination(frame(spark, [(1, text), (2, item.upper()), (3, "x" * 3_000_000)]), spark.createDataFrame([(7, item)], "item_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert ("7", 0, 250_000, 300, 1) in map(tuple, rows[1].matches) and not rows[1].contaminated
    assert [tuple(m) for m in rows[2].matches] == [("7", 0, 0, 300, 1)] and rows[2].contaminated and rows[3].n_words == 1


@pytest.mark.parametrize("many", [1, 1 << 10])
def test_contamination_of_repeated_words(spark, monkeypatch, many):
    monkeypatch.setattr(contamination, "MANY", many)
    monkeypatch.setattr(contamination, "AT_ONCE", 64)
    items = [(1, "a " * 30), (2, "a b " * 12), (3, "b " + "a " * 20 + "c"), (4, "a " * 5), (None, "a " * 14), (6, "c a " * 9)]
    docs = [(1, "a " * 50), (2, "x " + "a b " * 30), (3, "a " * 16 + "b " + "a " * 25 + "c a " * 12), (4, "a"), (5, "b a " * 20)]
    rows = contamination.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    longest = {r.doc_id: sorted((str(m.item_id), m.item_start, m.start + k, m.length) for m in r.matches for k in range(m.repeats)) for r in rows}
    assert longest == brute_matches(docs, items) and {r.doc_id: len(r.matches) for r in rows}[1] < 250
    named = brute_hits(docs, [x for x in items if x[0]])
    assert {(r.doc_id, r.n_items, r.items_sha256) for r in rows} == {(i, n, h) for i, _, _, n, h, _ in named} and {(r.doc_id, r.n_hit) for r in rows} == {(r[0], r[2]) for r in brute_hits(docs, items)}


def test_memory_of_repeated_words_stays_small():
    import tracemalloc

    items = contamination.Suffixes([(1, "0 " * 200), (2, "0 1 " * 100)], 13)
    hashes = np.concatenate([items.hashes[:1].repeat(200_000), np.tile(items.hashes[200:202], 50_000)])
    ends = np.repeat([200_000, 300_000], [200_000, 100_000])
    starts = np.repeat([0, 200_000], [200_000, 100_000])
    tracemalloc.start()
    order, a, n = items.places(hashes, ends)
    place, suffix, length = items.longest(hashes, starts, ends, order, a, n)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20 and int(length.max()) == 200
    tracemalloc.stop()


def test_contamination_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = contamination.contamination(frame(spark, [(1, "a b"), (1, "a b")]), bench).collect()
    assert [tuple(r)[:4] for r in rows] == [(1, 2, 0, 0)] * 2 and not rows[0].contaminated
    assert contamination.contamination(frame(spark, []), bench).count() == 0


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 4, 200).astype(np.uint64)
    ends = np.repeat([80, 81, 200], [80, 1, 119])
    order = contamination.suffix_array(h, ends, 13)
    suffix = [tuple(h[i : min(i + 13, ends[i])].tolist()) for i in range(200)]
    assert [suffix[i] for i in order] == sorted(suffix)


# -- sharding -----------------------------------------------------------------------------------------------------------
def test_shards_are_balanced_and_gapless(spark):
    rows = [(i, "x" * (i % 7)) for i in range(1234)] + [(5, None), (None, "é"), (7, "same"), (7, "same")]
    got = sharding.shard(frame(spark, rows), 40, 256).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 40 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == texts
    assert sharding.shard(frame(spark, []), 40).count() == 0


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPREAD", 7)
    rows = [(3, "same")] * 300 + [(None, "x")] * 200 + [(i, "y") for i in range(100)] + [(None, None)]
    got = sharding.shard(frame(spark, rows), 8, 64).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len(t or "") + 16) for i, t in rows)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and {len(s) for s in by.values()} <= {75, 76}
    assert sharding.segments_for(0) == sharding.segments_for(4096 * sharding.SEGMENT_ROWS) == 4096 and sharding.segments_for(50_000_000_000) == 65536


def test_one_more_shard_moves_few_rows():
    """With uneven segments: besides the rows that the new shard takes, few move between old ones."""
    rng = random.Random(9)
    counts = {s: rng.choice((0, 5, 40, 40, 45, 200)) for s in range(4096)}
    total = sum(counts.values())
    spread = []
    for shards in (40, 41):
        where = {}
        for p in sharding.allot(counts, sharding.ring(shards), shards):
            where.update({(p["segment"], k): p["shard"] for k in range(p["lo"], p["hi"])})
        assert len(where) == total and max(Counter(where.values()).values()) - min(Counter(where.values()).values()) <= 1
        spread.append(where)
    moved = [k for k in spread[0] if spread[0][k] != spread[1][k]]
    assert len(moved) < 0.08 * total and sum(spread[1][k] != 40 for k in moved) < 0.06 * total


def test_few_rows_move(spark):
    """A row leaves its own shard only where that is full, and then goes on clockwise."""
    counts = {s: 10 for s in range(256)}
    owners = sharding.ring(8, 256)
    pieces = sharding.allot(counts, owners, 8)
    assert sum(p["hi"] - p["lo"] for p in pieces) == 2560
    away = sum(p["hi"] - p["lo"] for p in pieces if p["shard"] != owners[p["segment"]])
    home = {s: sum(10 for o in owners if o == s) for s in range(8)}
    assert away == sum(max(0, n - 320) for n in home.values())


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from loreweave.llm.common import shared_dir

    session = lambda **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))
    assert shared_dir(session(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"
    assert shared_dir(session(**{"spark.master": "local[*]"})) == shared_dir(session(**{"spark.master": "local"}))
    with pytest.raises(RuntimeError):
        shared_dir(session(**{"spark.master": "local-cluster[3,2,1024]"}))
