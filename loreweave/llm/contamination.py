"""Benchmark decontamination by suffix arrays over the training documents.

Documents are taken in shards of a few megabytes. The suffix array of a shard holds its word positions ordered by the words that
follow them, no further than the document; it is built by doubling: ranks of single words give those of pairs, these those of four
words, and so on up to a window. Every suffix of every test item is found by two binary searches, which give all its places in the
shard at once; from there the words that both have in common are followed on to the end of the longest verbatim match. The benchmark
goes to the workers in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .words import ngram_hash, slices, split_words, tidied

#: Bytes of text in a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 3 << 20
#: Characters of benchmark text that one pass over the documents handles: 8 bytes a word, on the driver and in each worker. A longer
#: item is a block of its own.
BLOCK_CHARS = 8 << 20
_FIELDS = ("item_id", "item_start", "start", "length", "repeats")
_MATCH = pa.struct([(f, pa.string() if f == "item_id" else pa.int64()) for f in _FIELDS])
_STATE = {"lw_words": "long", "lw_hits": "long", "lw_items": "array<string>", "lw_mask": "binary", "lw_matches": "array<struct<item_id string, item_start long, start long, length long, repeats long>>"}
#: Pairs of a place in an item and one in a document that are laid out at once, words that each is followed on at once, and pairs of one window
#: beyond which those that a word before continues are left out by groups, without being laid out.
AT_ONCE, STRIDE, MANY = 1 << 18, 16, 1 << 10


def suffix_array(hashes: np.ndarray, doc_end: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their next `depth` words; the end of a document comes before any word. Ties are in order of position."""
    n = len(hashes)
    rank = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        key = (rank.astype(np.int64) + 1) * (n + 1)
        inside = np.flatnonzero(doc_end - np.arange(n, dtype=np.int32) > step)
        key[inside] += rank[inside + step] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
        known += step
        if int(rank.max()) == n - 1:  # all differ already
            break
    return np.argsort(rank, kind="stable").astype(np.int32)


def expanded(first: np.ndarray, n: np.ndarray, most: int = AT_ONCE):
    """Slices of at most `most` of the numbers first[i], first[i] + 1, ... (n[i] of them), each with its i."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, most):
        k = np.arange(at, min(at + most, total))
        i = np.searchsorted(ends, k, "right")
        yield first[i] + k - (ends[i] - n[i]), i


class Suffixes:
    """The items of a block as one run of word hashes, the suffixes that begin a window, and the distinct windows among them."""

    def __init__(self, items: list[tuple], window: int) -> None:
        words = split_words(pa.array([text for _, text in items], pa.large_string()), "alnum")
        self.window, self.hashes = window, words.hash
        self.names = [None if item is None else str(item) for item, _ in items]
        counts = words.counts
        size = np.minimum(counts, window)
        many = np.where(counts > 0, counts - size + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        start = words.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        key = np.zeros(len(item), np.uint64)
        for k in range(1, window + 1):
            own = np.flatnonzero(size[item] == k)
            if len(own):
                key[own] = ngram_hash(self.hashes, k)[start[own]]
        # Suffixes by their window; those of one window are neighbours.
        order = np.argsort(key, kind="stable")
        self.item, self.start = item[order], start[order]
        self.first, self.end = words.first[:-1][self.item], words.first[1:][self.item]
        self.group = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(order) else np.zeros(0, np.int64)
        self.many = np.diff(np.concatenate([self.group, [len(order)]]))
        self.size = size[self.item][self.group]  # words of each distinct window
        # Distinct items of each window.
        pairs = np.unique(np.repeat(np.arange(len(self.group)), self.many) * max(len(items), 1) + self.item)
        self.owner = pairs % max(len(items), 1)
        self.owners = np.bincount(pairs // max(len(items), 1), minlength=len(self.group))

    def _search(self, hashes: np.ndarray, order: np.ndarray, doc_end: np.ndarray, past: bool) -> np.ndarray:
        """For each window the first place in the suffix array that isn't before it, or (past) is beyond all that begin with it."""
        lo, hi, start = np.zeros(len(self.size), np.int64), np.full(len(self.size), len(order), np.int64), self.start[self.group]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            at, size, own = order[mid].astype(np.int64), self.size[open_], start[open_]
            before = np.zeros(len(at), bool)  # the shard's suffix comes before the item's
            begins = np.ones(len(at), bool)  # it begins with the window
            tied = np.arange(len(at))
            for k in range(self.window):
                tied = tied[k < size[tied]]
                if not tied.size:
                    break
                place = at[tied] + k
                ended = place >= doc_end[at[tied]]
                mine, theirs = hashes[np.minimum(place, len(hashes) - 1)], self.hashes[own[tied] + k]
                before[tied[ended | (mine < theirs)]] = True
                same = ~ended & (mine == theirs)
                begins[tied[~same]] = False
                tied = tied[same]
            if past:
                before |= begins
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        return lo

    def places(self, hashes: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array of a shard, and for each window where its places begin there and how many they are. doc_end: for each word, where its document ends."""
        if not len(hashes) or not len(self.size):
            return np.zeros(0, np.int32), np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64)
        order = suffix_array(hashes, doc_end, self.window)
        a = self._search(hashes, order, doc_end, False)
        return order, a, self._search(hashes, order, doc_end, True) - a

    def _unled(self, hashes: np.ndarray, doc_first: np.ndarray, order: np.ndarray, a: np.ndarray, n: np.ndarray):
        """Slices of (place, suffix) where the same window stands and no common word comes before."""
        few = (n > 0) & (self.many * n <= MANY)
        for k, w in expanded(np.zeros(int(few.sum()), np.int64), (self.many * n)[few]):
            w = np.flatnonzero(few)[w]
            place, suffix = order[a[w] + k % n[w]].astype(np.int64), self.group[w] + k // n[w]
            led = (self.start[suffix] > self.first[suffix]) & (place > doc_first[place])
            led[led] = self.hashes[self.start[suffix][led] - 1] == hashes[place[led] - 1]
            yield place[~led], suffix[~led]
        for w in np.flatnonzero((n > 0) & ~few):
            suffixes, places = np.arange(self.group[w], self.group[w] + self.many[w]), order[a[w] : a[w] + n[w]].astype(np.int64)
            inner, begun = self.start[suffixes] > self.first[suffixes], places == doc_first[places]
            words = hashes[np.maximum(places - 1, 0)]
            by = np.argsort(words[~begun], kind="stable")
            sorted_places, sorted_words = places[~begun][by], words[~begun][by]
            for whole, own in ((places, suffixes[~inner]), (places[begun], suffixes[inner])):
                for k, i in expanded(np.zeros(len(own), np.int64), np.full(len(own), len(whole), np.int64)):
                    yield whole[k], own[i]
            # A suffix with a word before it goes with all places but those with the same word, which lie together.
            own = suffixes[inner]
            lead = self.hashes[self.start[own] - 1]
            low, high = np.searchsorted(sorted_words, lead, "left"), np.searchsorted(sorted_words, lead, "right")
            for first, count in ((np.zeros(len(own), np.int64), low), (high, len(sorted_words) - high)):
                for k, i in expanded(first, count):
                    yield sorted_places[k], own[i]

    def longest(self, hashes: np.ndarray, doc_first: np.ndarray, doc_end: np.ndarray, order: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, suffixes and lengths of the longest verbatim matches: those that no word before or after continues."""
        found = []
        for place, suffix in self._unled(hashes, doc_first, order, a, n):
            start, left = self.start[suffix], np.minimum(self.end[suffix] - self.start[suffix], doc_end[place] - place)
            length = np.zeros(len(place), np.int64)
            open_ = np.arange(len(place))
            while open_.size:
                for at in range(0, len(open_), AT_ONCE // STRIDE):
                    own = open_[at : at + AT_ONCE // STRIDE]
                    k = length[own][:, None] + np.arange(STRIDE)
                    inside = k < left[own][:, None]
                    k = np.minimum(k, left[own][:, None] - 1)
                    same = inside & (self.hashes[start[own][:, None] + k] == hashes[place[own][:, None] + k])
                    length[own] += np.where(same.all(1), STRIDE, same.argmin(1))
                    open_[at : at + AT_ONCE // STRIDE] = np.where(same.all(1), own, -1)
                open_ = open_[open_ >= 0]
            found.append((place, suffix, length))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def _ranges(doc: np.ndarray, item: np.ndarray, item_start: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Matches with those of one item's place and one length at successive words of a document as one, and how many those are."""
    by = np.lexsort((start, length, item_start, item, doc))
    columns = [x[by] for x in (doc, item, item_start, start, length)]
    new = np.ones(len(by), bool)
    new[1:] = (columns[3][1:] != columns[3][:-1] + 1) | np.logical_or.reduce([c[1:] != c[:-1] for k, c in enumerate(columns) if k != 3])
    at = np.flatnonzero(new)
    return [*(c[at] for c in columns), np.diff(np.concatenate([at, [len(by)]]))]


def _shards(batches):
    """Runs of rows with about SHARD_BYTES of text, with their words: hashes and the first of each row."""
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            runs = [split_words(x.column("text"), "alnum") for x in slices(part, "text")]
            counts = np.concatenate([w.counts for w in runs])
            yield part, np.concatenate([w.hash for w in runs]), np.concatenate([[0], np.cumsum(counts)])


def _mark(block, keep: list[str], whole: bool):
    def run(batches):
        items = block.value
        names = np.array(items.names, object)
        for part, hashes, first in _shards(batches):
            counts = np.diff(first)
            doc_first, doc_end = np.repeat(first[:-1], counts), np.repeat(first[1:], counts)
            order, at, n = items.places(hashes, doc_end)
            step = np.zeros(len(hashes) + 1, np.int32)
            found: dict[int, set] = {}
            matches: dict[int, list] = {}
            met = np.zeros(0, np.int64)
            for k, w in expanded(at, n):
                place = order[k].astype(np.int64)
                np.add.at(step, place, 1)
                np.add.at(step, place + items.size[w], -1)
                if whole:
                    met = np.union1d(met, w * len(counts) + np.searchsorted(first, place, "right") - 1)
            hit = np.cumsum(step)[:-1] > 0
            if len(met):
                w, own = np.divmod(met, len(counts))
                begin = np.cumsum(items.owners) - items.owners
                for k, i in expanded(begin[w], items.owners[w]):
                    for d, x in (divmod(y, len(names)) for y in np.unique(own[i] * len(names) + items.owner[k]).tolist()):
                        if items.names[x] is not None:
                            found.setdefault(d, set()).add(items.names[x])
                place, suffix, length = items.longest(hashes, doc_first, doc_end, order, at, n)
                doc = np.searchsorted(first, place, "right") - 1
                for d, x, *rest in zip(*(c.tolist() for c in _ranges(doc, items.item[suffix], items.start[suffix] - items.first[suffix], place - first[doc], length)), strict=True):
                    matches.setdefault(d, []).append((names[x], *rest))
            old = {c: part.column(part.schema.get_field_index(c)).to_pylist() if c in part.schema.names else None for c in _STATE}
            hits, rows_items, masks, rows_matches = [], [], [], []
            for d, (a, n) in enumerate(zip(first[:-1].tolist(), counts.tolist(), strict=True)):
                mask, own, long = hit[a : a + n], found.get(d, set()), matches.get(d, [])
                if old["lw_items"] is not None:
                    own = own | set(old["lw_items"][d] or ())
                    long = long + [tuple(x.values()) for x in old["lw_matches"][d] or ()]
                    if old["lw_mask"][d]:
                        mask = mask | np.unpackbits(np.frombuffer(old["lw_mask"][d], np.uint8), count=n).astype(bool)
                some = bool(mask.any())
                hits.append(int(mask.sum()) if some else 0)
                masks.append(np.packbits(mask).tobytes() if some else None)
                rows_items.append(sorted(own))
                rows_matches.append([dict(zip(_FIELDS, x, strict=True)) for x in sorted(set(long), key=lambda x: (-x[3], x[2], x[0] or "", x[1]))])
            columns = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(rows_items, pa.list_(pa.string())), pa.array(masks, pa.binary()), pa.array(rows_matches, pa.list_(_MATCH))]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + columns, [*keep, *_STATE])

    return tidied(run)


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, whole: bool) -> DataFrame:
    """docs with the state columns; one pass for each block of the benchmark. whole: with items and matches."""
    small_batches(docs.sparkSession)
    spark, keep = docs.sparkSession, docs.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    items = benchmark.select("item_id", "text").where("text is not null")
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(Suffixes([(r.item_id, r.text) for r in own.collect()], window))
        docs = docs.mapInArrow(_mark(block, keep, whole), f"{kept}, {', '.join(f'{c} {t}' for c, t in _STATE.items())}")
        if k + 1 < blocks:
            docs, _ = cut(docs, "contamination")
    return docs


_CONTAMINATED = "lw_hits > 0 and 20 * lw_hits >= lw_words"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, n_hit (words inside any occurrence of a benchmark window),
    n_items and items_sha256 (the items with occurring windows), contaminated (n_hit > 0 and 20 * n_hit >= n_words), and matches: the
    longest verbatim matches of window words or more (of a shorter item: all of it) that no word before or after continues, longest first, each with
    item_id, item_start and start (word numbers from 0 in the item and in the document), length in words, and repeats: it also stands at the
    next repeats - 1 words, as in a text of one word, where a list of all places would grow with the product of both lengths.

    Words are runs of ASCII letters, digits and all characters past ASCII, A-Z taken as a-z; they are told apart by 64-bit hashes. A window is `window`
    consecutive words of an item, or a shorter item as a whole. Null and wordless texts have no words and no hits;
    null or wordless items have no windows. Repeated documents count alike each time, items of one item_id once; an item without item_id hits,
    but is not among the items (its matches have a null item_id). An empty benchmark
    hits nothing, an empty table gives an empty result. Other columns are ignored.
    """
    out = _marked(docs.select("doc_id", "text"), benchmark, window, True)
    return out.select(
        "doc_id",
        F.col("lw_words").alias("n_words"),
        F.col("lw_hits").alias("n_hit"),
        F.size("lw_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("lw_items", ","), 256).alias("items_sha256"),
        F.expr(_CONTAMINATED).alias("contaminated"),
        F.col("lw_matches").alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of docs that `contamination` doesn't call contaminated, with all their columns; cases as there."""
    bare = docs.select(F.struct(*docs.columns).alias("lw_row"), "text")  # no column of docs can clash with the state
    return _marked(bare, benchmark, window, False).where(f"not ({_CONTAMINATED})").select("lw_row.*")
