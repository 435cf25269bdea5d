"""Packing documents into token sequences along a Hilbert curve.

1. Every text is tokenised and hashed into a vector: each token id falls into one of BUCKETS, and a fixed random
   projection of the mean count vector leaves DIMS numbers. Token ids are written once, beside the vectors.
2. Mean and deviation of each dimension over all documents scale the vectors to a grid; the cell's place on the
   Hilbert curve is the document's key. Keys alone are range-sorted, ties by doc_id and row, so copies spread out.
3. Running token counts along the curve give each document its place in one long line of tokens, cut every
   `length` tokens: no sequence but the last has padding, and neighbours on the curve share sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, with_row_id
from .words import Words, slices, split_words, text_bytes, tidied

BUCKETS, DIMS, GRID_BITS = 256, 4, 10
#: Distinct chunks of text that a worker remembers the tokens of, and bytes of text that are looked up in it together.
CACHE, TOGETHER = 400_000, 2 << 20

_PROJECTION = np.random.default_rng(11).standard_normal((BUCKETS, DIMS))
_encoders: dict[tuple, Encoder] = {}


def _projected(ids: np.ndarray) -> np.ndarray:
    return _PROJECTION[ids.astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32) % np.uint64(BUCKETS)]


def _separable(tokenizer) -> bool:
    """Whether texts may be cut at white space and before stops: no token of the vocabulary goes across, and all its tokens, written with
    spaces, stops and capitals between, give the same ids cut and whole."""
    words = sorted({w.removeprefix("##").removesuffix("</w>") for w in tokenizer.get_vocab(with_added_tokens=False)})
    # Lone letters stand for bytes in some vocabularies; white space in a longer token is written as such, or by one of three letters.
    if any(len(w) > 1 and re.search(r"[\s\u0120\u010a\u2581]|[0-9A-Za-z][.,;:!?]", w) for w in words):
        return False
    words = [w for w in words if w.isascii() and w.isalnum()]
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for at in range(0, len(words), 500):
        own = words[at : at + 500]
        chunks = [x for k, w in enumerate(own) for x in ((w, " ") if k % 3 else (w.title(), ".,;:!?"[k % 6], "\n  "))]
        if ids("".join(chunks)) != [i for c in chunks if c.strip() for i in ids(c)]:
            return False
    return True


class Encoder:
    """Token ids of many texts. If tokens of the vocabulary span neither ASCII white space nor the place between an ASCII letter or
    digit and a stop or comma after it (`separable`), each distinct chunk between those is tokenised once; chunks are told apart by 64-bit
    hashes. With other vocabularies every text is tokenised as a whole."""

    def __init__(self, path: str, end: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.separable = _separable(self.tokenizer)
        # Entry 0 is the end id. Hashes are sorted, and entry has the number of each one's ids, size and vector.
        self.hash, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.start, self.size = np.array([end], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.vector = _projected(np.array([end]))
        self.uses = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Leaves the half of the chunks that were met in most slices."""
        keep = np.concatenate([[0], np.sort(1 + np.argpartition(-self.uses[1:], CACHE // 2)[: CACHE // 2])])
        new = np.full(len(self.size), -1)
        new[keep] = np.arange(len(keep))
        self.hash, self.entry = self.hash[new[self.entry] >= 0], new[self.entry[new[self.entry] >= 0]]
        size = self.size[keep]
        first = np.cumsum(size) - size
        self.ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.start[keep] - first, size)]
        self.start, self.size, self.vector, self.uses = first, size, self.vector[keep], self.uses[keep] // 2

    def _learn(self, data: bytes, start: np.ndarray, end: np.ndarray) -> None:
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        rows = [e.ids for e in self._batch(texts, add_special_tokens=False)]
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter(chain.from_iterable(rows), np.uint32, int(size.sum()))
        first = np.cumsum(size) - size
        vectors = np.zeros((len(rows), DIMS))
        np.add.at(vectors, np.repeat(np.arange(len(rows)), size), _projected(flat))
        self.start = np.concatenate([self.start, first + len(self.ids)])
        self.ids = np.concatenate([self.ids, flat])
        self.size = np.concatenate([self.size, size])
        self.vector = np.concatenate([self.vector, vectors])
        self.uses = np.concatenate([self.uses, np.zeros(len(rows), np.int64)])

    def _entries(self, words: Words, data: bytes) -> np.ndarray:
        """The entry of each word; new ones are learnt."""
        distinct, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE:
            self._forget()
        place = np.searchsorted(self.hash, distinct)
        known = place < len(self.hash)
        known[known] = self.hash[place[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            more = np.arange(len(self.size), len(self.size) + len(new))
            self._learn(data, words.start[at[new]], words.end[at[new]])
            self.hash, self.entry = np.insert(self.hash, place[new], distinct[new]), np.insert(self.entry, place[new], more)
            place += np.cumsum(~known) - ~known
        own = self.entry[place]
        self.uses[own] += 1
        return own[back]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with the end id after each, the first place of each text, and mean projected vectors."""
        if not self.separable:
            rows = [e.ids + [self.end] for e in self._batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            ids = np.fromiter(chain.from_iterable(rows), np.uint32, int(first[-1]))
            return ids, first, np.add.reduceat(_projected(ids), first[:-1], axis=0) / np.diff(first)[:, None]
        data = text_bytes(texts)[0].tobytes()
        small = data.lower()
        # Special tokens in a text are told by their case.
        fold = self.folds and not any(t in small for t in self.special)
        words = split_words(texts, "space", fold=fold, stops=True)
        docs = len(words.first) - 1
        chunk = np.zeros(len(words.hash) + docs, np.int64)  # 0, the end id, stays where a text ends
        if len(words.hash):
            chunk[np.arange(len(words.hash)) + words.doc] = self._entries(words, data)
        chunk_first = words.first[:-1] + np.arange(docs)
        size = self.size[chunk]
        before = np.cumsum(size) - size
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.start[chunk] - before, size)]
        counts = np.add.reduceat(size, chunk_first)
        vectors = np.add.reduceat(self.vector[chunk], chunk_first, axis=0) / counts[:, None]
        return ids, np.concatenate([[0], np.cumsum(counts)]), vectors


def encoder(path: str, end: int) -> Encoder:
    """The worker's own encoder, kept between tasks."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def _encode(path: str, end: int):
    def run(batches):
        encode = encoder(path, end)
        wide = encode.tokenizer.get_vocab_size() > 1 << 16 or end >= 1 << 16
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                ids, first, vectors = encode(part.column("text"))
                raw = ids.astype("<u4" if wide else "<u2").tobytes()
                w = 4 if wide else 2
                rows = [raw[a * w : b * w] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(rows, pa.binary()), *(pa.array(vectors[:, k]) for k in range(DIMS))],
                    ["row_id", "doc_id", "n", "ids", *(f"v{k}" for k in range(DIMS))],
                )

    return tidied(run)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of coordinates below 2**bits) along the Hilbert curve through the grid."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        p = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _hilbert_keys(mean: list[float], deviation: list[float]):
    def run(batches):
        for batch in batches:
            v = np.stack([batch.column(3 + k).to_numpy() for k in range(DIMS)], axis=1)
            scaled = (v - mean) / deviation  # within 3 deviations of the mean the grid is even
            cells = np.clip((scaled + 3) / 6 * (1 << GRID_BITS), 0, (1 << GRID_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hilbert(cells, GRID_BITS))], ["row_id", "doc_id", "n", "key"])

    return tidied(run)


def _running(batches):
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        start = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start), pa.array(np.full(len(n), part, np.int64))], ["row_id", "n", "local", "part"])


def _pieces(length: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, n, raw, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at")), strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    own = ids[start : start + size].tobytes()
                    out.append((doc_id, start, size, zlib.crc32(own), n, sequence, offset, own))
                    start += size
            columns = list(zip(*out, strict=True)) or [()] * 8
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_id").type)] + [pa.array(c, pa.int64()) for c in columns[1:7]] + [pa.array(columns[7], pa.binary())] * with_ids, names)

    return tidied(run)


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 2, with_ids: bool = True) -> DataFrame:
    """Packs every row of docs (doc_id, text) into sequences of `length` tokens; one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the ids as little-endian unsigned 32-bit numbers.

    A document is its ids and `end`; null and empty texts are `end` alone. Every id lies in exactly one piece, sequences
    are numbered from 0 and all but the last are full. Ties on the curve go by doc_id, then by row; repeated rows are packed each
    time. An empty table gives no pieces. Other columns are ignored. tokenizer: path of a vocabulary file on all workers.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_row_id(docs.select("doc_id", "text")).select("row_id", "doc_id", "text")
    vectors = ", ".join(f"v{k} double" for k in range(DIMS))
    rows, _ = cut(rows.mapInArrow(_encode(tokenizer, end), f"row_id long, doc_id {kind}, n long, ids binary, {vectors}"), "tokens")
    light = rows.select("row_id", "doc_id", "n", *(f"v{k}" for k in range(DIMS)))
    stats = light.agg(*(f(f"v{k}") for f in (F.avg, F.stddev_pop) for k in range(DIMS))).first()
    mean, deviation = ([x or 0.0 for x in stats[:DIMS]], [x or 1.0 for x in stats[DIMS:]])
    keys = light.mapInArrow(_hilbert_keys(mean, deviation), f"row_id long, doc_id {kind}, n long, key long")
    keys, _ = cut(keys, "keys")
    line = keys.repartitionByRange("key", "doc_id", "row_id").sortWithinPartitions("key", "doc_id", "row_id").select("row_id", "n")
    line, _ = cut(line.mapInArrow(_running, "row_id long, n long, local long, part long"), "line")
    # One number for each partition of the sort comes to the driver.
    totals = sorted((r.part, r.total) for r in line.groupBy("part").agg(F.sum("n").alias("total")).collect())
    base, bases = 0, []
    for part, total in totals:
        bases.append((part, base))
        base += total
    bases = docs.sparkSession.createDataFrame(bases, "part long, base long")
    line = line.join(F.broadcast(bases), "part").select("row_id", (F.col("local") + F.col("base")).alias("at"))
    placed = rows.select("row_id", "doc_id", "n", "ids").join(line, "row_id").select("doc_id", "n", "ids", "at")
    names = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.mapInArrow(_pieces(length, with_ids), f"doc_id {kind}, {names}")
