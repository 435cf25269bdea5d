"""Token counts of whole texts under a public vocabulary; huge texts are encoded in overlapping chunks that are spliced where they agree.

A chunk is encoded beside others, in another task, with an overlap into its right neighbour. Both encodings list the tokens of the overlap with
their offsets; the splice is at a token that both have at the same place. It is proven, not guessed: a BPE encoding is right if and only if
each pair of neighbouring tokens is one that encoding can produce (of two merges that cross a boundary the first would also happen in the pair
alone). Up to the shared token all pairs come from the left chunk's encoding, from it on from the right one's. Where an overlap has no such token,
as in a long run of one character, the document goes another round with overlaps twice as wide and chunks that begin elsewhere; at last it
is one chunk. Models for which the proof does not hold (not BPE, a normaliser that changes texts, unknown characters merged) encode texts whole.

A null text is empty and has no tokens. Rows of one doc_id, or equal rows, each keep their own count. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, with_row_id
from .words import slices, tidied

#: Characters of a chunk and of its overlap in the first round; longer texts than a chunk are cut.
CHUNK, OVERLAP = 16_384, 512
#: Bytes of text encoded together. A token is known by its place in the overlap and its id, as one number.
TOGETHER, ID_BITS = 1 << 18, 24

_counters: dict[str, Counter] = {}


class Counter:
    """The tokenizer of a file: sentencepiece for .model, tokenizers for .json. Special strings inside texts are handled as the library does."""

    def __init__(self, path: str) -> None:
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: self.model.encode(texts, num_threads=1)
            self._prove()
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.encode = lambda texts: [e.ids for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _prove(self) -> None:
        """Whether texts may be cut, and the bytes that each token covers where spaces are written as U+2581."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as pb
        except ImportError:  # without the model's description nothing is proven
            return
        spec = pb.ModelProto.FromString(self.model.serialized_model_proto())
        kinds = pb.ModelProto.SentencePiece
        plain = {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}
        rules = spec.normalizer_spec
        self.cuts = (
            spec.trainer_spec.model_type == pb.TrainerSpec.BPE
            and spec.trainer_spec.byte_fallback
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and not rules.precompiled_charsmap
            and not rules.remove_extra_whitespaces
            and rules.escape_whitespaces
            and all(p.type in plain for p in spec.pieces)
        )
        self.prefix = 3 if rules.add_dummy_prefix else 0
        self.bytes = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in spec.pieces], np.int64)


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _counts(path: str, chunk: int):
    """Rows (row_id, doc_id, text) to (row_id, doc_id, n_bytes, n_tokens, text): texts longer than a chunk keep their text and have no count yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                texts = [t or "" for t in part.column("text").to_pylist()]
                long = [counter.cuts and len(t) > chunk for t in texts]
                rows = iter(counter.encode([t for t, x in zip(texts, long, strict=True) if not x]))
                counts = [None if x else len(next(rows)) for x in long]
                kept = [t if x else None for t, x in zip(texts, long, strict=True)]
                sizes = [len(t.encode()) for t in texts]
                columns = [part.column("row_id"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "doc_id", "n_bytes", "n_tokens", "text"])

    return tidied(run)


def _chunks(chunk: int, overlap: int):
    """Rows (row_id, text) to chunks: its number, its text with the overlap behind it, the characters of its own, and whether it is the last."""
    names = ["row_id", "chunk", "text", "own", "last"]

    def rows(row_id: int, text: str) -> Iterator[tuple]:
        for k, at in enumerate(range(0, len(text), chunk)):
            last = at + chunk >= len(text)
            yield row_id, k, text[at : at + chunk + overlap], min(chunk, len(text) - at), last
            if last:
                return

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for row_id, text in zip(batch.column("row_id").to_pylist(), batch.column("text"), strict=True):
                for row in rows(row_id, text.as_py()):
                    found.append(row)
                    size += len(row[2])
                    if size > 1 << 20:
                        yield packed(found)
                        found, size = [], 0
            if found:
                yield packed(found)

    return tidied(run)


def _edges(path: str):
    """Chunks to what their edges need: at edge k the tokens of chunk k in the overlap (ahead) and how many come before it, and those
    of chunk k + 1 there (behind). Edge -1 has all tokens of the last chunk."""
    names = ["row_id", "edge", "ahead", "behind", "n"]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())

    def places(counter: Counter, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins, from the text's first byte on, and the number that stands for it; none if the bytes don't add up."""
        ids = np.array(ids, np.int64)
        sizes = counter.bytes[ids]
        start = np.cumsum(sizes) - sizes - counter.prefix
        if int(sizes.sum()) - counter.prefix != len(text.encode()) + 2 * text.count(" "):
            return start[:0], ids[:0]
        return start, ids

    def rows(counter: Counter, row: dict, ids: list[int]) -> Iterator[tuple]:
        text, k = row["text"], row["chunk"]
        start, ids_ = places(counter, text, ids)
        bits = 1 << ID_BITS
        if k:
            yield row["row_id"], k - 1, None, np.where(start >= 0, start * bits + ids_, -1).tolist(), 0
        if row["last"]:
            yield row["row_id"], -1, None, None, len(ids)
        else:
            own = text[: row["own"]]
            edge = len(own.encode()) + 2 * own.count(" ")
            before = int(np.searchsorted(start, edge))
            yield row["row_id"], k, ((start[before:] - edge) * bits + ids_[before:]).tolist(), None, before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                given = part.to_pylist()
                found = [x for row, ids in zip(given, counter.encode([r["text"] for r in given]), strict=True) for x in rows(counter, row, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return tidied(run)


def _spliced(edges: DataFrame) -> DataFrame:
    """Each text's tokens (null if one of its edges has no token in common)."""
    met = edges.groupBy("row_id", "edge").agg(F.max("ahead").alias("ahead"), F.max("behind").alias("behind"), F.sum("n").alias("n"))
    shared = F.array_min(F.array_intersect("ahead", "behind"))
    met = met.withColumn("at", shared).withColumn("n", F.when(F.col("edge") < 0, F.col("n")).otherwise(F.col("n") + F.array_position("ahead", F.col("at")) - F.array_position("behind", F.col("at"))))
    return met.groupBy("row_id").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    given = with_row_id(docs.select("doc_id", "text")).select("row_id", "doc_id", "text")
    doc_id = given.schema["doc_id"].dataType.simpleString()
    first, seen = cut(given.mapInArrow(_counts(path, chunk), f"row_id long, doc_id {doc_id}, n_bytes long, n_tokens long, text string"), "counted", left=F.count("text"))
    counts = first.where(F.col("text").isNull()).select("doc_id", "n_bytes", "n_tokens")
    pending, left, turn = first.where(F.col("text").isNotNull()).select("row_id", "text"), seen["left"], 0
    while left:
        # Another width, and another place for chunks to begin: by an odd step, so that runs of one character meet at another phase.
        wide = overlap << turn
        parts = pending.mapInArrow(_chunks(chunk + (3 * wide + turn if turn else 0), wide), "row_id long, chunk long, text string, own long, last boolean")
        edges = parts.repartition("row_id", "chunk").mapInArrow(_edges(path), "row_id long, edge long, ahead array<long>, behind array<long>, n long")
        found, seen = cut(_spliced(edges), "spliced", left=F.count_if(F.col("n_tokens").isNull()))
        done = found.where(F.col("n_tokens").isNotNull())
        counts = counts.unionByName(first.select("row_id", "doc_id", "n_bytes").join(done, "row_id").select("doc_id", "n_bytes", "n_tokens"))
        pending, left, turn = pending.join(found.where(F.col("n_tokens").isNull()).select("row_id"), "row_id", "left_semi"), seen["left"], turn + 1
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
