"""Words of many texts at once: offsets, 64-bit word hashes and n-gram hashes in numpy.

Both word classes of the contracts are unions of ASCII ranges, so on UTF-8 a byte decides alone whether
it belongs to a word, and lower-casing A-Z is a byte map. A batch of texts is handled as one byte array.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken together up to about so many bytes; a longer text is taken alone. Words are hashed in pieces of so many bytes.
SLICE_BYTES, PIECE = 1 << 20, 1 << 18

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_ASCII = _ALNUM.copy()
_ASCII[0x80:] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z became a-z).
CLASSES = {"space": _SPACE, "alnum": _ALNUM}

_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_rng = np.random.default_rng(20240131)
_BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED_CODES = _BYTE_CODES[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tidied(run: Callable) -> Callable:
    """run over a task's batches; what the task held then goes back to the system, as the worker stays for other stages."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


@dataclass
class Words:
    """Words of a run of texts, in order. first[d]:first[d + 1] are the words of text d."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # byte offsets
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more at the end)."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(texts: pa.Array, kind: str, fold: bool = True, stops: bool = False) -> Words:
    """Words of every text; null has none. fold: hashes take A-Z as a-z. stops: a stop or comma after an ASCII letter or digit is a word of its own."""
    data, offsets = text_bytes(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64))
    inside = CLASSES[kind][data]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[full] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[full[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    if stops:
        own = np.flatnonzero(_STOP[data[end - 1]] & (end - start > 1))
        own = own[_ASCII[data[end[own] - 2]]]
        last = end[own] - 1
        start = np.sort(np.concatenate([start, last]))
        end[own] -= 1
        end = np.sort(np.concatenate([end, last + 1]))
    return Words(data, start, end, np.searchsorted(start, offsets).astype(np.int64), _hashes(data, start, end, _FOLDED_CODES if fold else _BYTE_CODES))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: the polynomial of their codes, and the length. Only a piece of the texts is spread out at a time."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = int(np.searchsorted(end, lo + PIECE, "right"))
        if j == i:  # one word is longer than a piece
            total, power = 0, 1
            for at in range(lo, int(end[i]), PIECE):
                part = data[at : min(at + PIECE, int(end[i]))]
                total += power * int((codes[part] * _UP[: len(part)]).sum(dtype=np.uint64))
                power = power * int(_UP[PIECE]) % (1 << 64)
            out[i] = np.uint64((total + int(end[i]) - lo) % (1 << 64))
            i += 1
            continue
        n = int(end[j - 1]) - lo
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(codes[data[lo : lo + n]] * _UP[:n], out=total[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[b] - total[a]) * _DOWN[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def ngram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n neighbours; the result is n - 1 shorter."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + m]
    return mix(out ^ np.uint64(n))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, and their first index for each text (one more at the end).
    A text with fewer words, but not none, has its whole sequence as one."""
    counts = words.counts
    out_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(out_counts)])
    out = np.empty(first[-1], np.uint64)
    whole = ngram_hash(words.hash, n)
    long = np.flatnonzero(counts >= n)
    src = np.repeat(words.first[:-1][long] - first[:-1][long], out_counts[long])
    place = np.flatnonzero(np.repeat(counts >= n, out_counts))
    out[place] = whole[place + src]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            out[first[:-1][short]] = ngram_hash(words.hash, k)[words.first[:-1][short]]
    return out, first


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `most` bytes together."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
