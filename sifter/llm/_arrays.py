"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on Arrow string buffers: a batch is one flat byte array plus document offsets, so
words, word hashes and shingle hashes come from a handful of numpy passes and no Python object is
made per word. Words follow the contract ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of text handled at once; temporaries are about 40 times as large.
SLICE_BYTES = 1 << 20
#: Longer words are hashed by blake2b instead of the position table.
LONG_WORD = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_POSITION = stream(1, LONG_WORD) | np.uint64(1)
_GRAM = stream(2, 64) | np.uint64(1)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def trimmed(run: Callable) -> Callable:
    """A function of batches after which freed memory goes back to the system: idle Python workers would keep it beside the next ones."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return each


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    x = batch.column(batch.schema.get_field_index(name))
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def folded(flat: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capitals of the Latin-1 block (as UTF-8); no length changes."""
    low = LOWER[flat]
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    return low


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(flat: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the word offsets of each document; ``space`` says which bytes part words."""
    if len(flat) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~space[flat]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    first[at] = solid[at]
    at = offsets[1:][full] - 1
    last[at] = solid[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (multilinear over positions, then mixed)."""
    n = len(starts)
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    length = ends - starts
    long = length > LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(flat[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(~long & (length > 0))
    reach = np.concatenate([[0], np.cumsum(length[short])])
    i = 0
    while i < len(short):
        j = max(i + 1, int(np.searchsorted(reach, reach[i] + SLICE_BYTES // 2, side="right")) - 1)
        pick = short[i:j]
        size = length[pick]
        begin = reach[i:j] - reach[i]
        pos = np.arange(int(size.sum())) - np.repeat(begin, size)
        value = (flat[pos + np.repeat(starts[pick], size)].astype(np.uint64) + np.uint64(1)) * _POSITION[pos]
        out[pick] = mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _LENGTH)
        i = j
    return out


def hash_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of documents: its range, the hashes of its words, and their offsets by document."""
    flat, offsets = buffers(texts)
    for i, j in slices(offsets):
        part = LOWER[flat[offsets[i] : offsets[j]]]
        starts, ends, of = word_bounds(part, offsets[i : j + 1] - offsets[i])
        yield i, j, hash_spans(part, starts, ends), of


def gram_hashes(words: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word sequences of each document and their offsets by document.

    A document of fewer words gives its whole sequence as one; one without words gives none.
    """
    count = np.diff(of)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_of = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(int(out_of[-1]), np.uint64)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for d in range(k):
            rolled += words[d : len(words) - k + 1 + d] * _GRAM[d]
        rolled = mix(rolled)
        whole = np.flatnonzero(count >= k)
        size = many[whole]
        where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[where + np.repeat(out_of[whole], size)] = rolled[where + np.repeat(of[whole], size)]
    for i in np.flatnonzero((count > 0) & (count < k)):
        own = words[of[i] : of[i + 1]]
        out[out_of[i]] = mix(np.array([int((own * _GRAM[: len(own)]).sum(dtype=np.uint64)) ^ len(own)], np.uint64))[0]
    return out, out_of
