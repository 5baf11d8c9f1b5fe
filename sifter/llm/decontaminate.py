"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are compared as bytes of lower-case letters and digits; white space and punctuation are left out, so
re-wrapped and re-punctuated copies stay visible. An item is cut into overlapping units of at most ``UNIT`` bytes, with
an edit budget of ``RATE`` of its length each, or (m - q) / q where that is less. By the q-gram lemma a region within e
edits of a unit of m bytes shares at least m + 1 - q*(e + 1) q-grams with it, on diagonals that differ by at most e:

1. positions whose q-gram occurs in any unit are marked by a bitmap, and runs without enough marks in reach are dropped;
2. the marks left are looked up and counted per unit in overlapping bands of diagonals; a band with fewer shared
   q-grams than the bound can't hold a match;
3. the bands left are verified by banded alignment, all of a batch at once, with free ends in the text.

A document is contaminated by an item when one of its units is found. The lemma loses no match, whole texts are scanned,
long ones in overlapping stretches. Hits are expanded ``PIECE`` at a time, and a band is decided once the scan is past it, so that
repetitive text and items cost time but no memory. The benchmark is sent to the executors in parts of about ``PART_BYTES``, a
longer item alone, one pass over the texts for each, so nothing sent grows without bound.

Cases: a null or empty text or item matches nothing; items of fewer than q letters and digits are too short to be evidence
and match nothing; repeated rows give repeated results; an empty table on either side gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import buffers, column, folded, slices

Q = 8
UNIT, STEP = 120, 60
RATE = 0.08
PART_BYTES = 2 << 20
#: Pairs of a position and an occurrence of its q-gram that are counted at once.
PIECE = 1 << 19
_STRETCH = 1 << 20
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)

_KEEP = np.zeros(256, bool)
_KEEP[0x30:0x3A] = _KEEP[0x61:0x7B] = _KEEP[0x80:] = True


def normalised(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept bytes with a zero byte after each text, the position each came from, and the offsets of the texts."""
    low = folded(flat)
    keep = np.flatnonzero(_KEEP[low])
    at = np.searchsorted(keep, offsets)
    n = len(offsets) - 1
    out, source = np.zeros(len(keep) + n, np.uint8), np.zeros(len(keep) + n, np.int64)
    spot = np.arange(len(keep)) + np.repeat(np.arange(n), np.diff(at))
    out[spot], source[spot] = low[keep], keep
    return out, source, at + np.arange(n + 1)


def grams(text: np.ndarray) -> np.ndarray:
    """The q-gram at each position as one number (q = 8 bytes)."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    two = text[:-1].astype(np.uint16) | text[1:].astype(np.uint16) << 8
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << 16
    return four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)


class Units:
    """The units of some benchmark items and the index of their q-grams, in flat arrays."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.item, texts = [], []
        for key, raw in items:
            flat = np.frombuffer((raw or "").encode(), np.uint8)
            own = normalised(flat, np.array([0, len(flat)]))[0][:-1]
            for s in [*range(0, max(len(own) - UNIT, 0), STEP), max(len(own) - UNIT, 0)]:
                if len(own[s : s + UNIT]) >= Q:
                    self.item.append(key)
                    texts.append(own[s : s + UNIT])
        self.size = np.array([len(u) for u in texts], np.int64)
        self.flat, self.begin = np.concatenate([np.zeros(0, np.uint8), *texts]), np.cumsum(self.size) - self.size
        # Beyond (m - q) / q edits the bound would ask for no shared q-gram at all.
        self.edits = np.minimum(RATE * self.size, (self.size - Q) / Q).astype(np.int64)
        self.least = self.size + 1 - Q * (self.edits + 1)
        self.band = self.edits + 1
        codes = [grams(u) for u in texts]
        flat = np.concatenate([np.zeros(0, np.uint64), *codes])
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.cuts = np.append(first, len(flat))
        self.unit = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])[order]
        self.at = np.concatenate([np.zeros(0, np.uint8), *(np.arange(len(c), dtype=np.uint8) for c in codes)])[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self._slot(self.grams)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, band) pairs that share enough q-grams with the text; band b holds diagonals b*w .. b*w + 2w - 1."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = grams(text)
        if not len(self.size) or not len(codes):
            return none
        mark = self.bitmap[self._slot(codes)]
        width, least = int((self.size + self.edits).max()), int(self.least.min())
        total = np.concatenate([[0], np.cumsum(mark)])
        n = len(mark)
        ends = np.minimum(np.arange(n) + width, n)
        rich = total[ends] - total[:-1] >= least  # a window that starts here has enough marks
        if not rich.any():
            return none
        reach = np.zeros(n + 1, np.int64)
        np.add.at(reach, np.flatnonzero(rich), 1)
        np.add.at(reach, ends[rich], -1)
        spots = np.flatnonzero(mark & (np.cumsum(reach[:-1]) > 0))
        found = np.minimum(np.searchsorted(self.grams, codes[spots]), len(self.grams) - 1)
        hit = self.grams[found] == codes[spots]
        spots, found = spots[hit], found[hit]
        size = self.cuts[found + 1] - self.cuts[found]
        out, keys, counts = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = np.cumsum(size)
        i = 0
        while i < len(spots):
            j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + PIECE, side="right")))
            own = size[i:j]
            entry = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.cuts[found[i:j]], own)
            unit = self.unit[entry].astype(np.int64)
            band = (np.repeat(spots[i:j], own) - self.at[entry]) // self.band[unit]
            # Each hit counts in both bands that hold its diagonal.
            key, add = np.unique(np.concatenate([unit << 40 | band + (1 << 30), unit << 40 | band - 1 + (1 << 30)]), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, add]), len(keys)).astype(np.int64)
            unit = keys >> 40
            # A band is past when its last diagonal is further back than a unit is long.
            past = ((keys & (1 << 40) - 1) - (1 << 30) + 2) * self.band[unit] + UNIT < (spots[j] if j < len(spots) else np.inf)
            out.append(keys[past & (counts >= self.least[unit])])
            keys, counts, i = keys[~past], counts[~past], j
        key = np.sort(np.concatenate([np.zeros(0, np.int64), *out]))
        return key >> 40, (key & (1 << 40) - 1) - (1 << 30)

    def verified(self, text: np.ndarray, unit: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fewest edits between each unit and a stretch of the text in its band, and the position where that ends."""
        edits, ends = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        for m in np.unique(self.size[unit]):
            for own in np.array_split(pick := np.flatnonzero(self.size[unit] == m), -(-len(pick) // 2048)):
                u, e = self.flat[self.begin[unit[own], None] + np.arange(m)], int(self.edits[unit[own[0]]])
                low = band[own] * (e + 1) - e
                cols = np.arange(2 * (e + 1) + 2 * e)
                cost = np.zeros((len(own), len(cols)), np.int32)
                for i in range(m):
                    at = low[:, None] + cols + i
                    there = np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)], 0)
                    step = cost + (there != u[:, i : i + 1])
                    step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(step - cols, axis=1) + cols
                edits[own] = cost.min(axis=1)
                ends[own] = low + cost.argmin(axis=1) + m
        return edits, ends


def _parts(benchmark: DataFrame) -> Iterator[Broadcast[Units]]:
    """The units of the items, dealt into parts of about PART_BYTES of text, each sent when it is asked for."""
    parts = max(1, ceil(benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / PART_BYTES))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for part in range(parts):
        yield benchmark.sparkSession.sparkContext.broadcast(Units([(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").where(own == part).collect()]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and item found in it: doc_id, item_id, units found, the fewest edits, the share of
    the best unit that agrees, and the code points start and end of the text that the found units span."""
    id_kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    shape = f"doc_id {id_kind}, item_id {item_kind}, n_units BIGINT, edits BIGINT, agreement DOUBLE, start BIGINT, end BIGINT"
    ids = {"string": pa.string(), "int": pa.int32()}.get(item_kind, pa.int64())
    texts = docs.select("doc_id", "text")
    return reduce(DataFrame.unionAll, [texts.mapInArrow(lambda batches, shared=shared: _scan(batches, shared.value, ids), shape) for shared in _parts(benchmark)])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, row by row, so that rows of one id or of none are told apart; nothing is
    shuffled."""

    def clean(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = np.zeros(len(b), bool)
            bad[[row for row, _ in _found(b, units)[0]]] = True
            yield b.filter(pa.array(~bad))

    for shared in _parts(benchmark):
        docs = docs.mapInArrow(lambda batches, shared=shared: clean(batches, shared.value), docs.schema)
    return docs


def _found(b: pa.RecordBatch, units: Units) -> tuple[dict[tuple[int, object], list], np.ndarray, np.ndarray]:
    """By row of a batch and item: the units found, the edits and size of the best one, and the bytes from and to which they reach; with
    the flat texts and their offsets."""
    overlap = 4 * (UNIT + int(RATE * UNIT) + Q)
    flat, offsets = buffers(column(b, "text"))
    best: dict[tuple[int, object], list] = {}
    for i, j in slices(offsets):
        base = offsets[i]
        text, source, of = normalised(flat[base : offsets[j]], offsets[i : j + 1] - base)
        for lo in range(0, len(text), _STRETCH):
            shift = max(0, lo - overlap)
            part = text[shift : lo + _STRETCH]
            unit, band = units.candidates(part)
            if not len(unit):
                continue
            edits, ends = units.verified(part, unit, band)
            for k in np.flatnonzero(edits <= units.edits[unit]):
                u = int(unit[k])
                last = int(min(max(ends[k] + shift - 1, 0), len(text) - 1))
                row = int(np.searchsorted(of, last, side="right")) - 1
                first = int(max(of[row], last - units.size[u] + 1))
                span = (int(source[first]) + base, int(source[last]) + base + 1)
                got = best.setdefault((i + row, units.item[u]), [set(), edits[k], units.size[u], *span])
                got[0].add(u)
                if edits[k] * got[2] < got[1] * units.size[u]:
                    got[1:3] = edits[k], units.size[u]
                got[3:] = min(got[3], span[0]), max(got[4], span[1])
    return best, flat, offsets


def _scan(batches: Iterator[pa.RecordBatch], units: Units, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for b in batches:
        best, flat, offsets = _found(b, units)
        keys = sorted(best, key=lambda x: x[0])
        rows = [best[k] for k in keys]
        point = lambda i, at: len(flat[offsets[i] : at].tobytes().decode(errors="ignore"))
        yield pa.RecordBatch.from_arrays([
            column(b, "doc_id").take(pa.array([i for i, _ in keys], pa.int64())), pa.array([x for _, x in keys], item_type), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([int(r[1]) for r in rows], pa.int64()),
            pa.array([1 - float(r[1]) / float(r[2]) for r in rows], pa.float64()), pa.array([point(i, r[3]) for (i, _), r in zip(keys, rows, strict=True)], pa.int64()), pa.array([point(i, r[4]) for (i, _), r in zip(keys, rows, strict=True)], pa.int64()),
        ], ["doc_id", "item_id", "n_units", "edits", "agreement", "start", "end"])
