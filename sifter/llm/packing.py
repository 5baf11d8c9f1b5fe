"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack.

Bins are planned from the histogram of piece lengths alone: pieces of one length are interchangeable, so the plan needs
at most ``capacity`` counters on the driver, whatever the number of rows. Per bin, the largest length left opens it and
a bitset subset-sum program over the lengths still available finds the fullest feasible combination for the rest. That
combination is removed as often as the counts allow, as minimum bin slack would find it again each time; every such step
uses up a length, so the number of distinct bins is bounded by the number of lengths, not of rows.

Rows then find their place without a sort: a piece's rank among those of its length is the number in earlier partitions
(a sum over partition counts) plus its index within its own, and a binary search in the plan gives sequence and offset.

Tokens come from a public tokenizer file, one call per distinct whitespace-delimited chunk: its normaliser and its
splitter never look across white space, so chunk ids concatenate to the ids of the text.

Cases: a null or empty text is the end token alone; only documents of more than ``capacity`` tokens are cut; repeated rows
are packed one by one; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._arrays import LOWER, buffers, column
from ._io import stored

CAPACITY = 4096
END = 1
#: Distinct chunks of each of the two generations that a Python worker remembers.
REMEMBERED = 200_000
_SEGMENT = 1 << 20
_CUT = re.compile(rb"[\x20\x09-\x0D]")
_PLAIN = re.compile("[!-@\\[-~à-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ]+|[0-9]|[^a-z0-9à-öø-ÿ]+")


class ChunkTokenizer:
    """Little-endian 32-bit ids of a text, put together from remembered chunks.

    Two generations are remembered: when the young one is full it becomes the old one, and what is used moves back.
    A chunk of printable ASCII and small Latin-1 letters goes to the merge model piece by piece, as the file's
    normaliser leaves it as it is; any other chunk goes through the whole tokenizer.
    """

    _own: dict[str, ChunkTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.young, self.old = Tokenizer.from_file(path), {}, {}
        model = self.whole.model
        spare = (*range(0x21), *range(0x7F, 0xA1), 0xAD)  # bytes that byte-level models spell by characters from 0x100 on
        table = {b: chr(0x100 + i) for i, b in enumerate(spare)}

        @functools.lru_cache(1 << 15)
        def piece(text: str) -> bytes:
            spelt = text if text.isascii() else text.encode().decode("latin-1").translate(table)
            return array("I", [t.id for t in model.tokenize(spelt)]).tobytes()

        self.piece = piece

    @classmethod
    def of(cls, path: str) -> ChunkTokenizer:
        """One for each worker process, so that tasks share what it remembers."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def chunk(self, raw: bytes) -> bytes:
        text = raw.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.piece, _PIECE.findall(text)))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.young) + len(chunks) > REMEMBERED:
            self.young, self.old = {}, self.young
        for c in chunks:
            if c not in self.young:
                self.young[c] = self.old.get(c) or self.chunk(c)

    def ids(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            m = _CUT.search(text, at + _SEGMENT) if at + _SEGMENT < len(text) else None
            parts = text[at : m.start() if m else len(text)].split()
            self.learn(set(parts))
            out += map(self.young.__getitem__, parts)
            at = m.end() if m else len(text)
        return b"".join(out)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, its partition, and its index among the pieces of its
    length there. Read it from a stored table, as partition and index hold for one evaluation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen, part = ChunkTokenizer.of(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            flat, offsets = buffers(column(b, "text"))
            # The file's normaliser lowers A-Z anyway, but not before special-token strings are looked for: without
            # any in sight, lowering here lets chunks that differ in case share one entry.
            low = (flat if b"<|" in flat.tobytes() else LOWER[flat]).tobytes()
            row, piece, start, length, crc, index = [], [], [], [], [], []
            for i in range(len(b)):
                ids = tok.ids(low[offsets[i] : offsets[i + 1]]) + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n := len(own) // 4)
                    crc.append(zlib.crc32(own))
                    index.append(seen[n])
                    seen[n] += 1
            arrays = [column(b, "doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.full(len(row), part, np.int32)), pa.array(index, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "index"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, part INT, index BIGINT")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum that is at most ``room``: bounded subset-sum on a bitset,
    larger lengths first, ending as soon as the room is filled exactly."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach = (reach | reach << length * k) & full
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            out[length] = out.get(length, 0) + k
    return out


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, ranks, per bin, first bin, offset in the bin) for all pieces, and the number of bins."""
    counts, used, rows, bins = {k: v for k, v in counts.items() if v}, {}, [], 0
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        inner = fullest({k: v for k, v in counts.items() if v}, capacity - largest)
        counts[largest] += 1
        content = dict(sorted((inner | {largest: inner.get(largest, 0) + 1}).items(), reverse=True))
        times, offset = min(counts[x] // n for x, n in content.items()), 0
        for x, n in content.items():
            rows.append((x, used.get(x, 0), n * times, n, bins, offset))
            used[x] = used.get(x, 0) + n * times
            counts[x] -= n * times
            offset += x * n
            if not counts[x]:
                del counts[x]
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6), bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    pieces = stored(tokenized_pieces(docs, tokenizer, capacity, end))
    here = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    rows = here.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    plan, _ = plan_bins({r["length"]: r["n"] for r in rows}, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # by the number of lengths, not of rows
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    first = here.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("index")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = p[:, 0] << 44 | p[:, 1]
        for b in batches:
            length, rank = (column(b, n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            own = p[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - own[:, 1]
            spots = [own[:, 4] + nth // own[:, 3], own[:, 5] + nth % own[:, 3] * length]
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in b.schema.names[:5]), *(pa.array(x, pa.int64()) for x in spots)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, sequence_id BIGINT, offset BIGINT")
