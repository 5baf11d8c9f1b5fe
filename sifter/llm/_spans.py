"""Character spans in a text and their digest columns."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrays import column

SPANS = "ARRAY<STRUCT<start: BIGINT, end: BIGINT, kind: STRING>>"


class Span(NamedTuple):
    start: int
    end: int
    kind: str


class Cover:
    """Spans that are taken, as disjoint stretches in order."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        i = bisect_left(self.starts, span.end) - 1
        return i >= 0 and self.ends[i] > span.start

    def add(self, span: Span) -> None:
        """Takes one that meets none so far."""
        i = bisect_left(self.starts, span.start)
        self.starts.insert(i, span.start)
        self.ends.insert(i, span.end)


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end of all spans by start, then kind as listed, then end, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(set(spans), key=lambda s: (s.start, rank[s.kind], s.end)))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def redacted(text: str, spans: list[Span], mark: str = "<{}>") -> str:
    """The text with each maximal run of overlapping spans replaced by the mark of its first kind."""
    out, at = [], 0
    for s in sorted(spans):
        if s.start >= at:
            out += [text[at : s.start], mark.format(s.kind.upper())]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def spans_array(rows: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    return pa.array([[s._asdict() for s in x] for x in rows], kind)


def span_digest(found: DataFrame, base_kinds: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, the counts of its base spans by kind, their hash, and all spans as text; from doc_id, base and added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, added = ([[Span(**s) for s in x] for x in column(b, n).to_pylist()] for n in ("base", "added"))
            counts = [pa.array([sum(s.kind == k for s in x) for x in base], pa.int64()) for k in base_kinds]
            texts = [[digest(x, base_kinds) for x in base], [joined(x + y, kinds) for x, y in zip(base, added, strict=True)]]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *counts, *(pa.array(x, pa.string()) for x in texts)], ["doc_id", *(f"n_{k}" for k in base_kinds), "base_sha256", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "base", "added").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} BIGINT' for k in base_kinds)}, base_sha256 STRING, spans STRING")
