"""Secrets in texts: exact base patterns, plus multipart credentials linked by an interval join.

Base spans follow three fixed patterns and always stay. Weak candidates (a short or oddly named secret, a
high-entropy token, a user or key identifier) mean nothing alone; they are reported only where the parts of one
credential co-occur. Parts are identifiers (base access key ids among them), secrets and endpoints; each has the interval of its
scope, a whole block of text without blank lines, however long. An interval join on the sorted starts of the blocks links a weak
secret with the identifiers and endpoints of its interval; a weak identifier is reported with the secret (weak or base) that it is
linked to.

Cases: a null or empty text has no spans; texts are read whole; repeated rows give repeated results; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrays import column
from ._spans import SPANS, Cover, Span, redacted, span_digest, spans_array

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "weak_secret", "identifier")
#: Bits per character that a bare token of 20 or more characters needs.
ENTROPY = 3.5

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account|access_?key_?id|app_?id|uid)[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9@+/_.=-]{3,})", re.I | re.A)
_ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:https?|ftps?|ssh|redis|amqps?|mongodb|postgres(?:ql)?|mysql|jdbc:[a-z]+)://[^\s\"'<>]+|(?<![A-Za-z0-9])(?:host|server|endpoint|url)[\"']?[ \t]*[:=][ \t]*[\"']?[A-Za-z0-9][A-Za-z0-9._:/-]{3,}", re.I | re.A)
_WEAK = re.compile(r"(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase)?|pwd|pw|secret(?:_?access)?(?:_?key)?|client_?secret|auth(?:_?key)?|private_?key|api_?key|token|credential|pin)[\"']?[ \t]*[:=][ \t]*[\"']?([^\s\"',;]{4,})", re.I | re.A)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_SET = re.compile(r"[:=][ \t]*[\"']?$")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping per kind; a match that fails its test is dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [Span(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [Span(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [Span(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak secrets and identifiers that belong to a multipart credential."""
    keys = [s for s in base if s.kind == "access"]
    if not keys and ":" not in text and "=" not in text:
        return []
    names = [Span(m.start(), m.end(), "identifier") for m in _IDENTIFIER.finditer(text)]
    places = [Span(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    if not names and not places and not keys:
        return []
    own = Cover(base)
    weak = [s for m in _WEAK.finditer(text) if not own.meets(s := Span(m.start(), m.end(), "weak_secret"))]
    taken = Cover([*base, *weak, *names, *places])
    for m in _TOKEN.finditer(text):
        s = Span(m.start(), m.end(), "weak_secret")
        if re.search(r"[0-9]", m[0]) and re.search(r"[a-z]", m[0]) and re.search(r"[A-Z]", m[0]) and entropy(m[0]) >= ENTROPY and not taken.meets(s):
            weak.append(s)
    # A bare run of hex digits is as often a checksum; it is a secret of somebody's only where something is set to it.
    secrets = [s for s in base if s.kind == "assign" or s.kind == "hex" and _SET.search(text, max(0, s.start - 8), s.start)]
    if not weak and not secrets:
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    scope = lambda s: bisect_right(cuts, s.start)

    def near(left: Iterable[Span], right: Iterable[Span]) -> list[Span]:
        """Interval join: those of the left whose block holds one of the right. Blocks don't overlap, so a block is found by
        its start."""
        blocks = {scope(b) for b in right}
        return [a for a in left if scope(a) in blocks]

    out = set(near(weak, [*names, *places, *keys]))
    out |= {b for b in near(names, [*out, *secrets]) if not own.meets(b)}
    return sorted(out)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and spans added by linking, each as ARRAY<STRUCT<start, end, kind>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in column(b, "text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = [linked_spans(t, x) for t, x in zip(texts, base, strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), spans_array(base), spans_array(added)], ["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPANS}, added {SPANS}")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their hash, and all spans as text."""
    return span_digest(found, BASE_KINDS, KINDS)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every found secret replaced by a mark such as <HEX>; other columns are unchanged.

    A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            out = []
            for t in column(b, "text").to_pylist():
                base = base_spans(t) if t else []
                spans = base + linked_spans(t, base) if t else []
                out.append(redacted(t, spans) if spans else t)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
