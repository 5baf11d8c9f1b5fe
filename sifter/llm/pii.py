"""Personal data: exact base patterns, plus spans chosen by gradient boosting over candidate generators.

Base spans follow four fixed patterns and always stay. High-recall generators then propose further,
overlapping spans (numbers written without a plus, cards in other groupings, e-mail and network addresses
spelt out, network addresses in hexadecimal groups), boosted trees score each proposal from its format and its context, and proposals above the
calibrated threshold of their kind are kept, best first, where they overlap neither a base span nor a
better proposal.

The trees are trained here on a generated, seeded sample (``TRAINING`` proposals: each kind in its usual layouts
and contexts against order numbers, dates, versions, amounts and prose), half for fitting, a quarter for
calibration and a quarter for the thresholds. No corpus row is needed, so results don't depend on the table.

Cases: a null or empty text has no spans; texts are read whole; repeated rows give repeated results; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrays import column
from ._boosting import BoostedTrees
from ._spans import SPANS, Cover, Span, span_digest, spans_array

KINDS = ("email", "ip", "card", "phone")
TRAINING = 8000
#: Share of kept proposals that must be right, on generated rows held back for it.
PRECISION = 0.99

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _RUN = re.compile(r"[0-9]"), re.compile(r"[0-9]+")

_NUMBER = re.compile(r"(?<![\w.+])[(+]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}(?!\w)")
#: An e-mail address that is spelt out is found from what stands for its at-sign.
_AT = re.compile(r"\s?(?:@|＠|[\[({]\s?(?:at|AT)\s?[\])}])\s?|\s(?:at|AT)\s")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}$")
_PLACE = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9-]{2,63}){1,4}")
#: An address in four parts with other points than plain ones, or in hexadecimal groups.
_PARTS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s|\s\.\s|,)[0-9]{1,3}){3}(?![0-9]|[.,][0-9])")
_GROUPS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,15}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_CUES = {
    "email": re.compile(r"(?i)e-?mail|mail|contact|write|reach"),
    "ip": re.compile(r"(?i)\bip(?:v[46])?\b|host|server|address|addr|ping|gateway|dns|route|login from"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|debit|pay|pan\b"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|cell|fax|sms|dial|ring"),
}
_AGAINST = re.compile(r"(?i)order|invoice|isbn|version|item|total|date|serial|build|ref|sku|page|id\b|no\b|nr\b|#|\$|€|%")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping per kind; a match that fails its test is dropped.

    An address is found from its at-sign: its local part is the run of local characters before it, as far as the
    previous match or at-sign allows, so no position is scanned twice."""
    out = []
    if "@" in text:
        free = 0
        at = text.find("@")
        while at >= 0:
            head = text[free:at]
            start = at - (len(head) - len(head.rstrip(_LOCAL)))
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append(Span(start, m.end(), "email"))
            free = m.end() if m else at + 1
            at = text.find("@", free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append(Span(m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(Span(m.start(), m.end(), "phone"))
    return out


def proposals(text: str) -> list[Span]:
    """Overlapping candidate spans of high recall: every long digit group as each kind it could be, and
    addresses that are spelt out."""
    out = []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = sum("0" <= c <= "9" for c in m[0])
            if 7 <= n <= 15:
                out.append(Span(m.start(), m.end(), "phone"))
            if 13 <= n <= 19:
                out.append(Span(m.start(), m.end(), "card"))
        out += [Span(m.start(), m.end(), "ip") for m in _PARTS.finditer(text) if all(int(x) < 256 for x in _RUN.findall(m[0]))]
        if "::" in text or text.count(":") > 4:
            out += [Span(m.start(), m.end(), "ip") for m in _GROUPS.finditer(text) if _DIGIT.search(m[0])]
    for m in _AT.finditer(text):
        name = _NAME.search(text, max(0, m.start() - 64), m.start())
        place = _PLACE.match(text, m.end())
        if name and place:
            out.append(Span(name.start(), place.end(), "email"))
    return out


def features(text: str, spans: list[Span]) -> np.ndarray:
    """Format and context of each proposal as small integers."""
    rows = []
    for start, end, kind in spans:
        s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
        digits = re.sub(r"[^0-9]", "", s)
        groups = [len(g) for g in re.findall(r"[0-9]+", s)]
        rows.append([
            KINDS.index(kind), min(len(digits), 31), min(len(groups), 31), max(groups, default=0), min(groups, default=0),
            groups[-1] if groups else 0, groups[0] if groups else 0, s.count("-"), s.count(" "), s.count("."), s.count("/"), s.count("(") + 2 * s.count(")"),
            int(s[:1] == "+"), int(bool(digits) and luhn(digits)), int(digits[:1] or 10), len(set(digits)),
            int(bool(_CUES[kind].search(before))), int(any(c.search(before) for k, c in _CUES.items() if k != kind)), int(bool(_AGAINST.search(before))),
            int(bool(re.match(r"\s?(?:%|€|\$|kg|km|pages|items)", after))), int(bool(re.search(r"(?i)[\[({]\s?at|＠", s))) + 2 * int(bool(re.search(r"(?i)dot", s))),
            sum(c.isalpha() for c in s) // 4, int(len(groups) == 4 and all(g <= 3 for g in groups)),
            s.count(":"), int("::" in s), max(map(len, re.split(r"[^0-9A-Za-z]+", s))), int(s.isupper() or s.islower()), int(bool(re.search(r"\s(?:at|AT)\s", s))), int(bool(re.match(r"[A-Za-z]+\b(?![._%+0-9-])", s))), s.count("[") + s.count("{"), s.count(","),
        ])
    return np.array(rows, np.int64).reshape(len(spans), 31)


def _training(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals of generated sentences with their labels."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "er", "the", "on", "in", "es", "re", "lo", "mi", "ta"]) for _ in range(r.randint(1, 4)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return r.choice(["{}{}{}{}", "{} {} {} {}", "{}-{}-{}-{}", "{}.{}.{}.{}", "{}/{}/{}/{}"]).format(*(body[i : i + 4] for i in range(0, 16, 4)))

    def phone() -> str:
        a, b, c = r.choice("23456789") + d(2), d(3), d(4)
        return r.choice(["({}) {}-{}", "({}){}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "1-{}-{}-{}", "00{} {} {}"]).format(a, b, c)

    def email() -> str:
        return r.choice(["{} (at) {} (dot) com", "{}[at]{}[dot]org", "{} at {} dot net", "{}＠{}.com", "{} @ {}.org", "{} [at] {}.com", "{} at {}.org"]).format(word() + r.choice(["", d(2), "." + word()]), word())

    def ip() -> str:
        four = [str(r.randint(0, 255)) for _ in range(4)]
        eight = [f"{r.getrandbits(16):x}" for _ in range(8)]
        short = eight[: r.randint(1, 4)], eight[4 : r.randint(5, 8)]
        return r.choice([lambda: r.choice(["[.]", "(.)", " dot ", "[dot]", "(dot)", " . ", " [.] "]).join(four), lambda: ":".join(eight), lambda: ":".join(short[0]) + "::" + ":".join(short[1])])()

    cue = {
        "card": ["card ", "Visa: ", "credit card no. ", "pay with "], "phone": ["call ", "tel. ", "Phone: ", "mobile "],
        "email": ["mail ", "e-mail: ", "write to ", "contact "],
        "ip": ["ip ", "host ", "address: ", "server at ", "ping "],
    }
    noise = [
        lambda: "order " + d(r.randint(7, 16)), lambda: "invoice no " + d(8) + "-" + d(4), lambda: f"{r.randint(1900, 2030)}-{d(2)}-{d(2)} {d(2)}", lambda: f"{d(2)}/{d(2)}/{r.randint(1900, 2030)}",
        lambda: f"version {d(1)}.{d(2)}.{d(3)}.{d(4)}", lambda: "isbn 978-" + d(1) + "-" + d(4) + "-" + d(4) + "-" + d(1), lambda: "total " + d(3) + " " + d(3) + " " + d(3) + " $", lambda: word() + " " + d(16), lambda: word() + " " + d(r.randint(7, 19)), lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
        lambda: word() + " at " + word() + " dot " + word(), lambda: "look at the red dot on " + word(), lambda: word() + " " + ".".join(d(r.randint(1, 4)) for _ in range(4)), lambda: "ref " + d(4) + " " + d(4) + " " + d(4) + " " + d(4), lambda: word() + " " + d(3) + " " + d(2) + " " + d(4),
        lambda: "section " + " . ".join(d(1) for _ in range(4)), lambda: word() + " " + ",".join(d(r.randint(1, 2)) for _ in range(4)), lambda: "at " + ":".join(d(2) for _ in range(r.randint(3, 4))), lambda: "mac " + ":".join(f"{r.getrandbits(8):02x}" for _ in range(6)),
        lambda: "key " + ":".join(f"{r.getrandbits(8):02x}" for _ in range(16)), lambda: word() + " " + d(1) + "::" + word(), lambda: word() + "::" + word() + d(1), lambda: r.choice(["look", "sold", "shown", "hosted", "open", word()]) + " at " + word() + "." + r.choice(["com", "org", "net", "de"]), lambda: word() + " at " + word() + ". " + word().capitalize(),
        lambda: "@ " + word() + " " + word() + "." + word(), lambda: word() + " @ " + word() + " " + word(),
    ]
    xs, ys = [], []
    while len(ys) < TRAINING:
        kind = r.choice(["card", "phone", "email", "ip", "noise", "noise", "noise"])
        lead = word() + " " + word() + " "
        if kind == "noise":
            text, gold = lead + r.choice(noise)() + " " + word(), None
        else:
            value = {"card": card, "phone": phone, "email": email, "ip": ip}[kind]()
            lead += r.choice(cue[kind]) if r.random() < 0.7 else ""
            text, gold = lead + value + " " + word(), (len(lead), len(lead) + len(value), kind)
        spans = proposals(text)
        xs += list(features(text, spans))
        ys += [float(gold is not None and s.kind == gold[2] and s.start < gold[1] and gold[0] < s.end) for s in spans]
    return np.array(xs), np.array(ys)


@functools.cache
def model(seed: int = 7) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees and a threshold per kind (2: never): the least score from which on held-back proposals reach PRECISION."""
    x, y = _training(seed)
    part = np.arange(len(y)) % 4
    trees = BoostedTrees().fit(x[part < 2], y[part < 2]).calibrate(x[part == 2], y[part == 2])
    p, truth, kind = trees.predict(x[part == 3]), y[part == 3], x[part == 3][:, 0]
    cuts = []
    for k in range(len(KINDS)):
        order = np.argsort(-p[kind == k], kind="stable")
        hits = np.cumsum(truth[kind == k][order])
        good = np.flatnonzero(hits / np.arange(1, len(hits) + 1) >= PRECISION) if len(order) else []
        cuts.append(max(0.5, float(p[kind == k][order][good[-1]])) if len(good) else 2.0)
    return trees, tuple(cuts)


def added_spans(text: str, base: list[Span], trees: BoostedTrees, cuts: tuple[float, ...]) -> list[Span]:
    taken = Cover(base)
    spans = [s for s in proposals(text) if not taken.meets(s)]
    if not spans:
        return []
    score = np.concatenate([trees.predict(features(text, spans[i : i + 4096])) for i in range(0, len(spans), 4096)])
    out: list[Span] = []
    taken = Cover()
    for i in np.argsort(-score, kind="stable"):
        s = spans[i]
        if score[i] >= cuts[KINDS.index(s.kind)] and not taken.meets(s):
            taken.add(s)
            out.append(s)
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans of every text, each as ARRAY<STRUCT<start, end, kind>>."""
    trees, cuts = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = [base_spans(t or "") for t in column(b, "text").to_pylist()]
            added = [added_spans(t or "", x, trees, cuts) for t, x in zip(column(b, "text").to_pylist(), base, strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), spans_array(base), spans_array(added)], ["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPANS}, added {SPANS}")


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their hash, and all spans as text."""
    return span_digest(found, KINDS, KINDS)
