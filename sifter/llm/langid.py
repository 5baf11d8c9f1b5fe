"""Language identification by hyperdimensional letter profiles.

Every letter has a random +1/-1 vector (seeded by its code point). A trigram is the product of its letters' vectors, each
rotated by its place (binding); a text is the sum of its trigrams' vectors weighted by their counts (bundling); a language
is the sum of its training texts' unit vectors. Texts are compared with languages by cosine, after the mean of all
prototypes, which mostly holds what the languages share, has been taken from both.

Trigrams run over lower-case letters with one gap symbol for every run of other characters, and whole texts are read.
Prototypes and floors are learnt from all labelled rows of the ``LANGUAGES`` most frequent labels.

The best of the centred cosines is never below 0 where there are two languages or more, so it can't tell a text in none of
them. ``floors`` therefore learns how near a language's own texts come to its prototype: their affinity is the mean inner product of
a text's trigrams with the uncentred prototype, whose expectation doesn't depend on length and whose error goes with the root of
the number of distinct trigrams. Quantiles are over all labelled rows, of values rounded to the ``FINE`` units, so that counting them
takes no more room for more rows. With floors, a text whose affinity is below both the language's floor and that for its number of
trigrams is ``und`` as well; texts of few distinct trigrams (about 40) can't be told and stay.

Cases: a null text, or one without a letter, is ``und`` with score 0; a null language or id trains nothing; with no
training rows everything is ``und``; equal scores go to the language first in order; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import buffers, column, slices, stream, trimmed
from ._io import dropped, stored

DIM = 1024
#: Languages learnt at most: the most frequent labels.
LANGUAGES = 512
#: Distinct trigrams whose vectors are made at once, and codes that are ranked by a table.
PART, TABLE = 2048, 1 << 23
#: Texts measured at once.
TEXTS = 512
UND = "und"
_ADDED = (T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()))
_GAP = 0
#: A floor is this many times as far below the median as the QUANTILE of the language's texts, within the bounds (shares of the
#: median), which hold where few texts or wrong labels make the quantile useless; a text half in one language and half in another
#: has about half of the median, and stays.
FAR, QUANTILE = 2.0, 0.01
AT_LENGTH, BY_LENGTH = (0.55, 0.65), (6.0, 12.0)
#: Units of affinities, and of their distances from the median times the root of the number of trigrams.
FINE = (1e-5, 1e-4)


def _letters() -> np.ndarray:
    """The letter that each character of the basic plane stands for, in lower case; the gap where it is no letter."""
    out = np.zeros(0x10000, np.int64)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_LETTER: list[np.ndarray] = []


def letter_codes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of UTF-8 texts with one gap for every run of other characters and between texts; the text each belongs to; and
    which gaps part texts."""
    if not _LETTER:
        _LETTER.append(_letters())
    n = len(offsets) - 1
    points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])[offsets]  # where each text begins, in characters
    codes = np.full(len(points) + n + 1, _GAP, np.int64)
    spot = np.arange(len(points)) + 1 + np.repeat(np.arange(n), np.diff(at))
    own = _LETTER[0][np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        own[i] = points[i] if chr(points[i]).isalpha() else _GAP
    codes[spot] = own
    text = np.zeros(len(codes), np.int64)
    text[spot] = np.repeat(np.arange(n), np.diff(at))
    keep = (codes != _GAP) | np.concatenate([[True], codes[1:] != codes[:-1]])
    run = np.cumsum(keep) - 1
    parting = np.bincount(run[at + np.arange(n + 1)], minlength=run[-1] + 1) > 0
    return codes[keep], text[keep], parting


class Profiles:
    """Bundles of trigram vectors of many texts at once."""

    def __init__(self, dim: int = DIM):
        self.dim, self.letters = dim, {}

    def _made(self, code: int) -> np.ndarray:
        bits = np.unpackbits(stream(1000 + code, self.dim // 64).view(np.uint8))
        return bits.astype(np.int8) * 2 - 1

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 1 << 14:
                self.letters = {}
            self.letters[code] = self._made(code)
        return self.letters[code]

    def measured(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: its unit vector, the length that it had as a mean of unit trigram vectors, and its number of distinct
        trigrams; zeros without a letter."""
        n = len(offsets) - 1
        total, length, grams = np.zeros((n, self.dim)), np.zeros(n), np.zeros(n, np.int64)
        codes, text, parting = letter_codes(flat, offsets)
        inner = ~parting[1:-1] & np.ones(max(len(codes) - 2, 0), bool)
        if not inner.any():
            return total, length, grams
        names, small = _ranks(codes)
        k = len(names)
        found, which = _ranks(((small[:-2] * k + small[1:-1]) * k + small[2:])[inner])
        text = text[1:-1][inner]
        rolled = [np.stack([np.roll(self.letter(c), d) for c in names.tolist()]) for d in (2, 1, 0)]
        order = np.argsort(which // PART, kind="stable")
        parts = -(-len(found) // PART)
        cuts = np.searchsorted((which // PART)[order], np.arange(parts + 1))
        for i in range(parts):
            own = order[cuts[i] : cuts[i + 1]]
            part = found[i * PART : (i + 1) * PART]
            counts = np.bincount(text[own] * len(part) + (which[own] - i * PART), minlength=n * len(part)).reshape(n, len(part))
            bound = rolled[0][part // (k * k)] * rolled[1][part // k % k] * rolled[2][part % k]
            total += counts.astype(np.float32) @ bound.astype(np.float32)  # whole numbers, exact below 2**24
            grams += (counts > 0).sum(axis=1)
        size = np.sqrt((total * total).sum(axis=1))
        count = np.bincount(text, minlength=n)
        return total / np.maximum(size, 1e-300)[:, None], size / np.maximum(count * np.sqrt(self.dim), 1), np.where(size > 0, grams, 0)


def _some(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are measured at once, by size and number."""
    for i, j in slices(offsets):
        for k in range(i, j, TEXTS):
            yield k, min(j, k + TEXTS)


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the rank of each; by a table where they are small."""
    most = int(values.max()) + 1
    if most > TABLE:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[values] = True
    return np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32)[values].astype(np.int64) - 1


def _labelled(docs: DataFrame, training: Column) -> DataFrame | None:
    """lang and text of the labelled rows where ``training`` holds, of the most frequent languages; None without any."""
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    found = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    return rows.where(F.col("lang").isin(found)).select("lang", "text") if found else None


def train(docs: DataFrame, training: Column, dim: int = DIM) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages in the rows where ``training`` holds."""
    rows = _labelled(docs, training)
    if rows is None:
        return {}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, total = Profiles(dim), {}
        for b in batches:
            names = np.array(column(b, "lang").to_pylist(), object)
            flat, offsets = buffers(column(b, "text"))
            for i, j in _some(offsets):
                vectors = profiles.measured(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]
                for lang in set(names[i:j]):
                    total[lang] = total.get(lang, 0) + vectors[names[i:j] == lang].sum(axis=0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "at", "value"])

    out: dict[str, np.ndarray] = {}
    # Rounded before summing, so that the order in which partitions end changes nothing.
    for r in rows.mapInArrow(trimmed(sums), "lang STRING, at INT, value DOUBLE").groupBy("lang", "at").agg(F.sum(F.round(F.col("value") * 1e6).cast("long")).alias("v")).collect():  # LANGUAGES times DIM
        out.setdefault(r["lang"], np.zeros(dim))[r["at"]] = r["v"] / 1e6
    return {k: v / max(1e-12, float(np.linalg.norm(v))) for k, v in sorted(out.items())}


def _quantiles(rows: DataFrame, value: Column, unit: float, *shares: float) -> dict[str, list[float]]:
    """By language the quantiles of a value rounded to ``unit``, linear between ranks: counts of the distinct values, and one row of each
    language to the driver."""
    each = Window.partitionBy("lang")
    counts = rows.groupBy("lang", F.round(value / unit).cast("long").alias("v")).agg(F.count("*").alias("n"))
    counts = counts.select("lang", "v", F.sum("n").over(each.orderBy("v")).alias("upto"), F.sum("n").over(each).alias("all"))
    rank = [(F.col("all") - 1) * F.lit(float(q)) for q in shares]
    at = [[F.min(F.when(F.col("upto") > near(r), F.col("v"))) for near in (F.floor, F.ceil)] + [F.first(r - F.floor(r))] for r in rank]
    found = counts.groupBy("lang").agg(*(x.alias(f"q{i}_{j}") for i, q in enumerate(at) for j, x in enumerate(q)))
    return {lang: [unit * (low + (high - low) * part) for low, high, part in zip(*[iter(q)] * 3, strict=True)] for lang, *q in found.collect()}


def floors(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> dict[str, tuple[float, float, float]]:
    """By language, from the labelled rows of ``docs``: the median affinity of its texts, how far below it a text of any length may
    be, and how far at one distinct trigram, which falls with the root of their number."""
    rows = _labelled(docs, F.col("lang").isin(list(prototypes))) if prototypes else None
    if rows is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(len(next(iter(prototypes.values()))))
        for b in batches:
            names = column(b, "lang").to_pylist()
            flat, offsets = buffers(column(b, "text"))
            out = [(np.zeros(0), np.zeros(0, np.int64))]
            for i, j in _some(offsets):
                own, size, grams = profiles.measured(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out.append((np.einsum("ij,ij->i", own, np.stack([prototypes[x] for x in names[i:j]])) * size, grams))
            near, grams = (np.concatenate(x) for x in zip(*out, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(near), pa.array(grams)], ["lang", "near", "grams"])
            yield batch.filter(pa.array(grams > 0))

    near = stored(rows.mapInArrow(trimmed(run), "lang STRING, near DOUBLE, grams BIGINT"))
    middle = _quantiles(near, F.col("near"), FINE[0], 0.5, QUANTILE)
    if not middle:
        dropped(near)
        return {}
    from_middle = F.col("near") - F.create_map(*(F.lit(x) for k, v in middle.items() for x in (k, v[0])))[F.col("lang")]
    by_length = _quantiles(near, from_middle * F.sqrt("grams"), FINE[1], QUANTILE)
    dropped(near)
    below = lambda x, m, bounds: m * float(np.clip(-FAR * x / m, *bounds)) if m > 0 else 0.0
    return {k: (m, below(low - m, m, AT_LENGTH), below(by_length[k][0], m, BY_LENGTH)) for k, (m, low) in middle.items()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], least: dict[str, tuple[float, float, float]] | None = None, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score (the best cosine, from -1..1 to 0..1) and margin over the next
    language (or over -1), their names after ``prefix``; columns of these names are replaced. With ``least``, floors by language, texts below them are ``und``."""
    names = list(prototypes)
    table = np.stack([*prototypes.values()]) if names else np.zeros((0, DIM))
    mean = table.mean(axis=0) if len(names) > 1 else np.zeros(table.shape[1])
    centred = table - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    dim = table.shape[1]
    below = np.array([(least or {}).get(x, (0.0, np.inf, np.inf)) for x in names]).reshape(-1, 3).T
    added = [T.StructField(prefix + f.name, f.dataType) for f in _ADDED]
    docs = docs.drop(*(f.name for f in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dim)
        for b in batches:
            flat, offsets = buffers(column(b, "text"))
            pred, score, margin = [UND] * len(b), np.zeros(len(b)), np.zeros(len(b))
            for i, j in _some(offsets) if names else ():
                own, size, grams = profiles.measured(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                v = own - mean
                cos = np.round(v @ centred.T / np.maximum(1e-12, np.linalg.norm(v, axis=1))[:, None], 9)
                best, rows = cos.argmax(axis=1), np.arange(j - i)
                top = cos[rows, best]
                cos[rows, best] = -1
                far = below[0][best] - (own * table[best]).sum(axis=1) * size > np.maximum(below[1][best], below[2][best] / np.sqrt(np.maximum(grams, 1)))
                for k in np.flatnonzero((grams > 0) & ~far).tolist():
                    pred[i + k] = names[best[k]]
                score[i:j] = np.where(grams > 0, (1 + top) / 2, 0)
                margin[i:j] = np.where(grams > 0, top - cos.max(axis=1), 0)
            arrays = [pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(margin)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, *added]))
