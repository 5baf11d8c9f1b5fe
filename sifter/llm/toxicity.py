"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Labels say toxic or not, no more; severity grades are made from them: clean rows have grade 0, toxic rows grade 1, 2 or 3 by thirds of
the strength of toxic wording in them, the summed log odds of their features. The odds for a row come from the other half of
the rows, so its own label has no part in its grade; still, grades above 1 say how much known toxic wording a text has, not how a
person would grade it. One weight vector is shared by the ordered thresholds, P(grade > g) = sigmoid(w . x - t_g) with
t_0 < t_1 < t_2, and the expected severity is the sum of these.

Features are the words of a text and the beginnings of its words (5 and 7 bytes, which catches inflected and compounded
forms), by 32-bit hash, valued log(1 + count). Only the ``FEATURES`` that are most significantly more frequent in toxic rows are
used; they are counted and chosen where the rows are, and the driver gets those features of the sampled rows only. The model is
fitted on at most about ``TOXIC`` toxic and ``CLEAN`` clean labelled ids, taken by a hash and weighted back to the shares in all labels;
held-out rows are never among them. Prediction covers every row and the whole text.

Cases: a null or empty text has no features and gets the severity of the intercepts; a label that is null or has no
document is not used; several labels of a document weigh as several rows; rows equal in id and text train once; without both classes
every severity is 0; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import buffers, column, folded, hash_spans, slices, word_bounds
from ._io import dropped, stored

TOXIC, CLEAN = 3000, 5000
GRADES = 4
STARTS = (5, 7)
FEATURES = 4096
#: Least chi-square of a feature, and least number of toxic rows with it.
CHI2, SUPPORT = 24.0, 4
#: A row is called toxic from this P(grade > 0) on.
CUT = 0.5

_PARTS = np.ones(256, bool)
_PARTS[0x30:0x3A] = _PARTS[0x61:0x7B] = _PARTS[0x80:] = False


class Model(NamedTuple):
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice: its first row, and the row (from there) and hash of each word and word start."""
    flat, offsets = buffers(texts)
    for i, j in slices(offsets):
        part = folded(flat[offsets[i] : offsets[j]])
        starts, ends, of = word_bounds(part, offsets[i : j + 1] - offsets[i], _PARTS)
        row = np.repeat(np.arange(j - i), np.diff(of))
        rows, hashes = [row], [hash_spans(part, starts, ends)]
        for k, n in enumerate(STARTS, 1):
            long = ends - starts >= n
            rows.append(row[long])
            hashes.append(hash_spans(part, starts[long], starts[long] + n) ^ np.uint64(k))
        yield i, np.concatenate(rows), np.concatenate(hashes).astype(np.uint32)


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """Labelled rows of both classes with their numbers of labels, and how many labels each sampled one stands for."""
    good = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("times"))
    count = {r["toxic"]: r["n"] for r in good.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, most / count[c]) for c, most in ((0, CLEAN), (1, TOXIC)) if c in count}
    scale = 1 << 30
    cut = F.when(F.col("toxic") == 1, int(share.get(1, 0) * scale)).otherwise(int(share.get(0, 0) * scale))
    picked = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < cut)
    # About TOXIC + CLEAN ids, each once for a class: broadcast, so that no text is shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")).withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text", "toxic"]).drop("doc_id", "_text"), {c: 1 / s for c, s in share.items()}


def _counted(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, distinct features and their counts, of each text that has any."""
    for i, row, hashes in _features(texts):
        key, count = np.unique(row.astype(np.uint64) << np.uint64(32) | hashes, return_counts=True)
        of = (key >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(of)) + 1
        for own in np.split(np.arange(len(key)), cuts) if len(key) else ():
            yield i + int(of[own[0]]), (key[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32), count[own]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows, weight = _sample(docs, labels)
    rows = stored(rows)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.sum("times").alias("n")).collect()}
    if len(n) < 2:
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.full(GRADES - 1, np.inf))
    half = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.sum("times").alias("n")).collect()}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: list = [[]] * len(b)
            for k, names, _ in _counted(column(b, "text")):
                sets[k] = names.astype(np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "toxic"), column(b, "fold"), column(b, "times"), pa.array(sets, pa.list_(pa.int64()))], ["toxic", "fold", "times", "names"])

    one = rows.mapInArrow(present, "toxic INT, fold INT, times BIGINT, names ARRAY<BIGINT>").select("toxic", "fold", "times", F.explode("names").alias("name"))
    within = lambda toxic, fold: F.coalesce(F.sum(F.when((F.col("toxic") == toxic) & (F.col("fold") == fold), F.col("times"))), F.lit(0)).cast("double")
    counts = one.groupBy("name").agg(*(within(t, f).alias(f"c{t}{f}") for t in (0, 1) for f in (0, 1))).withColumns({"a": F.expr("c10 + c11"), "b": F.expr("c00 + c01")})
    n1, n0 = float(n[1]), float(n[0])
    apart = F.col("a") * n0 - F.col("b") * n1
    total = F.col("a") + F.col("b")
    chi2 = apart * apart * (n1 + n0) / F.greatest(F.lit(1.0), n1 * n0 * total * (n1 + n0 - total))
    chosen = counts.withColumn("chi2", chi2).where((F.col("a") >= SUPPORT) & (apart > 0) & (F.col("chi2") >= CHI2)).orderBy(F.desc("chi2"), "name").limit(FEATURES).collect()
    names = np.array(sorted(r["name"] for r in chosen), np.uint32)
    by = {r["name"]: r for r in chosen}
    odds = np.array([[np.log((by[x][f"c1{f}"] + 0.5) * (half.get((f, 0), 0) + 1) / ((by[x][f"c0{f}"] + 0.5) * (half.get((f, 1), 0) + 1))) for x in names.tolist()] for f in (1, 0)]).reshape(2, -1)  # by fold, from the other one

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list = [[]] * len(b)
            times: list = [[]] * len(b)
            for k, own, count in _counted(column(b, "text")):
                spot = np.searchsorted(names, own)
                hit = (spot < len(names)) & (names[np.minimum(spot, len(names) - 1)] == own) if len(names) else np.zeros(len(own), bool)
                at[k], times[k] = spot[hit].astype(np.int32), count[hit].astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(b, "toxic"), column(b, "fold"), column(b, "times"), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["toxic", "fold", "times", "at", "counts"])

    got = rows.mapInArrow(kept, "toxic INT, fold INT, times BIGINT, at ARRAY<INT>, counts ARRAY<INT>").collect()  # about TOXIC + CLEAN rows of at most FEATURES numbers
    dropped(rows)
    got.sort(key=lambda r: (r["toxic"], r["fold"], r["times"], r["at"], r["counts"]))
    y = np.array([r["toxic"] for r in got])
    row = np.repeat(np.arange(len(got)), [len(r["at"]) for r in got])
    col = np.array([x for r in got for x in r["at"]], np.int64)
    value = np.log1p(np.array([x for r in got for x in r["counts"]], np.float64))
    fold = np.array([r["fold"] for r in got])
    strength = np.bincount(row, odds[fold[row], col] * value, len(y))
    return fit(names, row, col, value, y, strength, np.array([weight[int(r["toxic"])] * r["times"] for r in got]))


def fit(names: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, strength: np.ndarray, weight: np.ndarray) -> Model:
    """Grade the rows, and fit weights and thresholds by accelerated gradient descent."""
    cuts = np.quantile(strength[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (strength > cuts[0]).astype(int) + (strength > cuts[1]), 0)

    w, first, steps = np.zeros(len(names)), 2.0, np.zeros(GRADES - 2)  # thresholds: first, then first + exp(steps) summed
    theta = np.concatenate([w, [first], steps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, 601):
        w, cut = theta[: len(names)], np.cumsum(np.concatenate([theta[len(names) : len(names) + 1], np.exp(theta[len(names) + 1 :])]))
        z = np.bincount(row, w[col] * value, len(y))
        cdf = np.column_stack([np.zeros(len(y)), *(1 / (1 + np.exp(np.clip(z - c, -30, 30))) for c in cut), np.ones(len(y))])  # P(grade < g)
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[np.arange(len(y)), grade + 1] - cdf[np.arange(len(y)), grade], 1e-12)
        up, down = slope[np.arange(len(y)), grade + 1] / p, slope[np.arange(len(y)), grade] / p
        dz = weight * (up - down)
        dcut = np.array([-(weight * up)[grade == k].sum() + (weight * down)[grade == k + 1].sum() for k in range(GRADES - 1)])
        grad = np.concatenate([np.bincount(col, dz[row] * value, len(names)), [dcut.sum()], [np.exp(s) * dcut[i + 1 :].sum() for i, s in enumerate(theta[len(names) + 1 :])]]) / weight.sum()
        grad[: len(names)] += 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9) / np.sqrt(1 + t / 50)
    cut = np.cumsum(np.concatenate([theta[len(names) : len(names) + 1], np.exp(theta[len(names) + 1 :])]))
    return Model(names, theta[: len(names)].copy(), cut)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (0 to 3), p_toxic (P(grade > 0)), grade (the likeliest) and toxic of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.zeros(len(b))
            for i, row, hashes in _features(column(b, "text")) if len(model.features) else ():
                at = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
                hit = model.features[at] == hashes
                key, count = np.unique(row[hit] * len(model.features) + at[hit], return_counts=True)
                z += np.bincount(i + key // len(model.features), model.weights[key % len(model.features)] * np.log1p(count), len(b))
            over = 1 / (1 + np.exp(np.clip(model.thresholds[None] - z[:, None], -700, 700))) * np.isfinite(model.thresholds)
            part = np.column_stack([1 - over[:, 0], *(over[:, k] - over[:, k + 1] for k in range(GRADES - 2)), over[:, -1]])
            arrays = [pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(part.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= CUT)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *arrays], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, severity DOUBLE, p_toxic DOUBLE, grade INT, toxic BOOLEAN")
