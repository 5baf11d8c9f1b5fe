"""Nearest neighbours by cosine with score-aware (anisotropic) product quantisation.

Vectors are scaled to length one, so cosine is the inner product. Each is coded by 4 bits for every ``WIDTH`` dimensions.
Codes and codebooks minimise a loss that weighs the part of the residual parallel to the vector more than the rest,
as that part is what changes large inner products: codes by coordinate descent, codebooks by the normal equations of the
same loss. Codebooks are fitted to at most ``SAMPLE`` vectors, taken by a hash of their ids; every vector is indexed.

A query's inner products with the codewords form 4-bit tables; two codes share a byte, so a scan adds one table entry
for each pair of codes. The ``rerank`` best of each group of vectors are scored exactly, in double precision, on the
original vectors. So is every other vector whose rough score is within its own quantisation error of the k-th exact score found:
the parallel and the rest of its residual, which are known, bound what its cosine can be. Nothing is lost, however many scaled or
near copies crowd the best. Equal vectors are scanned once and then stand for all their ids. Scores are rounded to 12 digits.

Vectors belong to the nearest of up to ``CELLS`` centres (spherical k-means on the sample). A query scans the ``PROBES`` cells nearest to it
first. A cell keeps the widest angle between its centre and a vector, so a query's cosine with any of its vectors is bounded;
in a second round, the query scans the other cells whose bound reaches the k-th score that it has found. Where vectors crowd, few cells are left
then; where they don't, all are, so nothing is lost either way. Large cells are cut into groups of about ``GROUP`` by a hash of the id and
a cell's queries into sets of at most ``QUERIES``; a task scans one group for one set and returns k rows for each query.

Cases: a null, zero or non-finite vector, or one of another length than most, takes no part; nor does a null id; ties go to
the smaller id; rows with a query's own id are not its neighbours; fewer candidates than k are all returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._arrays import column
from ._io import stored

WIDTH = 2
SAMPLE = 8192
CELLS, PROBES = 256, 8
GROUP = 16384
QUERIES = 16384
#: Inner products from here on matter; it sets the weight of the parallel residual.
THRESHOLD = 0.25
ROUNDS = 4
#: More than single precision loses in a rough score.
_SLACK = 1e-4


class Quantiser:
    """Codebooks of 16 words for each stretch of WIDTH dimensions."""

    def __init__(self, dim: int, threshold: float = THRESHOLD):
        self.dim = dim
        self.parts = -(-dim // WIDTH)
        self.parts += self.parts % 2  # an even number: two codes share a byte
        self.weight = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.words = np.zeros((self.parts, 16, WIDTH))

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors as (rows, parts, WIDTH)."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.pad(x, ((0, 0), (0, self.parts * WIDTH - self.dim))).reshape(len(x), self.parts, WIDTH)

    def fit(self, x: np.ndarray, seed: int = 11) -> Quantiser:
        x, rng = self.padded(x), np.random.default_rng(seed)
        for m in range(self.parts):  # plain k-means to begin with
            words = x[rng.choice(len(x), 16, replace=len(x) < 16), m]
            for _ in range(8):
                near = ((x[:, m, None] - words) ** 2).sum(axis=2).argmin(axis=1)
                count = np.bincount(near, minlength=16)
                for d in range(WIDTH):
                    words[:, d] = np.where(count > 0, np.bincount(near, x[:, m, d], 16) / np.maximum(count, 1), words[:, d])
            self.words[m] = words
        size = self.parts * 16 * WIDTH
        for _ in range(ROUNDS):
            codes = self.assign(x)
            place = ((np.arange(self.parts) * 16 + codes)[:, :, None] * WIDTH + np.arange(WIDTH)).reshape(len(x), -1)
            flat = x.reshape(len(x), -1)
            left, right = np.zeros((size, size)), np.zeros(size)
            for i in range(0, len(x), 1024):
                spread = np.zeros((len(flat[i : i + 1024]), size), np.float32)
                np.put_along_axis(spread, place[i : i + 1024], flat[i : i + 1024].astype(np.float32), axis=1)
                left += (self.weight - 1) * (spread.T @ spread)
            left[np.arange(size), np.arange(size)] += np.bincount(place.ravel(), minlength=size) + 1e-6
            right += np.bincount(place.ravel(), self.weight * flat.ravel(), size) + 1e-6 * self.words.ravel()
            self.words = np.linalg.solve(left, right).reshape(self.parts, 16, WIDTH)
        return self

    def assign(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes of padded unit vectors by coordinate descent on the anisotropic loss."""
        square = np.stack([((x[:, m, None] - self.words[m]) ** 2).sum(axis=2) for m in range(self.parts)], axis=1)
        along = np.stack([((x[:, m, None] - self.words[m]) * x[:, m, None]).sum(axis=2) for m in range(self.parts)], axis=1)
        codes, rows = square.argmin(axis=2), np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(passes):
            for m in range(self.parts):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (square[:, m] + (self.weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A byte for each two codes."""
        codes = np.concatenate([self.assign(self.padded(x[i : i + 2048])) for i in range(0, len(x), 2048)]).astype(np.uint8)
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def residual(self, x: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of coded vectors: the part of the residual along the unit vector, and the length of the rest."""
        along, rest = np.zeros(len(x)), np.zeros(len(x))
        for i in range(0, len(x), 2048):
            unit = self.padded(x[i : i + 2048])
            codes = np.stack([coded[i : i + 2048] >> 4, coded[i : i + 2048] & 15], axis=2).reshape(len(unit), -1)
            left = (unit - self.words[np.arange(self.parts), codes]).reshape(len(unit), -1)
            along[i : i + 2048] = (left * unit.reshape(len(unit), -1)).sum(axis=1)
            rest[i : i + 2048] = np.sqrt(np.maximum(0, (left**2).sum(axis=1) - along[i : i + 2048] ** 2))
        return along, rest

    def scan(self, queries: np.ndarray, coded: np.ndarray) -> np.ndarray:
        """Approximate cosines of all queries with all coded vectors."""
        q = self.padded(queries)
        out = np.zeros((len(q), len(coded)), np.float32)
        for m in range(0, self.parts, 2):
            pair = (q[:, m] @ self.words[m].T)[:, :, None] + (q[:, m + 1] @ self.words[m + 1].T)[:, None, :]
            out += pair.reshape(len(q), 256).astype(np.float32)[:, coded[:, m // 2]]
        return out


def _valid(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select("vec_id", "embedding")


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def centres(x: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means: unit centres of unit vectors."""
    out = x[np.random.default_rng(seed).choice(len(x), count, replace=False)]
    for _ in range(10):
        near = (x @ out.T).argmax(axis=1)
        total = np.zeros_like(out)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        out = np.where(size > 1e-9, total / np.maximum(size, 1e-9), out)
    return out


def train(vectors: DataFrame, dim: int, count: int, sample: int = SAMPLE) -> tuple[Quantiser, np.ndarray]:
    """The quantiser and at most ``count`` centres, from a bounded sample."""
    rows = vectors.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return Quantiser(dim).fit(x), centres(unit, max(1, min(count, CELLS, len(x) // 32)))


def _search(dim: int, k: int, rerank: int, model: Quantiser):
    """Of one group of a cell and one set of queries: the k best rows of each query."""

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(asks):
            x, q = (_matrix(t.column("embedding").combine_chunks(), dim) for t in (rows, asks))
            ids, own, floor = rows.column("vec_id").to_numpy(), asks.column("vec_id").to_numpy(), asks.column("floor").to_numpy()
            order = np.argsort(ids, kind="stable")
            _, first, same = np.unique(np.ascontiguousarray(x[order]).view(f"V{x.itemsize * dim}").ravel(), return_index=True, return_inverse=True)
            members = np.split(ids[order][np.argsort(same, kind="stable")], np.cumsum(np.bincount(same))[:-1])
            first = order[first]
            x = x[first].astype(np.float64)
            coded = np.frombuffer(b"".join(rows.column("codes").take(pa.array(first)).to_pylist()), np.uint8).reshape(len(first), -1)
            size, keep = np.sqrt((x * x).sum(axis=1)), min(rerank, len(x))
            along, rest = model.residual(x, coded)
            lowest, highest = np.array([m[0] for m in members]), np.array([m[-1] for m in members])
            for i in range(0, len(q), 128):
                part = q[i : i + 128].astype(np.float64)
                rough = model.scan(part, coded)
                best = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
                for j, v in enumerate(part):
                    exact = lambda near, v=v: np.round((x[near] * v).sum(axis=1) / (size[near] * np.sqrt((v * v).sum())), 12)
                    near, me = best[j], own[i + j]
                    score = exact(near)
                    others = np.sort(score[(lowest[near] != me) | (highest[near] != me)])
                    least = max(floor[i + j], others[-k] if len(others) >= k else -1.0) - _SLACK
                    # A cosine of at least ``least`` >= 0 needs this rough score; below 0 the bound says nothing.
                    may = rough[j] >= least * (1 - along) - np.sqrt(max(0.0, 1 - least * least)) * rest - _SLACK if least >= 0 else np.ones(len(x), bool)
                    may[near] = False
                    more = np.flatnonzero(may)
                    near, score = np.append(near, more), np.append(score, exact(more))
                    # The first ids of k sets of equal vectors, besides those whose first is the query's own, come before all later sets.
                    first_sets = np.lexsort((lowest[near], -score))[: k + int((lowest == me).sum())]
                    found = [(-s, int(n)) for s, r in zip(score[first_sets].tolist(), near[first_sets].tolist(), strict=True) for n in members[r][members[r] != me][:k]]
                    for s, n in sorted(found)[:k]:
                        out["query_id"].append(int(me))
                        out["vec_id"].append(n)
                        out["score"].append(-s)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, rerank: int = 200, group: int = GROUP, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows nearest to each row for which ``queries`` holds."""
    spark, shape = vectors.sparkSession, "query_id BIGINT, vec_id BIGINT, score DOUBLE"
    good = _valid(vectors)
    dims = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], shape).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    dim, n = dims
    good = good.where(F.size("embedding") == dim)
    model, middle = train(good, dim, math.ceil(n / group))
    kind, ids = (good.schema[c].dataType.simpleString() for c in ("embedding", "vec_id"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _matrix(column(b, "embedding"), dim).astype(np.float64)
                near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ middle.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in model.encode(x)], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(angle)], [*b.schema.names, "codes", "cell", "angle"])

    index = stored(good.mapInArrow(encode, f"vec_id {ids}, embedding {kind}, codes BINARY, cell INT, angle DOUBLE"))
    census = {r["cell"]: r for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}  # at most CELLS rows
    wide = np.array([census[c]["angle"] if c in census else -np.inf for c in range(len(middle))])

    def probed(first: bool):
        """A row for each query and cell to scan: the nearest cells first, then the others that may hold something better."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = _matrix(column(b, "embedding"), dim).astype(np.float64)
                near = np.where(np.isfinite(wide), (x / np.linalg.norm(x, axis=1, keepdims=True)) @ middle.T, -2)
                rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
                bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - wide - 1e-6))
                floor = column(b, "floor").to_numpy()
                row, cell = np.nonzero(np.isfinite(wide) & ((rank < probes) if first else (rank >= probes) & (bound >= floor[:, None] - _SLACK)))
                out = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

        return run

    def scanned(asked: DataFrame, first: bool) -> DataFrame:
        asks = stored(asked.select("vec_id", "embedding", "floor").mapInArrow(probed(first), f"vec_id {ids}, embedding {kind}, floor DOUBLE, cell INT"))
        count = {r["cell"]: r["n"] for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
        cut = spark.createDataFrame([(c, math.ceil(census[c]["n"] / group), math.ceil(m / QUERIES)) for c, m in count.items()], "cell INT, groups INT, sets INT")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        of = lambda c, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(c)).cast("int")
        left = index.join(F.broadcast(cut), "cell").withColumn("part", of("groups", 0)).withColumn("set", each("sets")).select("cell", "part", "set", "vec_id", "embedding", "codes")
        right = asks.join(F.broadcast(cut), "cell").withColumn("set", of("sets", 1)).withColumn("part", each("groups")).select("cell", "part", "set", "vec_id", "embedding", "floor")
        keys = ["cell", "part", "set"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(dim, k, rerank, model), shape)

    def ranked(found: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    # An id that repeats asks once, with the least of its vectors.
    asked = index.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("floor", F.lit(-2.0))
    best = ranked(scanned(asked, True))
    if len(census) > probes:
        best = stored(best)
        floor = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("_floor"))
        again = asked.join(floor, "vec_id", "left").withColumn("floor", F.coalesce("_floor", "floor"))
        best = ranked(best.drop("rank").unionByName(scanned(again, False)))
    return best.select("query_id", "rank", "vec_id", "score")
