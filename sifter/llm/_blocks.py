"""Texts in blocks of bounded size, and counts that blocks and buckets send each other.

A block is a few rows of a stored table: ids, flags and compressed texts that stood together in the input. Blocks have one size
whatever the ids are, so repeated and null ids make none of them larger, and passes over the texts read the table instead of
shuffling texts. A block sends what it has to buckets by hash; a bucket answers in the order that it was asked in, without keys,
as a block finds the same order again. A block sends no message to a bucket that it has nothing for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrays import buffers, column
from ._io import stored


#: Text of a row of a block table.
PART_BYTES = 1 << 20


def packed_bytes(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), dtype)


def packed_counts(values: np.ndarray) -> bytes:
    """Non-negative counts: a byte each, and those from 255 on once more in full."""
    return packed_bytes(np.concatenate([np.minimum(values, 255).astype(np.uint8), values[values >= 255].astype("<i8").view(np.uint8)]))


def unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    flat = unpacked(raw, np.uint8)
    out = flat[:n].astype(np.int64)
    out[out == 255] = np.frombuffer(flat[n:].tobytes(), "<i8")
    return out


def text_blocks(docs: DataFrame, size: int, *keep: str) -> DataFrame:
    """A stored table of block, part, one array for each kept column, texts and offsets; ``docs`` has those columns and text. The
    parts of a block are rows of about PART_BYTES of text or of one longer text, as whole blocks would be large values."""
    lists = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, held, waiting, rows, texts = TaskContext.get().partitionId() << 33, 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, part, held, waiting, rows, texts
            of = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in texts]))]).astype(np.int64)
            out = [pa.array([number], pa.int64()), pa.array([part], pa.int32())]
            for i in range(len(keep)):
                whole = pa.concat_arrays([r[i] for r in rows])
                out.append(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole))
            out += [pa.array([packed_bytes(np.concatenate([x for x, _ in texts]))], pa.binary()), pa.array([packed_bytes(of)], pa.binary())]
            held, waiting, part, rows, texts = held + waiting, 0, part + 1, [], []
            if held >= size:
                number, part, held = number + 1, 0, 0
            return pa.RecordBatch.from_arrays(out, ["block", "part", *keep, "texts", "offsets"])

        for b in batches:
            flat, offsets = buffers(column(b, "text"))
            i = 0
            while i < len(b):
                j = min(len(b), max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART_BYTES - waiting, side="right")) - 1))
                texts.append((flat[offsets[i] : offsets[j]], offsets[i : j + 1]))
                rows.append([column(b, c).slice(i, j - i) for c in keep])
                waiting += int(offsets[j] - offsets[i])
                i = j
                if waiting >= PART_BYTES or i < len(b):
                    yield flush()
        if rows:
            yield flush()

    kinds = ", ".join(f"`{f.name}` ARRAY<{f.dataType.simpleString()}>" for f in lists)
    return stored(docs.select(*keep, "text").mapInArrow(run, f"block BIGINT, part INT, {kinds}, texts BINARY, offsets BINARY"))


def block_of(table: pa.Table) -> tuple[int, pa.Table, np.ndarray, np.ndarray]:
    """Of the parts of one block: its number, the parts in order, and the flat bytes and offsets of its texts."""
    table = table.take(np.argsort(table.column("part").to_numpy()))
    texts = [unpacked(x.as_py(), np.uint8) for x in table.column("texts")]
    sizes = [np.diff(unpacked(x.as_py(), np.int64)) for x in table.column("offsets")]
    return table.column("block")[0].as_py(), table, np.concatenate(texts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def listed(table: pa.Table, name: str) -> pa.Array:
    """The values of a kept column, in order."""
    return pa.concat_arrays([x.flatten() for x in table.column(name).chunks])


def text_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(flat))


def by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets in use, each with the positions of its entries in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def buckets_for(size: int, each: int) -> int:
    return max(1, ceil(size / each))


def dealt(rows: DataFrame, key: str, groups: int) -> DataFrame:
    """Rows dealt by a key into a number of partitions that follows the number of its values."""
    base = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(base, groups), key)


def grouped(rows: DataFrame, key: str, groups: int, run: Callable, shape: str) -> DataFrame:
    return dealt(rows, key, groups).groupBy(key).applyInArrow(run, shape)


def block_size(spark: SparkSession, size: int, most: int) -> int:
    """Bytes of a block: ``most``, or less where that would leave cores without one. It changes no result."""
    return max(1 << 18, min(most, ceil(size / (3 * spark.sparkContext.defaultParallelism))))


def size_of(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; one narrow aggregate, used to size blocks and buckets by the data."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
