"""Reproducible shuffling and sharding by a Feistel permutation of global row numbers, in DataFrame operations only.

Rows are numbered 0..n-1 in the order of their id (then checksum and size, so that ties have one order; rows equal in all
three are interchangeable). A keyed Feistel network permutes the square domain side*side, the least that holds n, and
walks along its cycle until it is back below n, so the numbers are permuted without a table. The permuted number p
then gives shard p % shards and slot p / shards directly: counts differ by one at most, slots have no gap, and
anyone who knows n and the key can compute the place of a row, or invert it.

Numbering takes one range shuffle of a few bytes a row (the text stays where it is) and a count per partition; row
numbers are read from a stored table, so that they hold when an executor is lost.

The walk needs at most side*side - n + 1 steps; ``WALK`` steps are unrolled, which suffices always for n below about
a thousand and with a failure chance below 1e-70 above; should a row be left, the query fails rather than misplacing it.

Cases: a null text counts as empty, a null id sorts first, repeated rows get places of their own, an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import stored

ROUNDS = 6
WALK = 64
KEY = 20240613
_ROW_BITS = 33


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``row_number`` 0..n-1 in the given order, without collecting rows into one partition."""
    base = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    table = stored(rows.repartitionByRange(int(base), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    counts = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("_part", before.alias("_first"))
    index = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return table.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("row_number", F.col("_first") + index).drop("_at", "_part", "_first")


def feistel(x: Column, side: int, key: int) -> Column:
    """A keyed permutation of 0..side*side-1: (left, right) becomes (right, left + hash(right) mod side) each round."""
    right = x % side
    pair = F.struct(((x - right) / side).cast("long").alias("l"), right.alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        added = F.pmod(F.xxhash64(acc["r"], i, F.lit(key)), F.lit(side))
        return F.struct(acc["r"].alias("l"), ((acc["l"] + added) % side).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, turn, lambda p: p["l"] * side + p["r"])


def permuted(x: Column, n: int, key: int = KEY) -> Column:
    """The place of row number ``x`` in a pseudo-random order of n rows, by cycle walking."""
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)
    steps = min(WALK, side * side - n + 1)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        feistel(x, side, key),
        lambda p, _: F.when(p >= n, feistel(p, side, key)).otherwise(p),
        lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("cycle walk has not ended")).cast("long")),
    )


def shard(docs: DataFrame, shards: int = 40, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"))
    table = numbered(rows, "doc_id", "text_crc32", "size")
    n = docs.count()
    place = table.withColumn("_place", permuted(F.col("row_number"), n, key))
    return place.select("doc_id", "size", "text_crc32", "row_number", (F.col("_place") % shards).cast("int").alias("shard"), F.floor(F.col("_place") / shards).alias("slot"))
