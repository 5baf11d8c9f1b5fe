"""Joins and connected components of tables whose keys may be hot, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import dropped, stored

#: A key with more than this many rows, and more than one in SHARE of all, is hot; so at most SHARE keys are.
ROWS, SHARE = 1024, 4096


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key. The rows of hot keys stay where they are and meet the
    at most SHARE rows of ``right`` that belong to them by broadcast; all others are dealt by key."""
    n = left.count()
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(ROWS, n // SHARE)).select(key)
    keys = [r[0] for r in hot.collect()]  # at most SHARE keys
    if not keys:
        return left.join(right, key)
    hot = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in keys], left.select(key).schema))
    few = right.join(hot, key, "left_semi")
    return left.join(hot, key, "left_anti").join(right, key).unionByName(left.join(F.broadcast(few), key))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that isn't the least of its component; label is the least.

    edges: columns a and b. Large-star and small-star rounds alternate until no edge changes; each round is
    stored, so a lost executor repeats one round at most, and the round before is deleted. Rounds grow with the logarithm of
    the largest component. The centre of a star is a hot key, so both joins spread those.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(spread_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.distinct())
        dropped(now)
        dropped(large)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
