"""Exact Jaccard self-join of word n-gram sets, by prefix filtering and set-relation skipping.

1. Texts stand in blocks. Each block sends the distinct shingles of half of the hash space, as
   packed arrays of 32-bit prints, to buckets; buckets add up document frequencies and answer in the order they were asked in.
   A print stands for its shingle only in the order below, where any function of the shingle is sound.
2. Shingles are ordered by frequency. A document whose unshared shingles fill its prefix (n - ceil(t*n) + 1) can't be
   linked and drops out, which is nearly every document that has no near copy; the others keep the shared rest of the
   prefix as candidate keys. Documents with equal sets become one set with a multiplicity.
3. Sets that share a key belong to one neighbourhood (connected components over keys). A neighbourhood is joined in one
   task, or, beyond ``CHUNK`` sets, in one task for each pair of chunks, so that no group is held in one place.
4. Within a task, index lists are cut into blocks by position in order of set size, and blocks that the size bound
   excludes are skipped. The overlaps of a set with all others are derived from those computed for the most
   similar earlier set: only lists of shingles in which the two differ are read, which makes groups of near copies
   cost their differences instead of their sizes. Overlaps are exact counts, so no pair needs a second check.
5. Links join sets into classes; a class is named by its least doc_id.

Sets are compared by 64-bit shingle hashes and named by 128 bits. Copies are counted by set; joins by set, shingle or class spread
hot keys. Everything runs over all rows, and no list or group is cut short.

Cases: a text with fewer words than n is one shingle; without words, null or empty it has none and links with nothing; repeated
rows are copies like any others; a null doc_id takes part but never names a class unless it has no other; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import gram_hashes, hash_words, mix
from ._blocks import block_of, block_size, buckets_for, dealt, grouped, listed, packed_bytes, packed_counts, size_of, text_array, text_blocks, unpacked, unpacked_counts
from ._graph import components, spread_join
from ._io import dropped, released, stored

#: Text of a block, and text whose shingles fill a bucket.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20
#: Sets of one neighbourhood that a task holds on either side.
CHUNK = 2048
#: Positions (ranks by size) in a block of an index list.
SKIP = 256
_OTHER = np.uint64(0x6A09_E667_F3BC_C908)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j, words, of in hash_words(texts):
        grams, at = gram_hashes(words, of, k)
        for d in range(j - i):
            own = np.sort(grams[at[d] : at[d + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def needed(n: int, percent: int) -> int:
    """The least overlap with which a set of n shingles can reach the threshold."""
    return -(-percent * n // 100)


def _prints(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit print in one number, for the half of the hash space that is counted."""
    v = hashes >> np.uint64(1)
    return (v >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | v & np.uint64(0xFFFFFFFF)


def _even(hashes: np.ndarray) -> np.ndarray:
    return hashes[hashes & np.uint64(1) == 0]


def _block_prints(k: int, buckets: int):
    """The distinct prints of each block with the number of its documents that have them, by bucket."""

    def run(table: pa.Table) -> pa.Table:
        block, _, *texts = block_of(table)
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_prints(_even(s), buckets) for s in shingle_sets(text_array(*texts), k))]), return_counts=True)
        cut = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        used = np.flatnonzero(np.diff(cut)).tolist()
        return pa.table({
            "block": pa.array([block] * len(used), pa.int64()), "bucket": pa.array(used, pa.int64()), "n": pa.array([int(cut[b + 1] - cut[b]) for b in used], pa.int64()),
            "prints": pa.array([packed_bytes((keys[cut[b] : cut[b + 1]] & np.uint64(0xFFFFFFFF)).astype("<u4")) for b in used], pa.binary()), "counts": pa.array([packed_counts(counts[cut[b] : cut[b + 1]]) for b in used], pa.binary()),
        })

    return run


def _print_totals(table: pa.Table) -> pa.Table:
    """Of one bucket: for every block, the document frequencies of its prints, in their order."""
    rows = table.to_pylist()
    prints = [unpacked(r["prints"], np.uint32) for r in rows]
    keys, at = np.unique(np.concatenate(prints), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpacked_counts(r["counts"], r["n"]) for r in rows]), len(keys)).astype(np.int64)
    parts = np.split(total[at], np.cumsum([len(x) for x in prints])[:-1])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"), "counts": pa.array([packed_counts(x) for x in parts], pa.binary())})


def _set_key(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    n = np.uint64(len(own))
    return np.array([mix(own).sum(dtype=np.uint64) ^ n, mix(own ^ _OTHER).sum(dtype=np.uint64) + n], "<u8").tobytes()


def _block_sets(k: int, percent: int, buckets: int):
    names = ["doc_id", "n", "key", "shared", "keys", "hashes"]

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        _, block, *texts = block_of(block)
        sets = list(shingle_sets(text_array(*texts), k))
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_prints(_even(s), buckets) for s in sets)]))
        often = np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(r["counts"], r["n"]) for r in sorted(told.to_pylist(), key=lambda r: r["bucket"]))])
        size, key, linked, keys, hashes, seen = [], [], [], [], [], set()
        for own in sets:
            n = len(own)
            size.append(n)
            key.append(_set_key(own) if n else None)
            even = _even(own)
            times = often[np.searchsorted(known, _prints(even, buckets))]
            common = times >= 2
            prefix = n - needed(n, percent) + 1
            alone = len(even) - int(common.sum())
            linked.append(n > 0 and alone < prefix)
            if not linked[-1] or key[-1] in seen:  # a copy within the block needs its key only
                keys.append(None)
                hashes.append(None)
                continue
            seen.add(key[-1])
            rest = even[common][np.lexsort((even[common], times[common]))][: prefix - alone]
            if len(rest) < prefix - alone:
                rest = np.concatenate([rest, own[own & np.uint64(1) == 1][: prefix - alone - len(rest)]])
            keys.append(rest.astype(np.int64))
            hashes.append(own.tobytes())
        arrays = [listed(block, "doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(linked, pa.bool_()), pa.array(keys, pa.list_(pa.int64())), pa.array(hashes, pa.binary())]
        return pa.Table.from_arrays(arrays, names)

    return run


class _Index:
    """Inverted lists over sets in order of size, each cut into blocks of SKIP positions."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        self.vocabulary, at = np.unique(flat, return_inverse=True)
        rank = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.blocks = -(-len(sets) // SKIP)
        order = np.lexsort((rank, at))
        self.ranks = rank[order]
        cell = at * self.blocks + rank // SKIP
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(self.vocabulary) * self.blocks))])
        self.tokens = np.split(at, np.cumsum([len(s) for s in sets])[:-1])
        self.count = len(sets)

    def overlaps(self, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the tokens each set has, exact for ranks in [low, high); other blocks are skipped."""
        first, last = low // SKIP, -(-high // SKIP)
        begin, end = self.cuts[tokens * self.blocks + first], self.cuts[tokens * self.blocks + last]
        size = end - begin
        if not size.sum():
            return np.zeros(self.count, np.int64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        return np.bincount(self.ranks[at], minlength=self.count)


def join_sets(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later ones (by size) that it links with. side: with two sides, only pairs across count."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    index, size, side = _Index([sets[i] for i in order]), np.array([len(sets[i]) for i in order]), side[order]
    order, both = np.array(order), len(set(side.tolist())) > 1
    high = np.searchsorted(size, size * 100 // percent, side="right")
    found: list[np.ndarray] = []  # overlaps of each set so far, valid from its own rank to its high
    best, like = np.zeros(len(sets), np.int64), np.full(len(sets), -1)
    for a in range(len(sets)):
        own, row = index.tokens[a], None
        if like[a] >= 0:
            other = index.tokens[like[a]]
            more, less = np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)
            if 2 * (len(more) + len(less)) < len(own):
                top = min(high[like[a]], high[a])
                row = found[like[a]] + index.overlaps(more, a, top) - index.overlaps(less, a, top)
                if top < high[a]:
                    row[top:] = index.overlaps(own, top, high[a])[top:]
        if row is None:
            row = index.overlaps(own, a, high[a])
        found.append(row.astype(np.int32))
        window = slice(a + 1, high[a])
        over = row[window]
        nearer = over > best[window]
        best[window][nearer], like[window][nearer] = over[nearer], a
        hit = 100 * over >= percent * (size[a] + size[window] - over)
        if both:
            hit &= side[window] != side[a]
        yield int(order[a]), order[window][hit]


def _join_group(percent: int):
    def run(table: pa.Table) -> pa.Table:
        label, key = table.column("label").to_pylist(), table.column("key").to_pylist()
        part, copies = (table.column(c).to_numpy() for c in ("part", "copies"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        one = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        parent, links = list(range(len(sets))), np.zeros(len(sets), np.int64)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        groups: dict[bytes, list[int]] = {}
        for i, x in enumerate(label):
            groups.setdefault(x, []).append(i)
        for own in groups.values():
            if len(own) < 2:
                continue
            group = np.array(own)
            for a, others in join_sets([sets[i] for i in own], np.zeros(len(own)) if one else part[group], percent):
                i = own[a]
                for j in group[others].tolist():
                    links[i] += copies[j]
                    links[j] += copies[i]
                    x, y = root(i), root(j)
                    if x != y:
                        x, y = (x, y) if key[x] < key[y] else (y, x)
                        parent[y] = x
        return pa.table({"key": pa.array(key, pa.binary()), "least": pa.array([key[root(i)] for i in range(len(sets))], pa.binary()), "links": links})

    return run


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows linked with) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = size_of(docs)
    each = block_size(docs.sparkSession, size, BLOCK_BYTES)
    groups, buckets = buckets_for(size, each), buckets_for(size, BUCKET_BYTES)
    blocks = text_blocks(docs, each, "doc_id")
    texts = dealt(blocks, "block", groups)
    prints = texts.select("block", "part", "texts", "offsets").groupBy("block").applyInArrow(_block_prints(k, buckets), "block BIGINT, bucket BIGINT, n BIGINT, prints BINARY, counts BINARY")
    told = grouped(prints, "bucket", buckets, _print_totals, "block BIGINT, bucket BIGINT, n BIGINT, counts BINARY")
    all_sets = texts.groupBy("block").cogroup(dealt(told, "block", groups).groupBy("block")).applyInArrow(_block_sets(k, percent, buckets), f"doc_id {kind}, n BIGINT, key BINARY, shared BOOLEAN, keys ARRAY<BIGINT>, hashes BINARY")
    rows = stored(all_sets)
    dropped(blocks)
    released(docs.sparkSession)

    # By set, not by row: the copies of a text are counted where they are.
    copies = stored(rows.where("shared").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")))
    sets = stored(rows.where("hashes IS NOT NULL").dropDuplicates(["key"]).select("key", "keys", "hashes"))
    entries = sets.select("key", F.explode("keys").alias("token"))
    shared = entries.groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("token", "least")
    near = components(spread_join(entries, shared, "token").select(F.col("key").alias("a"), F.col("least").alias("b")))
    labels = stored(near.select(F.col("node").alias("key"), "label").unionByName(near.select(F.col("label").alias("key"), "label").distinct()))

    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    most = sizes.agg(F.max("parts")).first()[0] or 1
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    info = spread_join(labels, sizes, "label").join(copies.select("key", "copies"), "key")  # a row a set, without its hashes
    placed = (
        sets.select("key", "hashes").join(info, "key").withColumn("part", part).withColumn("other", other)
        .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
        .withColumn("task", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("label"), F.lit(4 * buckets))).otherwise(F.xxhash64("label")))
        .withColumn("one", F.when(F.col("parts") > 1, F.col("label")))
    )
    joined = stored(placed.groupBy("one", "task", "low", "high").applyInArrow(_join_group(percent), "key BINARY, least BINARY, links BIGINT"))
    links = joined.groupBy("key").agg(F.sum("links").alias("links"), F.min("least").alias("least"))
    if most > 1:  # classes that reach over several tasks
        classes = components(joined.select(F.col("key").alias("a"), F.col("least").alias("b")))
        links = links.drop("least").join(classes.select(F.col("node").alias("key"), F.col("label").alias("least")), "key", "left")
    of_set = stored(copies.join(links, "key", "left").select("key", "first", F.coalesce("least", "key").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    for table in (sets, labels, joined, copies):  # of_set has what they were for
        dropped(table)
    released(docs.sparkSession)
    named = spread_join(of_set, of_set.groupBy("least").agg(F.min("first").alias("component_id")), "least").select("key", "component_id", "n_links")
    linked = spread_join(rows.where("shared").select("doc_id", "n", "key"), named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = rows.where("NOT shared").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return alone.unionByName(linked)
