"""Language-model scores from a probabilistic suffix tree over words, beside an exact unigram base.

Symbols are lower-cased words and one end for each text. A state of the tree is a context of up to two tokens (words, or the start of
the text) before the next symbol. Its parent is the longest retained suffix, at last the root, whose distribution is the unigram base
(count + 1) / (N + V + 1), with one share left for all words that training hasn't seen. A context is a candidate from ``LEAST``
training occurrences on, a constant, so the tree grows with the corpus. It is retained when its smoothed distribution,
(count + STRENGTH * parent) / (total + STRENGTH), diverges from its parent's by at least ``DIVERGENCE`` nats (Kullback-Leibler,
over all symbols, parents' chances rounded to a quarter of a bit). A token's chance is that of the longest suffix state of
its history, and a text's score is the sum of the logarithms.

No count is ever held in one place. Texts stand in blocks; for each depth, a block sends its distinct contexts with their next
symbols to buckets by hash of the context, buckets add up, test, and answer each block for its own entries. One pass a depth:
words, then pairs, then triples whose first two are a candidate. A context of more than ``HOT`` occurrences is cut into slices by
next symbol, each in a bucket of its own, so that no context fills one. Slices know the context's occurrences and send their shares of
its divergence, in whole units, so that the sum and the test are the same however a context is cut; there is at most one such context
for every ``HOT`` training tokens of a depth. Words are told apart by 64-bit hashes in the base; in the tree contexts by 40 bits and next
symbols by 32 within a bucket.

Cases: a null or empty text is one end token; a null id is treated as remainder 0; with no training rows the base is log10(1/1) for
every token and so is the model; repeated rows count once each; an empty table gives an empty result; columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import hash_words, mix
from ._blocks import block_of, block_size, buckets_for, by_bucket, dealt, grouped, listed, packed_bytes, packed_counts, size_of, text_array, text_blocks, unpacked, unpacked_counts
from ._io import released, stored

LEAST = 2
DIVERGENCE = 0.05
STRENGTH = (100.0, 3.0)
HOT = 1 << 20
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 16 << 20

_END = np.uint64(0x5AFE_C0DE_0000_0001)
_START = np.uint64(0x5AFE_C0DE_0000_0002)
_LOW = np.uint64((1 << 40) - 1)
#: Steps of a rounded chance, and its least power of two.
_STEPS, _FLOOR = 4, 63
#: Units in a nat and in a chance of 1; sums of them stay below 2**53, exact whatever their order.
_UNIT = float(1 << 44)
#: Of a context that is cut into slices: a slice can't tell whether it is retained.
_CUT = 2


class Deal(NamedTuple):
    """Number of buckets, and occurrences from which on a context is cut into slices."""

    buckets: int
    cut: int


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the rank of each, as 32-bit numbers: a block's memory is mostly such ranks."""
    order = np.argsort(values)
    values = values[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
    names, at = values[new], np.empty(len(values), np.int32)
    del values
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return names, at


class Block:
    """The tokens of a block: ``x`` the tokens of all texts in order, ends included, as positions in ``words`` (sorted distinct hashes,
    with start and end), ``before`` the token before each and ``first`` whether a text begins there."""

    def __init__(self, table: pa.Table):
        self.number, self.parts, flat, offsets = block_of(table)
        self.held = listed(self.parts, "held_out").to_numpy(zero_copy_only=False).astype(bool)
        n = len(self.held)
        parts, counts = [], np.zeros(n, np.int64)
        for i, j, hashes, of in hash_words(text_array(flat, offsets)):
            parts.append(hashes)
            counts[i:j] = np.diff(of)
        hashes = np.concatenate([np.zeros(0, np.uint64), *parts])
        last = np.cumsum(counts + 1) - 1
        tokens = np.full(len(hashes) + n, _END)
        inner = np.ones(len(tokens), bool)
        inner[last] = False
        tokens[inner] = hashes
        self.words, at = _ranked(np.concatenate([tokens, [_END, _START]]))
        self.x = at[:-2]
        self.row = np.repeat(np.arange(n, dtype=np.int32), counts + 1)
        self.tokens = counts + 1
        self.first = np.zeros(len(tokens), bool)
        self.first[last - counts] = True
        self.before = np.roll(self.x, 1)
        self.before[self.first] = at[-1]
        self.end = int(at[-2])
        self.train = ~self.held[self.row]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (token before, token) in order, as positions in ``words``, and which of them stands at each place."""
        keys, place = _ranked(self.before.astype(np.int64) * len(self.words) + self.x)
        return (keys // len(self.words)).astype(np.int32), (keys % len(self.words)).astype(np.int32), place


def _asked(context: np.ndarray, total: np.ndarray, symbol: np.ndarray, deal: Deal) -> np.ndarray:
    """The bucket of each (context, next symbol): by the context, or, where it is hot, by a slice of it too."""
    slices = -(-total // deal.cut)
    own = context.copy()
    hot = slices > 1
    own[hot] = mix(context[hot] + symbol[hot] % slices[hot].astype(np.uint64))
    return ((own >> np.uint64(40)) % np.uint64(deal.buckets)).astype(np.int64)


def _message(context: np.ndarray, symbol: np.ndarray, count: np.ndarray, parent: np.ndarray, total: np.ndarray, cut: int) -> tuple[bytes, bytes]:
    """Entries in order of context: the distinct contexts with their numbers of entries, those cut into slices once more in full with
    their occurrences, and by entry print, rounded chance and count."""
    low = context & _LOW
    new = np.concatenate([[True], low[1:] != low[:-1]])
    spots = np.flatnonzero(new)
    size = np.diff(np.append(spots, len(low)))
    hot = total[spots] > cut
    whole = np.concatenate([context[spots][hot].astype("<u8"), total[spots][hot].astype("<u8")]).view(np.uint8)
    heads = np.concatenate([(low[spots] >> np.uint64(8)).astype("<u4").view(np.uint8), (low[spots] & np.uint64(255)).astype(np.uint8), hot.astype(np.uint8), whole])
    prints = (symbol & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8)
    rounded = np.clip(np.rint(-np.log2(parent) * _STEPS), 0, _FLOOR * _STEPS).astype(np.uint8)
    return packed_counts(size), packed_bytes(np.concatenate([heads, prints, rounded])) + b"|" + packed_counts(count)


def _entries(sizes: bytes, contexts: int, body: bytes, n: int) -> tuple[np.ndarray, ...]:
    size = unpacked_counts(sizes, contexts)
    at = _split(body)
    flat = unpacked(body[:at], np.uint8)
    k = 4 * contexts
    low = flat[:k].copy().view("<u4").astype(np.uint64) << np.uint64(8) | flat[k : k + contexts].astype(np.uint64)
    hot = flat[k + contexts : k + 2 * contexts] > 0
    many = 8 * int(hot.sum())
    rest = flat[k + 2 * contexts :]
    whole, occurrences = rest[:many].copy().view("<u8"), rest[many : 2 * many].copy().view("<i8")
    rest = rest[2 * many :]
    prints, rounded = rest[: 4 * n].copy().view("<u4").astype(np.uint64), rest[4 * n :]
    return size, low | hot.astype(np.uint64) << np.uint64(40), hot, whole, occurrences, prints, rounded, unpacked_counts(body[at + 1 :], n)


def _split(body: bytes) -> int:
    """Where the first of two compressed frames ends."""
    import zstandard

    d = zstandard.ZstdDecompressor().decompressobj()
    d.decompress(body)
    return len(body) - len(d.unused_data)


_ASKED = "block BIGINT, bucket BIGINT, contexts BIGINT, n BIGINT, sizes BINARY, body BINARY"
_TOLD = "block BIGINT, depth INT, bucket BIGINT, contexts BIGINT, n BIGINT, kept BINARY, counts BINARY"


def _messages(block: int, context: np.ndarray, total: np.ndarray, symbol: np.ndarray, count: np.ndarray, parent: np.ndarray, deal: Deal) -> pa.RecordBatch:
    out = {k: [] for k in ("bucket", "contexts", "n", "sizes", "body")}
    for b, own, _ in _places(context, total, symbol, deal):
        sizes, body = _message(context[own], symbol[own], count[own], parent[own], total[own], deal.cut)
        low = context[own] & _LOW
        for k, v in zip(out, (b, 1 + int((low[1:] != low[:-1]).sum()), len(own), sizes, body), strict=True):
            out[k].append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([block] * len(out["n"]), pa.int64()), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["block", *out])


def _places(context: np.ndarray, total: np.ndarray, symbol: np.ndarray, deal: Deal) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By bucket: the positions of its entries in order of context and symbol, and those where a new context begins."""
    bucket = _asked(context, total, symbol, deal)
    order = np.lexsort((symbol & np.uint64(0xFFFFFFFF), context & _LOW))
    for b, own in by_bucket(bucket[order], deal.buckets):
        own = order[own]
        low = context[own] & _LOW
        yield b, own, np.concatenate([[True], low[1:] != low[:-1]])


def _retained(n: np.ndarray, gain: np.ndarray, known: np.ndarray, strength: float) -> np.ndarray:
    """Which contexts are retained, by their occurrences, and the divergence and the parents' chances of their symbols in units."""
    share = strength / (n + strength)
    return (n >= LEAST) & (gain / _UNIT + share * np.maximum(0, 1 - known / _UNIT) * np.log(share) >= DIVERGENCE)


def _told(depth: int, strength: float):
    """Of one bucket: the sums of its entries, and which of its contexts are retained, for each block in the order it asked; and, as
    block -1, the contexts that are cut into slices with their occurrences and this bucket's shares of their sums."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        got = [_entries(r["sizes"], r["contexts"], r["body"], r["n"]) for r in rows]
        size, low, hot, whole, occurrences, prints, rounded, count = (np.concatenate(x) for x in zip(*got, strict=True))
        names, of = np.unique(low, return_inverse=True)
        by_entry = np.repeat(of, size)
        keys, at = np.unique(by_entry.astype(np.uint64) << np.uint64(32) | prints, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, count)
        owner = (keys >> np.uint64(32)).astype(np.int64)
        q = np.ones(len(keys))
        q[at] = 2.0 ** (-rounded.astype(np.float64) / _STEPS)
        n = np.bincount(owner, total, len(names))
        big, context = np.zeros(len(names), bool), np.zeros(len(names), np.uint64)
        big[of[hot]], context[of[hot]], n[of[hot]] = True, whole, occurrences
        p = (total + strength * q) / (n + strength)[owner]
        gain, known = (np.bincount(owner, np.rint(x * _UNIT), len(names)) for x in (p * np.log(p / q), q))
        kept = np.where(big, _CUT, _retained(n, gain, known, strength))
        cuts, heads = np.cumsum([r["n"] for r in rows])[:-1], np.cumsum([r["contexts"] for r in rows])[:-1]
        shares = np.concatenate([context[big], *(x[big].astype(np.int64).view(np.uint64) for x in (n, gain, known))])
        return pa.table({
            "block": pa.array([*(r["block"] for r in rows), -1], pa.int64()), "depth": pa.array([depth] * (len(rows) + 1), pa.int32()), "bucket": pa.array([rows[0]["bucket"]] * (len(rows) + 1), pa.int64()),
            "contexts": pa.array([*(r["contexts"] for r in rows), int(big.sum())], pa.int64()), "n": pa.array([*(r["n"] for r in rows), 0], pa.int64()),
            "kept": pa.array([*(packed_bytes(k.astype(np.uint8)) for k in np.split(kept[of], heads)), packed_bytes(shares)], pa.binary()),
            "counts": pa.array([*(packed_counts(t) for t in np.split(total[at], cuts)), b""], pa.binary()),
        })

    return run


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each context that is cut and bucket that has a slice of it."""
    for b in batches:
        for raw in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpacked(raw, np.int64).reshape(4, -1)], ["context", "n", "gain", "known"])


def _cut(told: DataFrame, strength: float, hot: int | None) -> np.ndarray:
    """The contexts cut into slices that are retained, in order."""
    shares = told.where("block = -1 AND contexts > 0").select("kept").mapInArrow(_shares, "context BIGINT, n BIGINT, gain BIGINT, known BIGINT")
    sums = shares.groupBy("context").agg(F.max("n"), F.sum("gain"), F.sum("known")).collect()  # at most one for each HOT training tokens
    context, n, gain, known = np.array(sums, np.int64).reshape(-1, 4).T
    kept = _retained(n, gain, known, strength)
    if hot is not None:
        kept |= n > hot
    return np.sort(context[kept].view(np.uint64))


def _answers(context: np.ndarray, total: np.ndarray, symbol: np.ndarray, told: dict[int, dict], cut: np.ndarray, deal: Deal) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each entry, and whether its context is retained; ``cut`` are the retained ones of those in slices."""
    sums, kept = np.zeros(len(context), np.int64), np.zeros(len(context), np.uint8)
    for b, own, new in _places(context, total, symbol, deal):
        sums[own] = unpacked_counts(told[b]["counts"], len(own))
        kept[own] = unpacked(told[b]["kept"], np.uint8)[np.cumsum(new) - 1]
    hot = np.flatnonzero(kept == _CUT)
    kept[hot] = np.isin(context[hot], cut)
    return sums, kept > 0


class _Scored:
    """A block with what it has been told: chances of its tokens down to some depth. ``cut`` are the retained contexts of those in
    slices, by depth from 1."""

    def __init__(self, block: Block, told: list[dict], cut: list[np.ndarray], deal: Deal):
        self.block, self.deal = block, deal
        by = [{r["bucket"]: r for r in told if r["depth"] == d} for d in range(3)]
        self.count = np.zeros(len(block.words), np.int64)
        for b, own in by_bucket(word_buckets(block.words, deal.buckets), deal.buckets):
            self.count[own] = unpacked_counts(by[0][b]["counts"], len(own))
        self.n, self.v = (told[0]["all_n"], told[0]["all_v"]) if told else (0, 0)
        self.base = (self.count + 1) / (self.n + self.v + 1)
        # The start of a text is followed by something as often as training texts end.
        self.follows = np.where(block.words == _START, self.count[block.end], self.count)
        self.left, self.right, self.place = block.pairs()
        self.used = np.flatnonzero(self.follows[self.left] >= LEAST)
        self.chance, self.pair_sum = self.base[self.right], np.zeros(len(self.left), np.int64)
        if by[1]:
            context, total, symbol, parent = self._pair()
            sums, kept = _answers(context, total, symbol, by[1], cut[0], deal)
            self.pair_sum[self.used] = sums
            self.chance[self.used] = np.where(kept, (sums + STRENGTH[0] * parent) / (total + STRENGTH[0]), parent)
        self.told, self.cut = by[2], cut[1:]

    def _pair(self) -> tuple[np.ndarray, ...]:
        """Of the pairs in use: context, its occurrences, next symbol and its chance in the base."""
        left, right = self.left[self.used], self.right[self.used]
        return mix(self.block.words[left]), self.follows[left], self.block.words[right], self.base[right]

    def pairs(self) -> dict[str, np.ndarray]:
        count = np.bincount(self.place[self.block.train], minlength=len(self.left))[self.used]
        context, total, symbol, parent = self._pair()
        return {"context": context, "total": total, "symbol": symbol, "count": count, "parent": parent}

    def triples(self) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Distinct triples whose first two are a candidate; the places in the block where they stand, and which stands there."""
        b = self.block
        spots = np.flatnonzero(~b.first).astype(np.int32)
        spots = spots[self.pair_sum[self.place[spots - 1]] >= LEAST]
        keys, which = _ranked(self.place[spots - 1].astype(np.int64) * len(b.words) + b.x[spots])
        pair, symbol = (keys // len(b.words)).astype(np.int32), (keys % len(b.words)).astype(np.int32)
        one = np.zeros(len(keys), np.int32)
        one[which] = spots
        context = mix(mix(b.words[self.left[pair]]) * np.uint64(3) + b.words[self.right[pair]])
        count = np.bincount(which[b.train[spots]], minlength=len(keys))
        return {"context": context, "total": self.pair_sum[pair], "symbol": b.words[symbol], "count": count, "parent": self.chance[self.place[one]]}, spots, which

    def logs(self) -> np.ndarray:
        """log10 of the model's chance of every token."""
        out = self.chance[self.place]
        t, spots, which = self.triples()
        if len(spots):
            sums, kept = _answers(t["context"], t["total"], t["symbol"], self.told, self.cut[0], self.deal)
            own = np.where(kept, (sums + STRENGTH[1] * t["parent"]) / (t["total"] + STRENGTH[1]), t["parent"])
            out[spots] = own[which]
        return np.log10(out)


def word_buckets(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _block_words(buckets: int):
    """Distinct words of each block with their counts in its training texts, by bucket."""

    def run(table: pa.Table) -> pa.Table:
        b = Block(table)
        counts = np.bincount(b.x[b.train], minlength=len(b.words))
        parts = list(by_bucket(word_buckets(b.words, buckets), buckets))
        return pa.table({
            "block": pa.array([b.number] * len(parts), pa.int64()), "bucket": pa.array([k for k, _ in parts], pa.int64()), "keys": pa.array([packed_bytes(b.words[own]) for _, own in parts], pa.binary()),
            "counts": pa.array([packed_counts(counts[own]) for _, own in parts], pa.binary()), "n": pa.array([len(own) for _, own in parts], pa.int64()),
        })

    return run


def _word_totals(table: pa.Table) -> pa.Table:
    """Of one bucket: the totals of each block's words; and, as block -1, all tokens and the distinct words counted."""
    rows = table.to_pylist()
    keys = [unpacked(r["keys"], np.uint64) for r in rows]
    names, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, at, np.concatenate([unpacked_counts(r["counts"], r["n"]) for r in rows]))
    counts = [packed_counts(x) for x in np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])]
    n = len(rows) + 1
    return pa.table({
        "block": pa.array([*(r["block"] for r in rows), -1], pa.int64()), "depth": pa.array([0] * n, pa.int32()), "bucket": pa.array([rows[0]["bucket"]] * n, pa.int64()), "contexts": pa.array([int(total.sum())] * n, pa.int64()),
        "n": pa.array([int((total > 0).sum())] * n, pa.int64()), "kept": pa.array([b""] * n, pa.binary()), "counts": pa.array([*counts, b""], pa.binary()),
    })


def score(docs: DataFrame, held_out: Column, hot: int | None = None, cut: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, learning from the rows where
    ``held_out`` doesn't hold.

    Contexts of more than ``cut`` occurrences are counted in slices, which changes no result. Every context is tested, unless ``hot``
    is given: contexts of more than that many occurrences are then retained without the test.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = size_of(docs)
    each = block_size(docs.sparkSession, size, BLOCK_BYTES)
    buckets, groups = buckets_for(size, BUCKET_BYTES), buckets_for(size, each)
    blocks = text_blocks(docs.select("doc_id", "text", held_out.alias("held_out")), each, "doc_id", "held_out")
    texts = dealt(blocks, "block", groups)  # a block a group, so that no batch holds many
    words = texts.groupBy("block").applyInArrow(_block_words(buckets), "block BIGINT, bucket BIGINT, keys BINARY, counts BINARY, n BIGINT")
    totals = stored(grouped(words, "bucket", buckets, _word_totals, _TOLD))
    every = totals.where("block = -1").agg(F.coalesce(F.sum("contexts"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = every
    released(docs.sparkSession)
    deal, kept = Deal(buckets, cut if hot is None else min(cut, hot)), []

    def told_of(known: pa.Table) -> list[dict]:
        return [r | {"all_n": n, "all_v": v} for r in known.to_pylist()]

    def ask(depth: int, cuts: list[np.ndarray]):
        def run(table: pa.Table, known: pa.Table) -> pa.Table:
            s = _Scored(Block(table), told_of(known), cuts, deal)
            number, e = s.block.number, s.pairs() if depth == 1 else s.triples()[0]
            del s  # the entries are all that is needed
            return pa.Table.from_batches([_messages(number, e["context"], e["total"], e["symbol"], e["count"], e["parent"], deal)])

        return run

    told = totals.where("block >= 0")
    for depth in (1, 2):
        asked = texts.groupBy("block").cogroup(dealt(told, "block", groups).groupBy("block")).applyInArrow(ask(depth, [*kept]), _ASKED)
        answers = stored(grouped(asked, "bucket", buckets, _told(depth, STRENGTH[depth - 1]), _TOLD))
        kept.append(_cut(answers, STRENGTH[depth - 1], hot))
        told = told.unionByName(answers.where("block >= 0"))
        released(docs.sparkSession)

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        b = Block(table)
        s = _Scored(b, told_of(known), kept, deal)
        rows = len(b.held)
        sums = lambda x: pa.array(np.bincount(b.row, x, rows))
        return pa.Table.from_arrays([
            listed(b.parts, "doc_id"), pa.array(b.held), pa.array(b.tokens), pa.array(np.bincount(b.row, s.count[b.x] > 0, rows).astype(np.int64)), pa.array(np.full(rows, n, np.int64)),
            sums(np.log10(s.base[b.x])), sums(s.logs()),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    shape = f"doc_id {kind}, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE"
    return texts.groupBy("block").cogroup(dealt(told, "block", groups).groupBy("block")).applyInArrow(run, shape)
