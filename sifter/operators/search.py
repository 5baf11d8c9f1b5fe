"""Keyword search with BM25 over chunks. Statistics are global over all handles; the handle only filters the result.

Texts and queries are folded by one rule: decomposed, marks removed, lower case. Words are runs of letters and digits; scripts without
spaces aren't cut into characters.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import staged

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6


def folded(text: str) -> str:
    """Without marks, lower case; what is left is composed, so that syllables stay whole."""
    plain = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(c for c in plain if unicodedata.category(c)[0] != "M")).lower()


@cache
def folds() -> tuple[str, str]:
    """The characters that fold to one other character, and what they fold to, by the rule above; characters that have a
    decomposition of their own, so a text that is composed or not folds alike."""
    pairs = [(chr(i), folded(chr(i))) for i in range(0x80, sys.maxunicode + 1) if unicodedata.decomposition(chr(i)) and not unicodedata.decomposition(chr(i)).startswith("<") and unicodedata.category(chr(i))[0] == "L"]
    one = [(a, b) for a, b in pairs if len(b) == 1 and a.lower() != b]
    return "".join(a for a, _ in one), "".join(b for _, b in one)


def tokens(text: Column) -> Column:
    """The words of a text, folded."""
    bare = F.regexp_replace(text, r"\p{M}+", "")
    plain = F.lower(F.when(F.octet_length(bare) == F.length(bare), bare).otherwise(F.translate(bare, *folds())))
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def phrases(query: str) -> list[list[str]]:
    """Every word of the query is a phrase of its tokens, and all phrases must match; words without a token drop out."""
    out = []
    for word in query.split():
        own = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in folded(word)).split()
        if own:
            out.append(own)
    return out


def _times(places: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in the text, from the places (place, word) of the wanted words in it."""

    def starts(i: int) -> Column:
        return F.transform(F.filter(places, lambda x: x["word"] == phrase[i]), lambda x: x["place"] - i)

    out = starts(0)
    for i in range(1, len(phrase)):
        out = F.array_intersect(out, starts(i))
    return F.size(out)


def postings(chunks: DataFrame, words: list[str]) -> DataFrame:
    """handle, line_no, dl (words in the chunk) and the places of the wanted words. A chunk is cut into words once and its words are
    counted where it is."""
    word = F.col("word")
    rows = chunks.select("handle", "line_no", F.posexplode_outer(tokens(F.col("content"))).alias("place", "word"))
    return rows.groupBy("handle", "line_no").agg(F.count("word").alias("dl"), F.collect_list(F.when(word.isin(*words), F.struct("place", "word"))).alias("places"))


def search(chunks: DataFrame, query: str, handle: str | None = None, limit: int | None = 10) -> DataFrame:
    """handle, line_no, content and rank (less is better) of the chunks that hold all phrases, best first; all of them without a limit.

    chunks have one row for each handle and line_no. One pass counts; the totals are a single row, and only the best chunks are
    joined with their contents.
    """
    wanted = phrases(query)
    if not wanted:
        return chunks.select("handle", "line_no", "content", F.lit(0.0).alias("rank")).limit(0)
    counted = postings(chunks, sorted({w for p in wanted for w in p})).select("handle", "line_no", "dl", *(_times(F.col("places"), p).alias(f"tf{i}") for i, p in enumerate(wanted)))
    counted = staged(counted.select("handle", "line_no", "dl", F.struct(*(F.col(f"tf{i}") for i in range(len(wanted)))).alias("tf")), _t=F.col("tf")).select("handle", "line_no", "dl", "_t.*")
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(wanted))))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.greatest(F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(IDF_FLOOR))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = F.lit(True)
    for i in range(len(wanted)):
        hit = hit & (F.col(f"tf{i}") > 0)
    found = counted.where(hit if handle is None else hit & (F.col("handle") == handle))
    best = found.join(F.broadcast(totals)).select("handle", "line_no", (-score).alias("rank"))
    if limit is not None:
        best = best.orderBy("rank", "handle", "line_no").limit(limit)
    own = chunks.where(F.col("handle") == handle) if handle is not None else chunks
    out = own.select("handle", "line_no", "content").join(best, ["handle", "line_no"]).select("handle", "line_no", "content", "rank")
    return out if limit is None else out.orderBy("rank", "handle", "line_no")
