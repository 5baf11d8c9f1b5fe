"""The query API: retrieval by handle, statistics, symbols and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import line_range
from . import codegraph, metrics, search
from .store import chunks, original

_SHAPE = "handle STRING, mode STRING, line_no INT, text STRING, retrieved BOOLEAN"


def retrieve(originals: DataFrame, handle: str | None, query: str | None = None, start: int | None = None, number: int | None = None) -> DataFrame:
    """handle, mode, line_no, text, retrieved. A query comes before a line range, that before the whole text; a text over the
    limit is refused, and a miss isn't counted as retrieved."""
    spark = originals.sparkSession
    one = lambda mode, text, done: spark.createDataFrame([(handle, mode, None, text, done)], _SHAPE)
    if not handle:
        return one("error", "handle is missing", False)
    found = original(originals, handle).limit(1)
    if query and query.strip():
        hits = search.search(chunks(originals), query, handle, 10)
        return hits.select("handle", F.lit("query").alias("mode"), "line_no", F.concat(F.lit("[line "), F.col("line_no").cast("string"), F.lit("] "), F.col("content")).alias("text"), F.lit(True).alias("retrieved"))
    if start is not None and number is not None:
        text = line_range(F.col("content"), F.lit(start), F.lit(number))
        return found.select("handle", F.lit("lines").alias("mode"), F.lit(start).alias("line_no"), text.alias("text"), (F.length(text) > 0).alias("retrieved"))
    big = F.col("size") > P.MAX_FULL_TEXT
    return found.select(
        "handle", F.when(big, "refused").otherwise("full").alias("mode"), F.lit(None).cast("int").alias("line_no"),
        F.when(big, F.concat(F.col("size").cast("string"), F.lit(" characters: ask by query or by lines"))).otherwise(F.col("content")).alias("text"), (~big).alias("retrieved"),
    )


def stats(table: DataFrame) -> DataFrame:
    return metrics.stats_lines(table)


def code_symbol(originals: DataFrame, handle: str, symbol: str | None = None, query: str | None = None) -> DataFrame:
    """Symbols of a file: by name (exact, else alike), by a part of the name, or all."""
    table = codegraph.symbols(codegraph.parsed(originals.where(F.col("handle") == handle)))
    if symbol:
        return codegraph.find_symbol(table, handle, symbol)
    return (table.where(F.col("name").ilike(f"%{query}%")) if query else table).orderBy("start_line", "name")


def code_refs(originals: DataFrame, handle: str, symbol: str, direction: str = "callees", depth: int = 1, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Callees or callers of a symbol. tables: the symbols and edges that ``codegraph.indexed`` keeps; without them every file is parsed
    for the one answer."""
    if tables is None:
        files = codegraph.parsed(originals)
        tables = codegraph.symbols(files), codegraph.edges(files, originals)
    table, refs = tables
    return codegraph.callers(refs, table, originals, handle, symbol) if direction == "callers" else codegraph.callees(refs, table, handle, symbol, depth)


def retrievals(result: DataFrame, handle: str) -> DataFrame:
    """What a tool's answer adds to the log of retrievals: one row with the handle if it has content, none for a miss, a refusal or an
    error."""
    good = result.where("retrieved") if "retrieved" in result.columns else result
    return good.limit(1).select(F.lit(handle).alias("handle"))
