"""Originals, chunks, metrics and the code tables as append-friendly DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import blank, line_range, lines, original_handle, staged, units

ORIGINALS = "handle STRING, content STRING, compressed BOOLEAN, size BIGINT, source STRING, tool STRING, created_at BIGINT"
CHUNKS = "handle STRING, line_no INT, content STRING"
METRICS = (
    "id BIGINT, handle STRING, source STRING, tool STRING, content_type STRING, original_size BIGINT, compressed_size BIGINT, method STRING, retrieved_count BIGINT, session_id STRING, created_at BIGINT"
)
SYMBOLS = "handle STRING, name STRING, kind STRING, start_line INT, end_line INT, body_text STRING, signature STRING, exported BOOLEAN, lang STRING, created_at BIGINT"
REFS = "from_handle STRING, from_symbol STRING, to_handle STRING, to_symbol STRING, ref_type STRING, line INT, resolved BOOLEAN, import_src STRING, created_at BIGINT"


def evolved(df: DataFrame, schema: str) -> DataFrame:
    """An older table read with the present schema: columns it lacks are NULL."""
    empty = df.sparkSession.createDataFrame([], schema)
    return empty.unionByName(df, allowMissingColumns=True).select(*empty.columns)


def as_originals(captures: DataFrame, number: Column) -> DataFrame:
    """captures(content, source, tool, created_at) with handles from a running number."""
    return captures.select(original_handle(number).alias("handle"), "content", F.lit(False).alias("compressed"), units(F.col("content")).cast("long").alias("size"), "source", "tool", "created_at")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key: the upsert of an append log."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(log: DataFrame) -> DataFrame:
    """One row per handle, the latest written (then the greatest content, so that ties have one result)."""
    return latest(log, ["handle"], F.desc("created_at"), F.desc("content"))


def latest_by_source(originals: DataFrame) -> DataFrame:
    """handle and created_at of the latest original of each source; on a tie the greatest handle."""
    newest = F.max(F.struct("created_at", "handle"))
    return originals.where(F.col("source").isNotNull()).groupBy("source").agg(newest.alias("x")).select("source", F.col("x.handle").alias("handle"), F.col("x.created_at").alias("created_at"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` replaced; running it twice changes nothing more."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def chunks(originals: DataFrame, size: int = P.CHUNK_LINES) -> DataFrame:
    """handle, line_no (1-based, of the first line) and content of each stretch of lines that isn't blank."""
    parts = F.col("_lines")
    starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(size))
    cut = F.transform(starts, lambda i: F.struct((i + 1).alias("line_no"), F.array_join(F.slice(parts, i + 1, F.lit(size)), "\n").alias("content")))
    rows = staged(originals.select("handle", "content"), _lines=lines(F.col("content")))
    return rows.select("handle", F.explode(cut).alias("c")).select("handle", "c.line_no", "c.content").where(~blank(F.col("content")))


def original(originals: DataFrame, name: str) -> DataFrame:
    return originals.where(F.col("handle") == name)


def has_symbols(symbols: DataFrame, name: str) -> bool:
    """Whether any symbol of the handle is stored."""
    return not symbols.where(F.col("handle") == name).select(F.lit(1)).limit(1).isEmpty()


def symbols_of(symbols: DataFrame, name: str) -> DataFrame:
    """The symbols of a handle from the top of the file on."""
    return symbols.where(F.col("handle") == name).orderBy("start_line", "end_line", "name")


def get_lines(originals: DataFrame, name: str, start: int, number: int) -> DataFrame:
    """handle and text of a range of lines."""
    return original(originals, name).select("handle", line_range(F.col("content"), F.lit(start), F.lit(number)).alias("text"))


def with_retrievals(metrics: DataFrame, retrievals: DataFrame) -> DataFrame:
    """metrics with retrieved_count from the append-only log retrievals(handle)."""
    times = retrievals.groupBy("handle").agg(F.count("*").alias("_times"))
    return metrics.drop("retrieved_count").join(times, "handle", "left").withColumn("retrieved_count", F.coalesce("_times", F.lit(0))).drop("_times")
