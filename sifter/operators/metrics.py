"""Reports over metric rows. Rows of the retired method are left out, and so are rows without a method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded


def counted(metrics: DataFrame) -> DataFrame:
    return metrics.where(~F.col("method").ilike("%dedup%"))


def _positive(x: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), x)


def summary(metrics: DataFrame) -> DataFrame:
    """One row of totals, also for an empty table."""
    o, c = F.coalesce(F.sum("original_size"), F.lit(0)), F.coalesce(F.sum("compressed_size"), F.lit(0))
    return counted(metrics).agg(
        F.count("*").alias("total"), F.count_if(F.col("compressed_size") < F.col("original_size")).alias("compressed"), o.alias("total_original"), c.alias("total_compressed"),
        _positive(o - c).alias("saved"), F.when(o > 0, _positive(o - c) / o).otherwise(0.0).alias("saved_ratio"), F.coalesce(F.sum("retrieved_count"), F.lit(0)).alias("retrieved"),
    )


def by_type(metrics: DataFrame) -> DataFrame:
    return counted(metrics).groupBy("content_type").agg(F.count("*").alias("n"), F.sum(F.col("original_size") - F.col("compressed_size")).alias("saved"))


def by_session(metrics: DataFrame, limit: int = 5) -> DataFrame:
    """The sessions last active; rows without one are a session of their own."""
    rows = counted(metrics).groupBy("session_id").agg(
        F.count("*").alias("n"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed"), F.max("created_at").alias("last_at")
    )
    return rows.withColumn("saved", _positive(F.col("original") - F.col("compressed"))).orderBy(F.desc("last_at"), F.asc_nulls_first("session_id")).limit(limit)


def recent(metrics: DataFrame, limit: int = 30) -> DataFrame:
    o, c = F.col("original_size"), F.col("compressed_size")
    pct = F.when(o > 0, rounded((1 - c / o) * 100)).otherwise(0)
    return counted(metrics).orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select(
        "id", "tool", "content_type", "original_size", "compressed_size", _positive(o - c).alias("saved"), pct.cast("long").alias("saved_pct"), "method", "retrieved_count", "session_id", "created_at"
    )


def stats_lines(metrics: DataFrame) -> DataFrame:
    """part, n, line: the report as numbered text lines."""
    s = summary(metrics).select(
        F.lit(1).alias("part"), F.lit(0).alias("n"),
        F.concat_ws(" ", F.lit("records"), F.col("total"), F.lit("compressed"), F.col("compressed"), F.lit("saved"), F.col("saved"), F.lit("of"), F.col("total_original"), F.lit("retrieved"), F.col("retrieved")).alias("line"),
    )
    cell = lambda c, width: F.lpad(F.col(c).cast("string"), width, " ")
    r = recent(metrics).select(
        F.lit(2).alias("part"), F.col("id").cast("int").alias("n"),
        F.concat_ws(" ", F.rpad(F.coalesce("tool", F.lit("?")), 5, " "), F.rpad("content_type", 10, " "), cell("original_size", 6), cell("compressed_size", 6), F.concat(cell("saved_pct", 4), F.lit("%"))).alias("line"),
    )
    t = by_type(metrics).select(F.lit(3).alias("part"), F.lit(0).alias("n"), F.concat_ws(" ", "content_type", "n", "saved").alias("line"))
    x = by_session(metrics).select(F.lit(4).alias("part"), F.lit(0).alias("n"), F.concat_ws(" ", F.coalesce(F.substring("session_id", 1, 8), F.lit("(unknown)")), "n", "saved").alias("line"))
    return s.unionByName(r).unionByName(t).unionByName(x)
