"""File and log sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import binary
from ..operators.corpus import bucket, line_total, not_blank, read_decisions
from ..operators.diagnosis import EXCLUDED

_CORPUS_EXCLUDED = ("node_modules", ".git", "dist", "build", ".next", ".history")
_MEASURE_EXCLUDED = ("node_modules", ".git")
MEASURED_BYTES = 2 << 20


def walk(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, depth: int | None = None) -> DataFrame:
    """path (below the root), size and content of every file; unreadable ones are skipped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rows = rows.select(F.regexp_replace("path", f"^.*?/*{base}/+", "").alias("path"), F.col("length").alias("size"), "content")
    parts = F.split("path", "/", -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    rows = rows.where(~F.exists(folders, lambda d: d.isin(*excluded)))
    return rows if depth is None else rows.where(F.size(parts) - 1 <= depth)


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """path, text and bucket of the files of a corpus."""
    rows = walk(spark, root, _CORPUS_EXCLUDED).select("path", "size", F.decode("content", "UTF-8").alias("text"))
    return rows.withColumn("bucket", bucket(F.col("path"), F.col("text"), binary(F.col("text"))))


def measured(spark: SparkSession, root: str) -> DataFrame:
    """path, size and text (of the first 2 MiB) of the files that aren't blank."""
    rows = walk(spark, root, _MEASURE_EXCLUDED).select("path", "size", F.decode(F.substring("content", 1, MEASURED_BYTES), "UTF-8").alias("text"))
    return not_blank(rows)


def hook_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """event_id (of the content, so that a replay has the same one) and value, one JSON document per line."""
    rows = (spark.readStream if streaming else spark.read).text(path)
    return rows.where(F.length("value") > 0).select(F.sha2("value", 256).alias("event_id"), "value")


def decision_log(spark: SparkSession, path: str) -> DataFrame:
    return read_decisions(spark.read.text(path))


def decision_total(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a decision log, malformed ones among them, and readable records."""
    return line_total(spark.read.text(path))


def write_decisions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
