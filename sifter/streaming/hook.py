"""Streaming ingestion of tool events: stateless transforms and an idempotent sink."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.rewrite import compressed_leaves, rewritten, tables
from ..sources.files import hook_events


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, now_ms: int, minimum: int = 2048, once: bool = True) -> StreamingQuery:
    """Writes originals, metrics and rewritten events of each micro-batch to a folder of its own below ``target``. A repeated batch overwrites
    its own folder and handles come from the content, so replays leave the same rows."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates(["event_id"]).persist()
        done = compressed_leaves(rows, minimum).persist(StorageLevel.DISK_ONLY)  # judged and compressed once for all tables
        try:
            for name, table in {**tables(rows, now_ms, minimum, done), "rewritten": rewritten(rows, minimum, done)}.items():
                table.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        finally:
            done.unpersist()
            rows.unpersist()

    writer = hook_events(spark, source, streaming=True).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
