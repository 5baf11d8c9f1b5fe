"""Tables, shared folders and small aggregates used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH bytes, where the session hasn't a setting of its own: Python workers and the off-heap buffers of an
    executor hold a few batches at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":  # Spark's default
        spark.conf.set(key, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A table; with ``spread``, documents that are read in fewer partitions than there are cores, as from a single small file, are
    dealt over them."""
    bounded(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if spread and name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a new local one, in local mode only: on a
    cluster each executor would write to its own disk."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_sifter_folder", None) or tempfile.mkdtemp(prefix="sifter-")
        spark.sparkContext._sifter_folder = base
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: its lineage ends there, so a lost
    executor costs no recomputation, and every later pass sees the same rows. Each application has a folder of its own, so what
    lazy results still need can be deleted when it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sifter-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sifter_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote, when nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_sifter_path", None)
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def released(spark: SparkSession) -> None:
    """Lets the driver notice at once which shuffles nothing refers to any more, so that executors delete their files; otherwise that
    waits for its next collection of garbage. The last query run is still held, so a small one comes first."""
    spark.range(1).count()
    spark._jvm.System.gc()


def remainder_of_crc(col: str, mod: int) -> Column:
    """crc32 of a column's text, modulo ``mod``; a null column gives 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(0))
