"""Captures derived from the benchmark tables, as DataFrames and as the SQL that makes the same rows in DuckDB."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESC = "\x1b"
#: Tables of texts, which cost far more to look at than to deal.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is read in fewer partitions than there are cores, as a single small file is, is dealt over them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that several reports read, as ingestion would leave it: written when first asked for, then read. It lies in the shared
    folder (spark.checkpoint.dir) or, in local mode without one, in a local one that goes when the process ends."""
    context = spark.sparkContext
    kept = context.__dict__.setdefault("_sifter_tables", {})
    if (sf_dir, name) not in kept:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="sifter-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        path = f"{base}/sifter-{context.applicationId}/{name}-{uuid.uuid4().hex}"
        df = make(spark, sf_dir)
        df.write.parquet(path)
        kept[sf_dir, name] = (path, df.schema)
    path, schema = kept[sf_dir, name]
    return spark.read.schema(schema).parquet(path)


def _joined(line: Column, order: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n")


def logs(spark: SparkSession, sf_dir: str, colour: bool = True, props: bool = False) -> DataFrame:
    """One log per user: key, session, seq (largest event id) and text, a line per event in order."""
    error = F.lit(f"{ESC}[31mERROR{ESC}[0m" if colour else "ERROR")
    parts = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.when(F.col("event_type") == "error", error).otherwise("INFO"), F.lit(" user="), F.col("user_id"), F.lit(" type="), F.col("event_type"), F.lit(" value="), F.floor(F.col("value") * 100).cast("long")]
    line = F.concat(*parts, *([F.lit(" props="), F.col("props")] if props else []))
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    return rows.groupBy("user_id").agg(_joined(line, "event_id").alias("text"), F.max("event_id").alias("seq")).select(
        F.concat(F.lit("log-"), F.col("user_id")).alias("key"), F.lit(None).cast("string").alias("path"), F.lit("Bash").alias("tool"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("session"), "seq", "text"
    )


def logs_sql(colour: bool = True, props: bool = False) -> str:
    error = "chr(27) || '[31mERROR' || chr(27) || '[0m'" if colour else "'ERROR'"
    extra = " || ' props=' || props" if props else ""
    return f"""SELECT 'log-' || user_id AS key, CAST(NULL AS VARCHAR) AS path, 'Bash' AS tool, 'u' || (user_id % 7) AS session, max(event_id) AS seq, string_agg(line, chr(10) ORDER BY event_id) AS text
    FROM (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN {error} ELSE 'INFO' END || ' user=' || user_id || ' type=' || event_type || ' value=' || CAST(floor(value * 100) AS BIGINT){extra} AS line FROM events WHERE user_id IS NOT NULL) GROUP BY user_id"""


def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals of a few dozen documents of one source each: those of 500 ids in a row."""
    rows = table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 500").alias("n")).agg(_joined(F.col("text"), "doc_id").alias("text"), F.max("doc_id").alias("seq"))
    return rows.select(F.concat(F.lit("src-"), F.col("source"), F.lit("-"), F.col("n")).alias("key"), F.lit(None).cast("string").alias("path"), F.lit("Read").alias("tool"), F.col("source").alias("session"), "seq", "text")


LONG_SQL = "SELECT 'src-' || source || '-' || (doc_id // 500) AS key, CAST(NULL AS VARCHAR) AS path, 'Read' AS tool, source AS session, max(doc_id) AS seq, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source, doc_id // 500"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("key"), none.alias("path"), none.alias("tool"), F.col("source").alias("session"), F.col("doc_id").alias("seq"), "text")


DOCUMENTS_SQL = "SELECT 'doc-' || doc_id AS key, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS tool, source AS session, doc_id AS seq, text FROM documents"


def pages(spark: SparkSession, sf_dir: str, with_path: bool = True) -> DataFrame:
    path = F.col("url") if with_path else F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id")).alias("key"), path.alias("path"), F.lit("Read").alias("tool"), F.lit(None).cast("string").alias("session"), F.col("page_id").alias("seq"), F.col("html").alias("text"))


def pages_sql(with_path: bool = True) -> str:
    return f"SELECT 'page-' || page_id AS key, {'url' if with_path else 'CAST(NULL AS VARCHAR)'} AS path, 'Read' AS tool, CAST(NULL AS VARCHAR) AS session, page_id AS seq, html AS text FROM pages"


def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of a user's events as one JSON list."""
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND props IS NOT NULL").groupBy("user_id").agg(_joined(F.col("props"), "event_id").alias("text"), F.max("event_id").alias("seq"))
    none = F.lit(None).cast("string")
    return rows.select(F.concat(F.lit("json-"), F.col("user_id")).alias("key"), none.alias("path"), none.alias("tool"), none.alias("session"), "seq", F.concat(F.lit("["), F.replace("text", F.lit("\n"), F.lit(",")), F.lit("]")).alias("text"))


JSON_SQL = "SELECT 'json-' || user_id AS key, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS tool, CAST(NULL AS VARCHAR) AS session, max(event_id) AS seq, '[' || string_agg(props, ',' ORDER BY event_id) || ']' AS text FROM events WHERE user_id IS NOT NULL AND props IS NOT NULL GROUP BY user_id"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages (with their URL as path) and coloured logs."""
    return documents(spark, sf_dir).unionByName(pages(spark, sf_dir)).unionByName(logs(spark, sf_dir))


CAPTURES_SQL = f"({DOCUMENTS_SQL} UNION ALL {pages_sql()} UNION ALL {logs_sql()})"


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with terminal codes, tabs and trailing spaces put in."""
    text = F.regexp_replace(F.regexp_replace(F.col("text"), " the ", f" {ESC}[32mthe{ESC}[0m\t "), "\n", "  \n")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


NOISY_SQL = "SELECT doc_id, regexp_replace(regexp_replace(text, ' the ', ' ' || chr(27) || '[32mthe' || chr(27) || '[0m' || chr(9) || ' ', 'g'), chr(10), '  ' || chr(10), 'g') AS text FROM documents"
