"""Decision summaries and corpus evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.paths import dotted_extension, extension, keywords
from ..functions.text import blank, percent, units

DECISION = (
    "path STRING, ext STRING, filename STRING, nameKeywords ARRAY<STRING>, size BIGINT, type STRING, confidence DOUBLE, signals ARRAY<STRING>, tool STRING, ts BIGINT"
)


def decisions(classified: DataFrame) -> DataFrame:
    """Decision records from (path, text, tool, ts, result): result as classify() gives it."""
    name = F.regexp_extract("path", r"([^/]*)/*$", 1)
    return classified.select(
        "path", F.coalesce(dotted_extension(F.col("path")), F.lit("")).alias("ext"), F.coalesce(name, F.lit("")).alias("filename"), keywords(F.lower(F.coalesce(name, F.lit(""))), P.DECISION_KEYWORDS).alias("nameKeywords"),
        units(F.col("text")).cast("long").alias("size"), F.col("result.type").alias("type"), F.col("result.confidence").alias("confidence"), F.col("result.signals").alias("signals"), "tool", "ts",
    )


def read_decisions(lines: DataFrame) -> DataFrame:
    """Parsed records of a JSON-lines table with a column value; malformed and empty lines drop out."""
    parsed = lines.where(F.length("value") > 0).select(F.from_json("value", DECISION).alias("r"))
    return parsed.where(F.col("r.type").isNotNull()).select("r.*")


def line_total(lines: DataFrame) -> DataFrame:
    """One row: the lines of a decision log that aren't empty, malformed ones among them, and the records that can be read."""
    full = lines.where(F.length("value") > 0)
    return full.agg(F.count("*").alias("total"), F.count(F.from_json("value", DECISION)["type"]).alias("records"))


def by_extension(rows: DataFrame) -> DataFrame:
    ext = F.when(F.coalesce(F.col("ext"), F.lit("")) == "", "(none)").otherwise(F.col("ext"))
    return rows.groupBy(ext.alias("ext"), "type").agg(F.count("*").alias("n"))


def by_keywords(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("nameKeywords") > 0).groupBy(F.concat_ws(",", "nameKeywords").alias("keywords"), "type").agg(F.count("*").alias("n"))


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def low_confidence(rows: DataFrame, least: float = 0.6, limit: int = 30) -> DataFrame:
    """The first records, by time, that were decided with little confidence."""
    return rows.where(F.col("confidence") < least).orderBy("ts", "path", "size").limit(limit)


def bucket(path: Column, text: Column, binary: Column) -> Column:
    """What a corpus file is expected to be: binary, skip (under 50 units), observe, prose-candidate or structured."""
    ext = extension(path)
    return (
        F.when(binary, "binary").when(units(text) < 50, "skip").when(ext.isin("md", "html", "htm"), "observe").when(ext.isin("txt", "rst"), "prose-candidate").otherwise("structured")
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of (bucket, type)."""
    return rows.groupBy("bucket", "type").agg(F.count("*").alias("n"))


def observed(rows: DataFrame) -> DataFrame:
    """How files of the loose bucket (Markdown, HTML) are called: counts of (ext, type), by extension and then the commonest first."""
    own = rows.where(F.col("bucket") == "observe")
    return own.groupBy(extension(F.col("path")).alias("ext"), "type").agg(F.count("*").alias("n")).orderBy("ext", F.desc("n"), "type")


def samples(rows: DataFrame, wrong: Column, limit: int = 20) -> DataFrame:
    """The first rows, by path and place in it, that a condition holds for, with 80 characters of their text."""
    return rows.where(wrong).orderBy("path", "n").limit(limit).select("path", "n", F.col("r.type").alias("type"), F.col("r.confidence").alias("confidence"), F.col("r.signals").alias("signals"), F.substring("text", 1, 80).alias("snippet"))


def commonest(rows: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """Counts by key, the greatest first, then by key."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return out if limit is None else out.limit(limit)


def ordered_by_key(rows: DataFrame) -> DataFrame:
    """Counts of (keywords, type) in the order of the keywords."""
    return by_keywords(rows).orderBy("keywords", "type")


def evaluation(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """The evaluation report as rows (section, key, type, n, share): buckets, the structured bucket against its types, the observe bucket by
    extension, and Markdown blocks taken for structured. files: path, bucket, type; blocks: type."""
    row = lambda df, section, key, kind, share: df.select(F.lit(section).alias("section"), key.alias("key"), kind.alias("type"), F.col("n"), share.alias("share"))
    none, total = F.lit(None).cast("string"), F.sum("n").over(W.partitionBy("ext"))
    buckets = files.groupBy("bucket").agg(F.count("*").alias("n"))
    strict = files.where("bucket = 'structured'").groupBy("type").agg(F.count("*").alias("n")).withColumn("ext", F.lit("structured"))
    prose = misjudged_prose(blocks)
    return (
        row(buckets, "bucket", F.col("bucket"), none, F.lit(None).cast("double")).unionByName(row(strict, "confusion", F.col("ext"), F.col("type"), percent(F.col("n"), total)))
        .unionByName(row(observed(files), "observe", F.col("ext"), F.col("type"), percent(F.col("n"), total)))
        .unionByName(prose.select(F.lit("prose").alias("section"), F.lit("blocks").alias("key"), F.lit("structured").alias("type"), F.col("wrong").alias("n"), percent(F.col("wrong"), F.col("blocks")).alias("share")))
    )


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON, a line a row."""
    rows.coalesce(1).write.mode("overwrite").json(path)  # a report has few rows


def prose_blocks(markdown: str | None) -> list[str]:
    """Paragraphs of running text: front matter, code, HTML, tables, headings, images and lists part them; blocks of
    under 120 units and what follows an open fence are dropped."""
    out: list[str] = []
    own: list[str] = []
    fenced = front = False
    separators = re.compile(r"    \S|\s*</?[a-zA-Z]|\s*\||#{1,6}\s|!\[|\s*[-*+]\s|\s*$")

    def end() -> None:
        text = "\n".join(own).strip()
        if len(text.encode("utf-16-le")) // 2 >= 120:
            out.append(text)
        own.clear()

    for n, line in enumerate((markdown or "").split("\n")):
        bare = line.strip()
        if front or (n == 0 and bare == "---"):
            front = n == 0 or bare != "---"
        elif bare.startswith(("```", "~~~")):
            end()
            fenced = not fenced
        elif fenced:
            continue
        elif separators.match(line):
            end()
        else:
            own.append(line)
    if not fenced:
        end()
    return out


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def prose_blocks_column(markdown: str | None) -> list[str]:
    """A state machine over lines has no built-in form."""
    return prose_blocks(markdown)


def misjudged_prose(rows: DataFrame) -> DataFrame:
    """Blocks, those taken for structured, and their share, of rows with a column type; zero for no blocks."""
    wrong = F.count_if(F.col("type") == "structured")
    return rows.agg(F.count("*").alias("blocks"), wrong.alias("wrong"), F.coalesce(F.try_divide(wrong.cast("double"), F.count("*")), F.lit(0.0)).alias("rate"))


def measure(rows: DataFrame) -> DataFrame:
    """Totals by class of rows (ext, type, compressed, digested, original_size, compressed_size)."""
    when = lambda c, v: F.when(F.col("compressed"), F.col(c)).otherwise(v)
    return rows.groupBy("ext", "type").agg(
        F.count("*").alias("n"), F.count_if("compressed").alias("compressed"), F.count_if("digested").alias("digested"), F.sum(when("original_size", 0)).alias("original"), F.sum(when("compressed_size", 0)).alias("after"),
        F.count_if(F.col("compressed") & F.col("type").isin("prose", "mixed")).alias("leaks"),
    )


def not_blank(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.where(~blank(F.col(text)))
