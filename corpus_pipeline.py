"""Corpus preparation: language filter, near-duplicate removal, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns of ``docs``, whatever
they are called. A stage's result is written as Parquet and read back as the next stage's input. All stages keep empty tables
empty, treat rows one by one where ids repeat or are null, and read whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm import decontaminate, langid, ngram_join, packing, secrets
from sifter.llm._io import bounded, dropped, remainder_of_crc, stored, table
from sifter.llm.queries import tokenizer_path


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` begins with."""
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a learnt language: texts without a letter, or further from the nearest language than its own texts
    are, go.

    Null and empty texts have no letter and go; a null id or language only keeps a row from being learnt from; without any labelled row
    nothing is learnt and everything goes; equal rows stay or go together; columns called score or lang_pred are kept as they are.
    """
    bounded(spark)
    prototypes = langid.train(docs, remainder_of_crc("doc_id", 4) != 2)
    found = langid.identify(docs, prototypes, langid.floors(docs, prototypes), prefix=(own := _free(docs, "_language_")))
    return found.where(F.col(own + "lang_pred") != langid.UND).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: the first by id, then by the digest of its text; ids that are null come last.

    Rows are told apart by id and text, so rows equal in both are one document and rows that share an id only are not. Null texts,
    empty ones and those without words are linked with nothing.
    """
    key = F.concat(F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))
    joined, row = ngram_join.ngram_join(docs.select(key.alias("doc_id"), "text"), k=5, percent=80), _free(docs, "_row")
    kept = joined.where("doc_id = component_id").select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, key).join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item was found, row by row. Null and empty texts hold none, and stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by marks; n_chars, where there is such a column, follows the text. All rows stay; null texts stay null, and texts
    without a secret are the same byte for byte."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence of at most 4096 tokens. Null and empty texts are one end token; repeated rows
    are packed one by one."""
    return packing.pack(docs, tokenizer_path(), capacity=4096)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("packing", pack),
]

#: Learnt profiles, alignments and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        dropped(before)  # the stage's own input, if it was a stored one
    return STAGES[-1][1](spark, docs, sf_dir)
