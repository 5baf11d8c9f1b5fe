"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, ngram_join, packing, pii, secrets, sharding, suffix_tree, toxicity
from ._io import remainder_of_crc, table


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), remainder_of_crc("doc_id", 7) == 2)


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents", spread=False), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op4_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_of_crc("doc_id", 4) == 2
    prototypes = langid.train(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), prototypes).select("doc_id", "held_out", "lang_pred", "score", "margin")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), k=5, percent=80)


def op6_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096)


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With whether the row's id was held out of the training (crc32 modulo 4 is 2)."""
    docs, held_out = table(spark, sf_dir, "documents"), remainder_of_crc("doc_id", 4) == 2
    out = toxicity.predict(docs, toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels")))
    return out.withColumn("held_out", held_out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_boosting,
        op2_suffix_tree_scores,
        op3_feistel_shards,
        op4_hyperdimensional_language,
        op5_ngram_jaccard,
        op6_anisotropic_neighbours,
        op7_linked_secrets,
        op8_qgram_decontamination,
        op9_bin_slack_packing,
        op10_ordinal_toxicity,
    )
}
