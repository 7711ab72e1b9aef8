"""The queries of the ten operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import op1_mixing, op2_additive_quantisation, op10_toxicity, op11_hard_negatives, op12_whitening, op13_warc, op3_lempel_ziv, op4_suffix_array, op5_quality_rules, op6_uniform_shuffle, op7_byte_bpe, op8_simhash, op9_class_lm


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's target weight, its probability and whether it is drawn."""
    return op1_mixing.digest(_documents(spark, sf_dir))


def op2_additive_quantisation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, among all vectors."""
    return op2_additive_quantisation.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_lempel_ziv_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without those of windows of 20 that start earlier too."""
    return op3_lempel_ziv.digest(_documents(spark, sf_dir))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without those of 200-byte strings that start elsewhere too."""
    return op4_suffix_array.digest(_documents(spark, sf_dir))


def op5_quality_rules_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return op5_quality_rules.digest(_documents(spark, sf_dir))


def op6_uniform_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, 40 shards of even counts."""
    return op6_uniform_shuffle.digest(_documents(spark, sf_dir))


def op7_byte_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids, and of the bytes they decode to."""
    return op7_byte_bpe.digest(_documents(spark, sf_dir))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return op8_simhash.digest(_documents(spark, sf_dir))


def op9_class_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based and single-word log-probability of every document."""
    return op9_class_lm.scored(_documents(spark, sf_dir))


def op10_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return op10_toxicity.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_hard_negatives_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector's positives, among all vectors."""
    return op11_hard_negatives.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector."""
    return op12_whitening.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written, rewritten with an offset index, and read back."""
    return op13_warc.digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing_sample": op1_mixing_sample,
    "op2_additive_quantisation_search": op2_additive_quantisation_search,
    "op3_lempel_ziv_dedup": op3_lempel_ziv_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_quality_rules_verdicts": op5_quality_rules_verdicts,
    "op6_uniform_shuffle_shards": op6_uniform_shuffle_shards,
    "op7_byte_bpe_encode": op7_byte_bpe_encode,
    "op8_simhash_groups": op8_simhash_groups,
    "op9_class_lm_scores": op9_class_lm_scores,
    "op10_toxicity_scores": op10_toxicity_scores,
    "op11_hard_negatives": op11_hard_negatives_mined,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_warc_round_trip": op13_warc_round_trip,
}

ORACLE_SQL: dict[str, str] = {"op5_quality_rules_verdicts": op5_quality_rules.sql(), "op13_warc_round_trip": op13_warc.SQL}
