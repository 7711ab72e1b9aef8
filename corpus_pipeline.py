"""The corpus pipeline: toxicity, near-dedup, substring dedup, mixing, tokens.

Every stage takes all that the one before it kept. All but the last return the columns of documents; the last
adds the token ids of each text, and the digest of what they decode to, and leaves the rows as they are.

In every stage null and empty texts are texts without words, rows that repeat another are treated like it, texts of any
length are read whole, other columns pass through whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import op1_mixing, op4_suffix_array, op7_byte_bpe, op8_simhash, op10_toxicity, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. Null and empty texts are scored as texts without words; a row given twice has one
    score. Without labels of both kinds all texts score alike. An unbroken text of megabytes takes time in proportion."""
    return op10_toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of linked fingerprints. Texts without words (null ones too) have
    the fingerprint zero and are one group; of rows that repeat doc_id and text one stays."""
    return op8_simhash.dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes under 200-byte strings that stand elsewhere too. No row goes, though a text may
    become empty; null texts stay null; rows that repeat one are copies of each other like any others. What is left of a
    character that a span cuts goes too."""
    return op4_suffix_array.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics come near their targets. Null sources, languages and topics
    are values of their own; texts without words weigh nothing and stay; rows equal in id and text share their fate."""
    return op1_mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, in a column ids, and the SHA-256 of the bytes they decode to, in decoded_sha256.
    A null or empty text has no ids. Columns of these names are replaced."""
    return op7_byte_bpe.encode(docs, decoded="decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: No stage can be said in SQL as a whole: tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.table(docs, name)
    return docs
