"""The registered queries of the training-data operators: each applies its operator to its whole table.

SQL cannot express most of them (tokenizer files, fitted models, alignment, guess costs, file round trips, hash rings);
tests/llm holds those against brute-force versions, exact round trips and held-out labels instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import chunks, histogram, mixing, near_copies, oracles, packing, prefix_trie, quality_fm, quality_rules, secret_scan, sharding, spelling, token_files, toxicity
from tideframe.llm.common import conversations, documents, labels

#: Shares of the languages, the domains that the labelled table knows, in the mix.
WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def labelled_languages(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, text, domain of the documents in the labelled table: their language is taken as known.

    A doc_id that is null or that labels lack labels nothing; one that documents repeat labels each of its rows; a null language
    labels nothing. No labels give no rows.
    """
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("domain")).join(known, "doc_id")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.compare_with_edits(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mix(docs, labelled_languages(docs, labels(spark, sf_dir)), WEIGHTS)


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(conversations(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_quality_fm, op3_toxicity, op4_fingerprints, op5_mixing, op6_near_copies, op7_token_counts, op8_quality_rules, op9_token_files, op10_secrets,
        op11_sharding, op12_prefix_trie, op13_spelling,
    )
}
ORACLE_SQL = {"op12_prefix_trie": oracles.OP12, "op13_spelling": oracles.OP13}
