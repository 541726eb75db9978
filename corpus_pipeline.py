"""From documents to packed sequences: quality rules, near-copies, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what each returns to the
shared folder and hands it on, so a lost executor costs one stage's tasks at most; what a stage was given is deleted
once its own result is written.

Every stage takes null, empty and very long texts, rows without doc_id or with one that repeats, further columns of any
name and an empty table (which gives an empty table); what each does with them its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideframe.llm import mixing, near_copies, packing, quality_rules, secret_scan
from tideframe.llm.common import discard, documents, labels, written
from tideframe.llm.queries import WEIGHTS, labelled_languages


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the rest go.

    Each row is judged by its own text: null and empty texts have under ten words and go, repeated rows share a verdict, rows
    without doc_id are judged like others.
    """
    return quality_rules.keep_good(docs, labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the least doc_id.

    Null and empty texts are one group. Of rows that repeat doc_id and text one stays, of a doc_id's different texts each by its own
    group; rows without doc_id stay only where their group has no other.
    """
    return near_copies.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked in the text. Null texts stay null; repeated rows are masked alike."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, so that expected tokens of the languages meet the weights.

    Rows of equal doc_id and text are taken equally often, rows without doc_id once. Without labelled rows all are taken once.
    """
    return mixing.mixed(docs, labelled_languages(docs, labels(spark, sf_dir)), WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; null and empty texts are the end id alone, every row is packed on its own."""
    return packing.pack(docs)


STAGES = [("quality_rules", good), ("near_dedup", distinct), ("secret_scan", without_secrets), ("mixing", mixed), ("packing", packed)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that the stages keep. The table that packing reads stays, as its result is not computed yet."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
