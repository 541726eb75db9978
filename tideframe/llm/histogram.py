"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Documents are aggregated by their number of ids, so all that follows works on one row for each distinct
length. Suffix sums are taken in two levels (within blocks of lengths, then over blocks), so no task
sees more than a block of lengths or one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm import tokens
from tideframe.llm.common import keyed_text, written

TOKENIZER, BLOCK = "byte_bpe_50k.json", 1024


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens of each row; null text: 0. No row is dropped."""
    path = path or tokens.path_of(TOKENIZER)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.tokenizer(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                got = t.encode(batch.slice(k, 200).column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // t.dtype.itemsize for x in got], pa.int64())], names=["n_tokens"])

    return keyed_text(docs).select("text").mapInArrow(of, "n_tokens long")


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each encoded length that occurs (none for an empty table).

    n_tokens, n_docs, and over the documents of this length or longer: docs_from, tokens_from; and with
    n_tokens as the context limit: truncated_tokens, the total of min(length, limit) over all documents.
    """
    rows = written(lengths(docs, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    rows = rows.withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "tokens": F.col("n_tokens") * F.col("n_docs")})
    over_blocks = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = later.select("block", *(F.coalesce(F.sum(c).over(over_blocks), F.lit(0)).alias(f"{c}_later") for c in "dt"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    rows = rows.join(later, "block")  # later has a row for each BLOCK lengths of the longest text
    rows = rows.withColumns({"docs_from": F.sum("n_docs").over(within) + F.col("d_later"), "tokens_from": F.sum("tokens").over(within) + F.col("t_later")})
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    shorter = F.lit(total) - F.col("tokens_from")
    return rows.select("n_tokens", "n_docs", "docs_from", "tokens_from", (shorter + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, truncated_tokens, lost_tokens for each limit, from the histogram alone."""
    at = hist.withColumn("context_limit", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))))
    kept = F.least("n_tokens", "context_limit") * F.col("n_docs")
    return at.groupBy("context_limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(kept).alias("truncated_tokens"),
        F.sum(F.col("n_tokens") * F.col("n_docs") - kept).alias("lost_tokens"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of documents does not exceed."""
    n = hist.agg(F.max("docs_from")).first()[0] or 0
    at = hist.withColumn("share", F.explode(F.array(*(F.lit(float(x)) for x in shares))))
    up_to = F.lit(n) - F.col("docs_from") + F.col("n_docs")
    return at.where(up_to >= F.col("share") * n).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
