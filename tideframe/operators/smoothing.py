"""Decisions from scores: two thresholds with memory, least durations, percentile maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions import ranks
from tideframe.functions.expr import Key, names, over


def thresholds(threshold: float, band: float = 0.1, low: float | None = None, high: float | None = None) -> tuple[float, float]:
    """low, high: half a band to either side of the threshold, within 0.01..0.99; given ones win; swapped if the wrong way round."""
    high = min(0.99, threshold + band / 2) if high is None else high
    low = max(0.01, threshold - band / 2) if low is None else low
    return (low, high) if low <= high else (high, low)


def hysteresis(df: DataFrame, score: str, low, high, keys: Key = "session", order: str = "frame_index", name: str = "pred") -> DataFrame:
    """1 from the first score of `high` or more until one under `low`, and so on; 0 at first. Null scores change nothing. Exact for low <= high.

    low and high are numbers or Columns.
    """
    low, high = (x if hasattr(x, "cast") else F.lit(x) for x in (low, high))
    x = F.nanvl(F.col(score).cast("double"), F.lit(None))
    mark = F.when(x >= high, 1).when(x < low, 0)
    before = over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(0)))


def _without_short(df: DataFrame, value: str, of: int, least: int, keys: Key, order: str) -> DataFrame:
    """Interior runs of `of` under `least` rows take the other value; runs at a session's edge stay."""
    k, w = names(keys), over(keys, order)
    begins = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    rows = df.withColumn("_b", begins).withColumn("_run", F.sum("_b").over(w))
    run = Window.partitionBy(*k, "_run")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(run), "_last": F.max("_run").over(Window.partitionBy(*k))})
    short = (F.col(value) == of) & (F.col("_n") < least) & (F.col("_run") > 1) & (F.col("_run") < F.col("_last"))
    return rows.withColumn(value, F.when(short, 1 - of).otherwise(F.col(value))).drop("_b", "_run", "_n", "_last")


def least_durations(df: DataFrame, value: str = "pred", on: int = 3, off: int = 3, keys: Key = "session", order: str = "frame_index") -> DataFrame:
    """First fill short interior gaps, then drop short interior runs of 1."""
    return _without_short(_without_short(df, value, 0, off, keys, order), value, 1, on, keys, order)


def smooth(df: DataFrame, score: str, threshold: float, band: float = 0.1, on: int = 3, off: int = 3, low: float | None = None, high: float | None = None, keys: Key = "session", order: str = "frame_index", name: str = "pred") -> DataFrame:
    low, high = thresholds(threshold, band, low, high)
    return least_durations(hysteresis(df, score, low, high, keys, order, name), name, on, off, keys, order)


def percentile_map(df: DataFrame, score: str, reference: DataFrame, ref: str, keys: Key = (), name: str = "percentile") -> DataFrame:
    """Share of the reference's values (of the same keys) that lie strictly under the score; the score itself without any.

    Distinct values of both are ordered together in two levels (ranks.running), so equal scores are one row there and no key's
    values are one task's.
    """
    k = names(keys)
    values = reference.where(F.col(ref).isNotNull()).select(*k, F.col(ref).cast("double").alias("_v"), F.lit(1).alias("_c"))
    wanted = df.where(F.col(score).isNotNull()).select(*k, F.col(score).cast("double").alias("_v"), F.lit(0).alias("_c"))
    both = values.unionByName(wanted).groupBy(*k, "_v").agg(F.sum("_c").alias("_c"))
    share = ranks.running(both, "_v", ["_c"], k).select(*k, "_v", F.when(F.col("all__c") > 0, F.col("before__c") / F.col("all__c")).alias("_share"))
    columns = [c for c in df.columns if c != name]
    out = ranks.same_keys(df.withColumn("_v", F.col(score).cast("double")), share, [*k, "_v"], "left")
    return out.select(*columns, F.coalesce("_share", "_v").alias(name))
