"""Report tables by configuration, over folds: episodes, pauses, segments, where the score comes from. Best configuration first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.expr import Key, names

CONFIG = ("dataset", "model", "window")
EPISODES = ("iou_f1", "iou_recall", "onset_f1", "median_onset_error", "mean_fragments", "missed_entirely")
SEGMENTS = ("edit_score", "seg_f1_10", "seg_f1_25", "seg_f1_50")


def over_folds(results: DataFrame, metrics: tuple[str, ...], by: str, keys: Key = CONFIG) -> DataFrame:
    """keys, n_folds, mean and sd of each metric over the folds that have it (0 for one fold), and place within the dataset by the mean of `by`, a missing one last.

    results: a row for each configuration and fold, as experiment.evaluated gives.
    """
    k = names(keys)
    out = results.groupBy(*k).agg(F.count(F.lit(1)).alias("n_folds"), *(c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_sd"))))
    order = Window.partitionBy(k[0]).orderBy(F.desc_nulls_last(f"{by}_mean"), *k[1:])  # a row for each configuration
    return out.withColumn("place", F.row_number().over(order))


def episodes(results: DataFrame, keys: Key = CONFIG) -> DataFrame:
    return over_folds(results, EPISODES, "iou_f1", keys)


def pauses(results: DataFrame, keys: Key = CONFIG, tolerances: tuple[int, ...] = (5, 10, 12)) -> DataFrame:
    return over_folds(results, tuple(f"pause{t}_{m}" for t in tolerances for m in ("precision", "recall", "f1", "f2")), f"pause{tolerances[0]}_f2", keys)


def segments(results: DataFrame, keys: Key = CONFIG) -> DataFrame:
    return over_folds(results, SEGMENTS, "seg_f1_50", keys)


def detection(slices: DataFrame, keys: Key = CONFIG, hand: str = "hand_detected") -> DataFrame:
    """keys, mean F1 over folds of rows with and without a hand, and the share of positives without one. slices: metrics.slices by configuration and fold."""
    k = names(keys)
    of = lambda v, m: F.avg(F.when(F.col("value") == v, F.col(m)))
    rows = slices.where(F.col("slice") == hand)
    return rows.groupBy(*k).agg(of("1", "f1").alias("hand_f1"), of("0", "f1").alias("no_hand_f1"), of("0", "positive_rate").alias("no_hand_prior"))
