"""Detectors by fold: rules over a signal (no model object), forests and window models by Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.operators import metrics


def rule_scores(rows: DataFrame, signal: str, true: str = "y", beta: float = 1.0, fold: str = "fold") -> DataFrame:
    """Rows of all folds with score, threshold (fitted on train, or on val where train has one class), pred: one query for all folds."""
    fit = lambda s: metrics.fit_threshold(rows.where((F.col("split") == s) & F.col("scored")), true, signal, fold, beta, single="median")
    points = metrics.operating_point({"train": fit("train"), "val": fit("val")}, fold)
    return rows.join(points, fold).withColumn("score", F.col(signal)).withColumn("pred", F.coalesce((F.col(signal) >= F.col("threshold")).cast("int"), F.lit(0)))


def balanced(df: DataFrame, true: str = "y") -> DataFrame:
    """df with weight n / (2 n_class): two numbers from one pass."""
    n = {r[true]: r["count"] for r in df.groupBy(true).count().collect()}
    total = sum(n.values())
    return df.withColumn("weight", reduce(lambda c, k: c.when(F.col(true) == k, total / (len(n) * n[k])), n, F.when(F.lit(False), 1.0)))


def forest(train: DataFrame, features: list[str], true: str = "y", trees: int = 300, depth: int = 12, seed: int = 42) -> PipelineModel:
    """A balanced forest over frame features (scored rows are the caller's choice)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=true, weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"), rf]).fit(balanced(train, true))


def scored_by(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*(c for c in df.columns if c != name), name)


def importances(model: PipelineModel, features: list[str], df: DataFrame, n: int = 20) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def _each_part(rows: DataFrame, fit_and_score: Callable[[DataFrame, DataFrame], DataFrame], unit: str, k: int, true: str) -> DataFrame:
    """rows scored part by part (units by hash) by what was fitted on the other parts, or on all where those lack a class."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.col(unit).cast("string")), F.lit(k)))
    done = []
    for i in range(k):
        inner = rows.where(F.col("_part") != i)
        if inner.select(true).distinct().count() < 2:
            inner = rows
        done.append(fit_and_score(inner, rows.where(F.col("_part") == i)))
    return reduce(DataFrame.unionByName, done).drop("_part")


def out_of_fold(train: DataFrame, features: list[str], unit: str = "participant", k: int = 3, true: str = "y", **params) -> DataFrame:
    """train with a score from a forest that did not see the row's unit: what thresholds are fitted on."""
    return _each_part(train, lambda inner, part: scored_by(forest(inner, features, true, **params), part), unit, k, true)


def windows_out_of_fold(wins: DataFrame, unit: str = "participant", k: int = 3, true: str = "y", name: str = "p") -> DataFrame:
    return _each_part(wins, lambda inner, part: score_windows(window_model(inner, true), part, name), unit, k, true)


def window_model(windows: DataFrame, true: str = "y") -> PipelineModel:
    """Logistic regression on flattened windows, balanced by class weights; it stands in for recurrent networks."""
    rows = balanced(windows, true).withColumn("features", array_to_vector(F.flatten(F.transform("window", lambda x: x.cast("array<double>")))))
    return Pipeline(stages=[LogisticRegression(featuresCol="features", labelCol=true, weightCol="weight", regParam=0.01)]).fit(rows)


def score_windows(model: PipelineModel, windows: DataFrame, name: str = "score") -> DataFrame:
    rows = windows.withColumn("features", array_to_vector(F.flatten(F.transform("window", lambda x: x.cast("array<double>")))))
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).select(*(c for c in windows.columns if c != name), name)
