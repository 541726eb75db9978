"""Results of runs on disk: JSON in, JSON and CSV out, configurations, model folders, the scoring contract."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC = "struct<mean:double,std:double,min:double,max:double,values:array<double>>"
SUMMARY = f"dataset string, model string, window struct<size:int,stride:int>, n_folds int, metrics map<string,{METRIC}>, per_fold array<map<string,string>>, pooled_confusion array<array<bigint>>, by_source string, by_detection string, events string, smoothed string, smoothed_events string"
#: The metrics of the wide CSV.
WIDE = ("accuracy", "precision_writing", "recall_writing", "f1_writing", "f2_writing", "f1_macro", "roc_auc", "average_precision", "positive_rate", "predicted_positive_rate")


def read_summaries(spark: SparkSession, runs: str, name: str = "summary.json") -> DataFrame:
    """A row for each configuration of each run folder that has the file, with run (the folder's name)."""
    rows = spark.read.schema(SUMMARY).option("multiLine", True).option("pathGlobFilter", name).option("recursiveFileLookup", True).json(runs)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def write_results(df: DataFrame, path: str, by: str | None = "run", form: str = "json", mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(form)
    (w.partitionBy(by) if by and by in df.columns else w).save(path)


def write_in_order(df: DataFrame, path: str, order: str = "place") -> None:
    """Rows in files whose names and lines follow `order`: ranges of it, each sorted, so any number of tasks write them."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)


def wide(summaries: DataFrame, metrics: tuple[str, ...] = WIDE) -> DataFrame:
    """run, dataset, model, window, n_folds, and mean and std of each metric as columns."""
    w = F.col("window")
    window = F.when(w.isNull(), "frames").otherwise(F.format_string("w%d/s%d", w["size"], w["stride"]))
    values = [F.col("metrics")[m][s].alias(f"{m}_{s}") for m in metrics for s in ("mean", "std")]
    return summaries.select("run", "dataset", "model", window.alias("window"), "n_folds", *values)


def breakdown(summaries: DataFrame, column: str = "by_source") -> DataFrame:
    """run, dataset, model, slice, metric, value: the records of a breakdown (JSON text: slice -> metric -> number) as rows; text that isn't one gives none."""
    parsed = F.from_json(column, "map<string,map<string,double>>")
    rows = summaries.select("run", "dataset", "model", F.explode(parsed).alias("slice", "metrics"))
    return rows.select("run", "dataset", "model", "slice", F.explode("metrics").alias("metric", "value"))


def write_folds(layout: DataFrame, path: str) -> None:
    """The folds in their order, one JSON row each (folds.layout)."""
    layout.orderBy("fold_no").coalesce(1).write.mode("overwrite").json(path)  # a row a fold


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_config(spark: SparkSession, config: dict[str, object], path: str) -> None:
    """The effective configuration as one row of text by name, which config_diff compares."""
    spark.createDataFrame([({k: str(v) for k, v in config.items()},)], "config map<string,string>").write.mode("overwrite").json(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("config map<string,string>").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_contract(spark: SparkSession, features: list[str], thresholds: DataFrame, smoothing: dict[str, float], labels: dict[str, int], path: str, fps: float = 30.0) -> None:
    """What a scorer must know: ordered features, thresholds by configuration, smoothing, labels, clock; one JSON row a configuration."""
    out = thresholds.withColumns({
        "features": F.array(*map(F.lit, features)), "fps": F.lit(fps),
        "smoothing": F.create_map(*(F.lit(x) for kv in smoothing.items() for x in (kv[0], float(kv[1])))),
        "labels": F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)),
    })
    out.write.mode("overwrite").json(path)
