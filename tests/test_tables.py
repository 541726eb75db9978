"""Report tables over folds, ordered results, world runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tideframe.operators import clean, summary, tables
from tideframe.sources import results


def test_tables_over_folds(spark):
    metrics = [*tables.EPISODES, *tables.SEGMENTS, *(f"pause{t}_{m}" for t in (5, 10, 12) for m in ("precision", "recall", "f1", "f2"))]
    rows = [("d", m, "frames", f, *(None if (m, f, i) == ("b", 1, 0) else base + f + i / 10 for i in range(len(metrics)))) for m, base in (("a", 1.0), ("b", 5.0)) for f in (0, 1)] + [("d", "c", "frames", 0, *[None] * len(metrics))]
    df = spark.createDataFrame(rows, "dataset string, model string, window string, fold int, " + ", ".join(f"{m} double" for m in metrics))
    got = {r["model"]: r for r in tables.episodes(df).collect()}
    assert [got[m]["place"] for m in "bac"] == [1, 2, 3]
    assert got["a"]["iou_f1_mean"] == 1.5 and got["a"]["iou_f1_sd"] == pytest.approx(0.5**0.5) and got["a"]["n_folds"] == 2
    assert got["b"]["iou_f1_mean"] == 5.0 and got["b"]["iou_f1_sd"] == 0.0 and got["c"]["iou_f1_mean"] is None and got["c"]["iou_f1_sd"] is None
    assert {r["model"]: r["place"] for r in tables.pauses(df).collect()} == {r["model"]: r["place"] for r in tables.segments(df).collect()} == {"b": 1, "a": 2, "c": 3}


def test_results_in_the_order_of_folds(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i % 7}", m, float(i)) for i in range(70) for m in ("x", "y")], "fold string, model string, f1 double").repartition(6)
    folds = spark.createDataFrame([(f"f{i}", 7 - i) for i in range(7)], "fold string, fold_no int")
    out = summary.in_fold_order(rows, folds, "model", "f1")
    assert sorted(r["place"] for r in out.collect()) == list(range(140))
    path = str(tmp_path / "ordered")
    results.write_in_order(out, path)
    lines = [json.loads(x) for name in sorted(os.listdir(path)) if name.startswith("part-") for x in open(f"{path}/{name}")]
    assert [x["place"] for x in lines] == list(range(140))
    assert [(x["fold_no"], x["model"], x["f1"]) for x in lines] == sorted((x["fold_no"], x["model"], x["f1"]) for x in lines)


def test_lists_are_short(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") < 990, F.col("id")).alias("v"))
    got = {r["g"]: r for r in clean.listed(df, "v", 3, "g").collect()}
    assert got[0]["first"] == [0, 2, 4] and got[1]["n_first"] == 495
    assert clean.listed(df, "v", 2).first()["first"] == [0, 1]
