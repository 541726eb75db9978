"""Running sums and percentiles in two levels against one pass over sorted values."""

import random

import numpy as np
import pytest

from tideframe.functions import ranks


def rows(seed):
    rng = random.Random(seed)
    return [(k, None if rng.random() < 0.05 else round(rng.gauss(0, 1), rng.choice([0, 1, 6]))) for k in ("a", "b", None) for _ in range(rng.choice([1, 2, 300]))] + [("hot", 7.0)] * 500


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_percentiles(spark, seed):
    data, at = rows(seed), [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["percentiles"] for r in ranks.percentiles(spark.createDataFrame(data, "k string, v double"), "v", at, "k").collect()}
    for k in got:
        want = np.quantile([v for q, v in data if q == k and v is not None], at)
        assert got[k] == pytest.approx(want.tolist())
    assert set(got) == {k for k, v in data if v is not None}
    whole = ranks.percentiles(spark.createDataFrame(data, "k string, v double"), "v", [0.5]).first()[0]
    assert whole == pytest.approx([np.median([v for _, v in data if v is not None])])
    none = spark.createDataFrame([], "k string, v double")
    assert ranks.percentiles(none, "v", [0.5]).first()[0] == [] and ranks.percentiles(none, "v", [0.5], "k").count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_running(spark, seed):
    values = sorted({(k, v) for k, v in rows(seed) if v is not None}, key=str)
    data = [(k, v, i % 5) for i, (k, v) in enumerate(values)]
    got = ranks.running(spark.createDataFrame(data, "k string, v double, w long"), "v", ["w"], "k", buckets=8).collect()
    assert len(got) == len(data)
    for r in got:
        assert r["before_w"] == sum(w for k, v, w in data if k == r["k"] and v < r["v"]) and r["all_w"] == sum(w for k, _, w in data if k == r["k"])


def test_no_key_is_one_task(spark):
    """The ordered windows are by key and stretch; the one by key alone is over a row for each stretch."""
    df = spark.range(10_000).selectExpr("id % 7 as k", "cast(id as double) as v", "1L as w")
    plan = ranks.running(df, "v", ["w"], "k")._jdf.queryExecution().optimizedPlan().toString()
    ordered = [x for x in plan.splitlines() if "Window [" in x and "v#" in x.split("windowspecdefinition(")[1].split(", specifiedwindowframe")[0]]
    assert ordered and all("_b#" in x.split("windowspecdefinition(")[1].split("v#")[0] for x in ordered)
