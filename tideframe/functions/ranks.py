"""Running sums and exact percentiles over ordered values, in two levels, so that no key's values are one task's.

A sketch of each key's values gives bounds of BUCKETS stretches; what lies before a stretch is summed over the few stretches,
what lies before a value within it over its stretch alone. The bounds only deal values out: results are exact.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.expr import Key, names

BUCKETS = 64


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on equal keys, null with null; right's own columns follow. Without keys right is one row."""
    if not keys:
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(right, on, how).drop(*(f"_right_{k}" for k in keys))


def running(df: DataFrame, value: str, weights: list[str], keys: Key = (), buckets: int = BUCKETS) -> DataFrame:
    """df (one row for each key and value) with before_<w>, the sum of w over the key's smaller values, and all_<w>, over all of them."""
    k = names(keys)
    cuts = df.groupBy(*k).agg(F.percentile_approx(value, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), 1000).alias("_cuts"))
    rows = same_keys(df, cuts, k).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = rows.groupBy(*k, "_b").agg(*(F.sum(w).alias(f"_sum_{w}") for w in weights))
    whole = Window.partitionBy(*k)
    sums = sums.select(*k, "_b", *(c for w in weights for c in ((F.sum(f"_sum_{w}").over(whole.orderBy("_b")) - F.col(f"_sum_{w}")).alias(f"_earlier_{w}"), F.sum(f"_sum_{w}").over(whole).alias(f"all_{w}"))))
    inner = Window.partitionBy(*k, "_b").orderBy(value)
    rows = rows.withColumns({f"_within_{w}": F.sum(w).over(inner) - F.col(w) for w in weights})
    out = same_keys(rows, sums, [*k, "_b"])
    return out.select(*df.columns, *(c for w in weights for c in ((F.col(f"_earlier_{w}") + F.col(f"_within_{w}")).alias(f"before_{w}"), F.col(f"all_{w}"))))


def percentiles(df: DataFrame, value: str, at: list[float], keys: Key = (), name: str = "percentiles", count: str | None = None) -> DataFrame:
    """keys, <name>: the exact percentiles of the key's values at these shares, interpolated between neighbours, in their order. Nulls don't count.

    Keys without a value have no row; without keys there is one row, of no percentiles where there is no value. count: a column of how often
    a row counts, for rows that are counted already.
    """
    k = names(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*k, F.col(value).cast("double").alias("_v")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))
    ranked = running(counts, "_v", ["_n"], k)
    # the two places between which each percentile lies, and which values stand there
    place = F.transform(F.array(*(F.lit(float(q)) for q in at)), lambda q: q * (F.col("all__n") - 1))
    wanted = F.filter(
        F.transform(place, lambda p, i: F.struct(i.alias("i"), p.alias("p"), F.floor(p).alias("low"), F.ceil(p).alias("high"))),
        lambda x: ((x["low"] >= F.col("before__n")) & (x["low"] < F.col("before__n") + F.col("_n"))) | ((x["high"] >= F.col("before__n")) & (x["high"] < F.col("before__n") + F.col("_n"))),
    )
    found = ranked.select(*k, "_v", "before__n", "_n", F.inline(wanted))
    has = lambda c: (F.col(c) >= F.col("before__n")) & (F.col(c) < F.col("before__n") + F.col("_n"))
    per = found.groupBy(*k, "i").agg(F.max(F.when(has("low"), F.col("_v"))).alias("a"), F.max(F.when(has("high"), F.col("_v"))).alias("b"), F.max(F.col("p") - F.col("low")).alias("w"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", ((1 - F.col("w")) * F.col("a") + F.col("w") * F.col("b")).alias("x")))), lambda s: s["x"])
    return per.groupBy(*k).agg(values.alias(name))
