"""Gaps and islands over a timeline: runs of a value, events, pauses, sub-sessions, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions import ranks
from tideframe.functions.expr import Key, names, over


def runs(df: DataFrame, value: str, keys: Key = "session", order: str = "frame_index", extra: tuple = ()) -> DataFrame:
    """keys, run (from 0), value, start, end (exclusive, in rows of the session), n, last_run; extra aggregates per run as Columns."""
    w = over(keys, order)
    rows = df.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    begins = F.when((F.col("pos") > 0) & F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    rows = rows.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w) - 1)
    out = rows.groupBy(*names(keys), "run", value).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), *extra)
    return out.withColumn("n", F.col("end") - F.col("start")).withColumn("last_run", F.max("run").over(Window.partitionBy(*names(keys))))


def events(df: DataFrame, value: str, keys: Key = "session", order: str = "frame_index", least: int = 3) -> DataFrame:
    """keys, start, end (exclusive) of the runs of 1 that have `least` rows or more."""
    return runs(df, value, keys, order).where((F.col(value) == 1) & (F.col("n") >= least)).select(*names(keys), "start", "end")


def segments(df: DataFrame, value: str, keys: Key = "session", order: str = "frame_index") -> DataFrame:
    """keys, seg (from 0), label, start, end: every run."""
    return runs(df, value, keys, order).select(*names(keys), F.col("run").alias("seg"), F.col(value).alias("label"), "start", "end")


def pauses(df: DataFrame, value: str, keys: Key = "session", order: str = "frame_index", least: int = 3) -> DataFrame:
    """keys, start, end of the runs of 0 with a run on both sides and `least` rows or more."""
    r = runs(df, value, keys, order)
    inner = (F.col("run") > 0) & (F.col("run") < F.col("last_run"))
    return r.where((F.col(value) == 0) & inner & (F.col("n") >= least)).select(*names(keys), "start", "end")


def split_unscored(df: DataFrame, scored: str = "scored", keys: Key = "session", order: str = "frame_index") -> DataFrame:
    """Scored rows only, with sub: how often a scored row has followed an unscored one in the session so far."""
    w = over(keys, order)
    again = F.when(F.col(scored) & ~F.coalesce(F.lag(scored).over(w), F.lit(True)), 1).otherwise(0)
    first = F.row_number().over(w) == 1
    rows = df.withColumn("again", F.when(first, 0).otherwise(again)).withColumn("sub", F.sum("again").over(w))
    return rows.drop("again").where(F.col(scored))


def chunked(df: DataFrame, rows: int = 500, keys: Key = "session", order: str = "frame_index", name: str = "chunk") -> DataFrame:
    """Pseudo-sessions of `rows` rows for a table that is one session."""
    return df.withColumn(name, F.floor((F.row_number().over(over(keys, order)) - 1) / rows))


def granularity(df: DataFrame, label: str = "label", positive: str = "writing", keys: Key = "session", order: str = "frame_index", ms: str = "timestamp_ms") -> DataFrame:
    """One row: number, percentiles and shares under 167 and 400 ms of positive runs and of interior pauses, and unsure rows.

    Percentiles are whole ms. A run lasts its rows times the session's median step (33.33 ms without one). A pause is one run of
    not-positive between two positive ones.
    """
    k, w = names(keys), over(keys, order)
    step = df.withColumn("dt", F.col(ms) - F.lag(ms).over(w)).groupBy(*k).agg(F.coalesce(F.percentile("dt", 0.5), F.lit(1000 / 30)).alias("step"))
    r = runs(df, label, k, order)
    by = Window.partitionBy(*k).orderBy("run")
    r = r.withColumns({"before": F.lag(label).over(by), "after": F.lead(label).over(by)}).join(step, k)
    r = r.withColumn("ms", F.col("n") * F.col("step"))
    is_run = F.coalesce(F.col(label) == positive, F.lit(False))
    is_pause = F.coalesce((F.col(label) == "not_" + positive) & (F.col("before") == positive) & (F.col("after") == positive), F.lit(False))
    out, shares = [], (10, 25, 50, 75, 90)
    kinds = r.select(F.when(is_run, "runs").when(is_pause, "pauses").alias("kind"), "ms").where("kind is not null")
    found = ranks.percentiles(kinds, "ms", [q / 100 for q in shares], "kind")
    for name, cond in (("runs", is_run), ("pauses", is_pause)):
        value = F.when(cond, F.col("ms"))
        out.append(F.count(value).alias(f"n_{name}"))
        out += [F.bround(F.avg((value < t).cast("int")), 4).alias(f"{name}_under_{t}") for t in (167, 400)]
    whole = r.agg(*out, F.sum(F.when(F.col(label) == "unsure", F.col("n")).otherwise(0)).alias("unsure_rows"))
    at = lambda name, i: F.max(F.when(F.col("kind") == name, F.bround(F.try_element_at("percentiles", F.lit(i + 1)), 0).cast("long")))
    wide = found.agg(*(at(name, i).alias(f"{name}_p{q}") for name in ("runs", "pauses") for i, q in enumerate(shares)))
    return ranks.same_keys(whole, wide, [])
