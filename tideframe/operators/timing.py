"""Session clocks: frame rates, repaired steps, sample-and-hold on a common clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions import ranks
from tideframe.functions.expr import Key, clip, finite, names, over


#: Most ticks in one array.
STRETCH = 10_000


def session_fps(df: DataFrame, keys: Key = "session", order: str = "frame_index", ms: str = "timestamp_ms") -> DataFrame:
    """keys, fps: 1000 / median of the positive steps in ms; null where there is none."""
    t = finite(F.col(ms).cast("double"))
    steps = df.select(*names(keys), (t - F.lag(t).over(over(keys, order))).alias("dt"))
    return steps.groupBy(*names(keys)).agg((1000 / F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5)).alias("fps"))


def repaired_steps(df: DataFrame, keys: Key = "session", order: str = "frame_index", ms: str = "timestamp_ms", low: float = 5.0, high: float = 200.0, normalise: bool = True, name: str = "dt") -> DataFrame:
    """df with the step to the row before in seconds: a step that is missing or outside low..high ms becomes the session's median good step.

    Without any good step: 1000/30 ms. normalise=False gives 1.0 everywhere. `<name>_repaired` says where it was.
    """
    if not normalise:
        return df.withColumns({name: F.lit(1.0), f"{name}_repaired": F.lit(False)})
    k = names(keys)
    t = finite(F.col(ms).cast("double"))
    rows = df.withColumn("_d", t - F.lag(t).over(over(k, order)))
    rows = rows.withColumn("_d", F.when(F.col("_d").between(low, high), F.col("_d")))
    # the median by an aggregate and a join: over an ordered window frame it would be computed row by row
    middle = rows.groupBy(*k).agg(F.coalesce(F.percentile("_d", 0.5), F.lit(1000 / 30)).alias("_m"))
    rows = rows.join(middle, k)
    return rows.withColumns({name: clip(F.coalesce("_d", "_m"), low, high) / 1000, f"{name}_repaired": F.col("_d").isNull()}).drop("_d", "_m")


def resample(df: DataFrame, fps: float, keys: Key = "session", order: str = "frame_index", ms: str = "timestamp_ms", tolerance: float = 0.05) -> DataFrame:
    """Sample-and-hold: at each tick of the clock the latest row at or before it; never a later one.

    Sessions without a rate, with a null timestamp, or within `tolerance` of the wanted rate stay as they are.
    Resampled ones get new frame numbers and tick timestamps (rounded half to even); source_<order> keeps the old number.
    Of rows with one timestamp the last is held. Each row yields the ticks until the next row: no range join.
    """
    k = names(keys)
    rows = df.join(clocks(df, fps, k, order, ms, tolerance), k)
    rows = rows.withColumn("_next", F.lead(F.col(ms).cast("double")).over(over(k, order)))
    return ticks(rows, fps, df.columns, order, ms)


def clocks(df: DataFrame, fps: float, keys: Key = "session", order: str = "frame_index", ms: str = "timestamp_ms", tolerance: float = 0.05, rates: DataFrame | None = None) -> DataFrame:
    """keys, _t0 (a session's first timestamp), _same (whether it stays as it is). rates: session_fps() if known."""
    k = names(keys)
    rates = session_fps(df, k, order, ms) if rates is None else rates
    whole = df.groupBy(*k).agg(F.min(F.col(ms).cast("double")).alias("_t0"), F.max(F.col(ms).isNull().cast("int")).alias("_gap"))
    same = F.col("fps").isNull() | (F.col("_gap") == 1) | (F.abs(F.col("fps") - fps) / fps <= tolerance)
    return ranks.same_keys(rates, whole, k).select(*k, "_t0", same.alias("_same"))


def ticks(rows: DataFrame, fps: float, columns: list[str], order: str = "frame_index", ms: str = "timestamp_ms") -> DataFrame:
    """The ticks that each row holds, up to the next row's timestamp (_next), on the clock that begins at _t0; rows that are _same as they are."""
    step = 1000.0 / fps
    t = F.col(ms).cast("double")
    first = F.ceil((t - F.col("_t0")) / step)
    last = F.when(F.col("_next").isNotNull(), F.ceil((F.col("_next") - F.col("_t0")) / step) - 1).otherwise(F.floor((t + 1e-6 - F.col("_t0")) / step))
    # a gap's ticks in stretches, and each stretch's ticks: a wrong timestamp makes many rows but no huge array
    stretches = F.when(F.col("_same"), F.array(F.lit(None).cast("long"))).when(last >= first, F.sequence(first, last, F.lit(STRETCH))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("_last", last).withColumn("_stretch", F.explode(stretches))
    within = F.when(F.col("_stretch").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence("_stretch", F.least("_last", F.col("_stretch") + STRETCH - 1)))
    rows = rows.withColumn("_tick", F.explode(within)).drop("_last", "_stretch")
    moved = F.col("_tick").isNotNull()
    return rows.select(
        *(c for c in columns if c not in (order, ms)),
        F.when(moved, F.col("_tick")).otherwise(F.col(order)).cast("long").alias(order),
        F.when(moved, F.bround(F.col("_t0") + F.col("_tick") * step)).otherwise(t).cast("long").alias(ms),
        F.col(order).alias(f"source_{order}"),
    )


def repair_notes(df: DataFrame, group: Key = (), name: str = "dt", scale: float = 1.0) -> DataFrame:
    """Per group of repaired_steps(): rows, repaired rows, and the median of the rates 1 / step (times scale) after repair."""
    g = names(group)
    rates = df.withColumn("_rate", F.lit(scale) / F.col(name)).select(*g, "_rate", f"{name}_repaired")
    counts = rates.groupBy(*g).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(f"{name}_repaired")).alias("repaired"))
    return ranks.same_keys(counts, ranks.percentiles(rates, "_rate", [0.5], g).select(*g, F.element_at("percentiles", 1).alias("median_rate")), g, "left")


def clock_notes(df: DataFrame, keys: Key = "session", order: str = "frame_index", ms: str = "timestamp_ms", scale: float = 1.0) -> DataFrame:
    """fps (times scale, to one place), sessions: a histogram of measured rates."""
    return session_fps(df, keys, order, ms).groupBy(F.round(F.col("fps") * scale, 1).alias("fps")).agg(F.count(F.lit(1)).alias("sessions"))
