"""Sessions longer than one task: decisions, runs, chunks, clocks and motion over blocks of a session (functions.blocks).

rows is a timeline dealt by blocks.dealt(df, keys, order); results are those of the operators of the same names, which order a whole session in
one task. A session's rows are ordered within a block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions import blocks, ranks
from tideframe.functions.expr import Key, clip, finite, names, over
from tideframe.operators import smoothing, timing


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def hysteresis(rows: DataFrame, score: str, low: float, high: float, keys: Key = "session", name: str = "pred") -> DataFrame:
    """smoothing.hysteresis: a block's state is its last mark, and a block begins with the last mark of the blocks before it."""
    k = names(keys)
    x = F.nanvl(F.col(score).cast("double"), F.lit(None))
    rows = rows.withColumn("_mark", F.when(x >= high, 1).when(x < low, 0))
    state = F.max(F.when(F.col("_mark").isNotNull(), F.struct("_id", "_mark")))["_mark"]
    rows = blocks.carried(rows, k, {"_before": (state, _last)})
    now = _last(F.col("_mark")).over(over([*k, "_block"], "_id"))
    return rows.withColumn(name, F.coalesce(now, F.col("_before"), F.lit(0))).drop("_mark", "_before")


def least_durations(rows: DataFrame, value: str = "pred", on: int = 3, off: int = 3, keys: Key = "session") -> DataFrame:
    """smoothing.least_durations: with on + off rows on both sides a block sees whole every run that is too short, after filling too.

    A run that touches the end of what is seen, but not of the session, is longer than that, so it stays as one at a session's edge does.
    """
    return blocks.local(rows, keys, on + off, on + off, lambda r, k, order: smoothing.least_durations(r, value, on, off, k, order))


def smooth(rows: DataFrame, score: str, threshold: float, band: float = 0.1, on: int = 3, off: int = 3, keys: Key = "session", name: str = "pred") -> DataFrame:
    low, high = smoothing.thresholds(threshold, band)
    return least_durations(hysteresis(rows, score, low, high, keys, name), name, on, off, keys)


def runs(rows: DataFrame, value: str, keys: Key = "session") -> DataFrame:
    """runs.runs: keys, run, value, start, end, n, last_run. A block's state is how many rows and how many beginnings of runs it has."""
    k = names(keys)

    def marked(r: DataFrame, own: list[str], order: str) -> DataFrame:
        w = over(own, order)
        # the first row of all has no row before it; otherwise a block's first row has a guest before it
        begins = F.when(F.lag(F.lit(1)).over(w).isNotNull() & F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
        return r.withColumn("_begins", begins)

    rows = blocks.local(rows.select(*k, value, "_block", "_id"), k, 1, 0, marked)
    rows = blocks.carried(rows, k, {"_runs": (F.sum("_begins"), F.sum), "_rows": (F.count(F.lit(1)), F.sum)})
    w = over([*k, "_block"], "_id")
    run = (F.coalesce("_runs", F.lit(0)) + F.sum("_begins").over(w) - 1).alias("run")
    pos = (F.coalesce("_rows", F.lit(0)) + F.row_number().over(w) - 1).cast("long").alias("pos")
    out = rows.select(*k, value, run, pos).groupBy(*k, "run", value).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    out = out.withColumn("n", F.col("end") - F.col("start"))
    return ranks.same_keys(out, out.groupBy(*k).agg(F.max("run").alias("last_run")), k)


def events(rows: DataFrame, value: str, keys: Key = "session", least: int = 3) -> DataFrame:
    return runs(rows, value, keys).where((F.col(value) == 1) & (F.col("n") >= least)).select(*names(keys), "start", "end")


def pauses(rows: DataFrame, value: str, keys: Key = "session", least: int = 3) -> DataFrame:
    inner = (F.col("run") > 0) & (F.col("run") < F.col("last_run"))
    return runs(rows, value, keys).where((F.col(value) == 0) & inner & (F.col("n") >= least)).select(*names(keys), "start", "end")


def split_unscored(rows: DataFrame, scored: str = "scored", keys: Key = "session") -> DataFrame:
    """runs.split_unscored: a block's state is how often a scored row follows an unscored one."""
    k = names(keys)

    def marked(r: DataFrame, own: list[str], order: str) -> DataFrame:
        before = F.lag(scored).over(over(own, order))
        return r.withColumn("_again", F.when(F.col(scored) & ~F.coalesce(before, F.lit(True)), 1).otherwise(0))

    rows = blocks.carried(blocks.local(rows, k, 1, 0, marked), k, {"_earlier": (F.sum("_again"), F.sum)})
    sub = F.coalesce("_earlier", F.lit(0)) + F.sum("_again").over(over([*k, "_block"], "_id"))
    return rows.withColumn("sub", sub).where(F.col(scored)).drop("_again", "_earlier")


def chunked(rows: DataFrame, size: int = 500, keys: Key = "session", name: str = "chunk") -> DataFrame:
    """runs.chunked by carried counts."""
    return blocks.positions(rows, keys, "_pos").withColumn(name, F.floor(F.col("_pos") / size)).drop("_pos")


def _differences(rows: DataFrame, keys: list[str], ms: str) -> DataFrame:
    t = finite(F.col(ms).cast("double"))
    return blocks.local(rows, keys, 1, 0, lambda r, k, order: r.withColumn("_d", t - F.lag(t).over(over(k, order))))


def session_fps(rows: DataFrame, keys: Key = "session", ms: str = "timestamp_ms") -> DataFrame:
    """timing.session_fps with the median by ranks of counted values."""
    k = names(keys)
    steps = _differences(rows.select(*k, ms, "_block", "_id"), k, ms)
    known = ranks.percentiles(steps.where("_d > 0"), "_d", [0.5], k).select(*k, F.element_at("percentiles", 1).alias("_m"))
    return ranks.same_keys(rows.select(*k).distinct(), known, k, "left").select(*k, (1000 / F.col("_m")).alias("fps"))


def repaired_steps(rows: DataFrame, keys: Key = "session", ms: str = "timestamp_ms", low: float = 5.0, high: float = 200.0, name: str = "dt") -> DataFrame:
    """timing.repaired_steps: differences across block ends by a halo of one row, the session's median by ranks of counted values."""
    k = names(keys)
    steps = _differences(rows, k, ms).withColumn("_d", F.when(F.col("_d").between(low, high), F.col("_d")))
    good = ranks.percentiles(steps.select(*k, "_d"), "_d", [0.5], k).select(*k, F.element_at("percentiles", 1).alias("_m"))
    middle = ranks.same_keys(rows.select(*k).distinct(), good, k, "left").select(*k, F.coalesce("_m", F.lit(1000 / 30)).alias("_m"))
    out = blocks.with_group(steps, middle, k)
    return out.withColumns({name: clip(F.coalesce("_d", "_m"), low, high) / 1000, f"{name}_repaired": F.col("_d").isNull()}).drop("_d", "_m")


def resample(rows: DataFrame, fps: float, columns: list[str], keys: Key = "session", order: str = "frame_index", ms: str = "timestamp_ms", tolerance: float = 0.05) -> DataFrame:
    """timing.resample of the columns: a block's last row holds until the first row of the next."""
    k = names(keys)
    clock = timing.clocks(rows, fps, k, order, ms, tolerance, session_fps(rows, k, ms))
    ahead = blocks.local(rows, k, 0, 1, lambda r, own, by: r.withColumn("_next", F.lead(F.col(ms).cast("double")).over(over(own, by))))
    return timing.ticks(blocks.with_group(ahead, clock, k), fps, columns, order, ms)
