"""Sessions cut into blocks against the operators that order them whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests import naive
from tideframe.functions import blocks
from tideframe.functions.expr import over
from tideframe.operators import long, runs, smoothing, timing


@pytest.fixture(scope="module")
def frame(spark):
    """A long session, some of one to a few rows, one without a name, one of one value; scores and times with nulls and repeats."""
    rng = random.Random(5)
    rows = []
    for name, n in (("long", 900), ("a", 1), ("b", 2), (None, 40), ("c", 7), ("flat", 300), *((f"s{i}", rng.randint(1, 12)) for i in range(25))):
        t, y = 0, 0
        for i in range(n):
            t += rng.choice([0, 3, 33, 34, 40, 400])
            y = y if name == "flat" or rng.random() < 0.75 else 1 - y
            rows.append((name, i, t, rng.choice([None, rng.random(), rng.random(), 0.4]) if name != "flat" else 0.35, y, rng.random() < 0.8))
    return spark.createDataFrame(rows, "session string, frame_index int, timestamp_ms long, score double, y int, scored boolean").repartition(4)


@pytest.fixture(scope="module", params=[3, 40])
def rows(frame, request):
    return blocks.dealt(frame, "session", ["frame_index"], request.param)


def same(got, want, *columns):
    say = lambda df: sorted(map(str, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())))
    assert say(got) == say(want)


def named(df):
    """The null session by name, as joins on session drop it."""
    return df.withColumn("session", F.coalesce("session", F.lit("none")))


def test_the_long_session_is_many_blocks(rows):
    n = rows.where("session = 'long'").select("_block").distinct().count()
    assert n >= min(2, rows.select("_block").distinct().count())


def test_decisions(frame, rows):
    want = smoothing.hysteresis(frame, "score", 0.3, 0.6)
    same(long.hysteresis(rows, "score", 0.3, 0.6), want, "session", "frame_index", "pred")
    for on, off in ((3, 3), (5, 2), (1, 4)):
        same(long.least_durations(rows, "y", on, off), smoothing.least_durations(frame, "y", on, off), "session", "frame_index", "y")
    same(long.smooth(rows, "score", 0.5), smoothing.smooth(frame, "score", 0.5), "session", "frame_index", "pred")
    by = [r["y"] for r in frame.where("session = 'long'").orderBy("frame_index").collect()]
    assert [r["y"] for r in long.least_durations(rows, "y", 4, 6).where("session = 'long'").orderBy("frame_index").collect()] == naive.durations(by, 4, 6)


def test_runs_cuts_and_chunks(frame, rows):
    same(long.runs(rows, "y"), runs.runs(frame, "y"), "session", "run", "y", "start", "end", "n", "last_run")
    same(long.events(rows, "y"), runs.events(frame, "y"), "session", "start", "end")
    same(long.pauses(rows, "y", least=2), runs.pauses(frame, "y", least=2), "session", "start", "end")
    same(long.split_unscored(rows), runs.split_unscored(frame), "session", "frame_index", "sub")
    same(long.chunked(rows, 50), runs.chunked(frame, 50), "session", "frame_index", "chunk")


def test_clocks(frame, rows):
    same(long.session_fps(rows), timing.session_fps(frame), "session", "fps")
    whole, cut = named(frame), named(rows)
    same(long.repaired_steps(cut), timing.repaired_steps(whole), "session", "frame_index", "dt", "dt_repaired")
    for fps in (7.0, 25.0, 30.0):
        same(long.resample(cut, fps, frame.columns), timing.resample(whole, fps), *timing.resample(whole, fps).columns)


def test_rolling(frame, rows):
    def work(r, keys, order):
        w = over(keys, order)
        return r.withColumns({"m": F.avg("score").over(w.rowsBetween(-30, 0)), "c": F.sum("y").over(w.rowsBetween(-2, 2)), "next": F.lead("y", 3).over(w)})

    same(blocks.local(rows, "session", 30, 3, work), work(frame, ["session"], "frame_index"), "session", "frame_index", "m", "c", "next")


def test_no_window_orders_a_session(rows):
    """Every ordered window goes by session and block; only summaries, a row for each block, are ordered by session."""
    df = long.least_durations(long.hysteresis(rows, "score", 0.3, 0.6), "pred")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    ordered = re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)[^)]*", plan)
    assert ordered
    for spec in ordered:
        assert "_block" in spec, spec


def test_no_rows(frame):
    rows = blocks.dealt(frame.where("false"), "session", ["frame_index"])
    assert long.smooth(rows, "score", 0.5).count() == 0 and long.runs(rows, "y").count() == 0 and long.chunked(rows).count() == 0
    assert long.resample(named(rows), 5.0, frame.columns).count() == 0


def test_hosts():
    """A block of few rows lets those before it through."""
    spans = [(0, 0, 9), (1, 100, 101), (4, 400, 409)]
    assert blocks._hosts(spans, 3, 0) == [(0, 1, 7, 9), (1, 4, 100, 101), (0, 4, 9, 9)]
    assert blocks._hosts(spans, 0, 1) == [(1, 0, 100, 100), (4, 1, 400, 400)]
