"""Streams give what the batch operators give on the same rows, across micro-batches."""

import random
from datetime import datetime, timedelta

from tideframe.operators import smoothing, timing
from tideframe.streaming import live


def run(spark, tmp_path, rows, make, schema="session string, frame_index long, timestamp_ms double, value double"):
    src, name = tmp_path / "in", f"q{random.getrandbits(40)}"
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect(), spark.createDataFrame(rows, schema)


def timeline(seed):
    rng, rows = random.Random(seed), []
    for i in range(60):
        for s in "ab":
            rows.append((s, i, i * 40.0 + rng.random() * 5, rng.random()))
    return rows


def test_hysteresis(spark, tmp_path):
    got, df = run(spark, tmp_path, timeline(1), lambda s: live.decide(s, 0.4, 0.6, score="value"))
    want = smoothing.hysteresis(df, "value", 0.4, 0.6).collect()
    assert {(r["session"], r["frame_index"]): r["pred"] for r in got} == {(r["session"], r["frame_index"]): r["pred"] for r in want}


def test_ticks(spark, tmp_path):
    got, df = run(spark, tmp_path, timeline(2), lambda s: live.sample_and_hold(s, 30.0))
    want = {(r["session"], r["frame_index"]): r["source_frame_index"] for r in timing.resample(df, 30.0).collect()}
    mine = {(r["session"], r["frame_index"]): r["source_frame_index"] for r in got}
    assert mine.items() <= want.items() and len(want) - len(mine) <= 2 * 3  # ticks of the last rows wait for the close


def test_durations_without_spark():
    from tests import naive

    for seed in range(200):
        rng = random.Random(seed)
        scores = [rng.choice((0.0, 1.0)) for _ in range(rng.randint(1, 40))]
        on, off = rng.randint(1, 4), rng.randint(1, 4)
        op = live.Decisions(0.5, 0.5, on, off)
        out = [x for i, v in enumerate(scores) for x in op.row(i, 0.0, v)] + list(op.close())
        assert [f for f, _ in out] == list(range(len(scores)))
        assert [p for _, p in out] == naive.durations([int(v) for v in scores], on, off)


def test_speeds_without_spark():
    op = live.Speeds(n=3)
    out = [x for i, (t, v) in enumerate([(0, 0.0), (40, 1.0), (80, 3.0), (1000, 3.0)]) for x in op.row(i, float(t), v)]
    assert [round(r[2], 6) for r in out] == [0.0, 25.0, 50.0, 0.0]
    assert out[3][1] == 0.04 and round(out[3][3], 6) == 25.0


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [("a", i, i * 10.0, 1.0) for i in range(40)] + [("a", 5, 50.0, 0.0), ("a", 40, 400.0, 1.0)]
    got, _ = run(spark, tmp_path, rows, lambda s: live.decide(s, 0.4, 0.6, score="value"))
    assert sorted(r["frame_index"] for r in got) == list(range(41))


TIMED = "session string, frame_index long, timestamp_ms double, value double, at timestamp"


def timed(rows):
    return [(*r, datetime(2024, 1, 1) + timedelta(milliseconds=r[2])) for r in rows]


def test_live_sessions_stay_open(spark, tmp_path):
    """Two sessions over four batches, seconds apart: none is closed and begins again."""
    rows = timed([(s, i, i * 40.0, i % 7 / 7) for i in range(80) for s in "ab"])
    got, df = run(spark, tmp_path, rows, lambda s: live.sample_and_hold(s, 30.0, event_time="at", idle="10 minutes"), TIMED)
    ticks = [(r["session"], r["frame_index"]) for r in got]
    want = {(r["session"], r["frame_index"]): r["source_frame_index"] for r in timing.resample(df.drop("at"), 30.0).collect()}
    assert len(ticks) == len(set(ticks)) and len(want) - len(ticks) <= 2 * 3
    assert all(want[r["session"], r["frame_index"]] == r["source_frame_index"] for r in got)


def test_idle_sessions_are_closed(spark, tmp_path):
    """a ends; once b is ten minutes further a is closed and gives out what it held back, and b goes on."""
    rows = timed([("a", i, i * 40.0, 1.0) for i in range(40)] + [("b", i, i * 15_000.0, 1.0) for i in range(160)])
    got, df = run(spark, tmp_path, rows, lambda s: live.decide(s, 0.4, 0.6, on=60, off=3, score="value", event_time="at", idle="10 minutes"), TIMED)
    by = {s: sorted((r["frame_index"], r["pred"]) for r in got if r["session"] == s) for s in "ab"}
    assert by["a"] == [(i, 1) for i in range(40)]
    assert [f for f, _ in by["b"]] == list(range(len(by["b"]))) and len(by["b"]) >= 60


def test_median_of_steps_is_exact():
    rng, op, steps = random.Random(5), live.Speeds(), []
    t = 0.0
    for i in range(3000):
        d = rng.choice([33.0, 34.0, 40.0, 7.5, 900.0])
        t += d
        steps.append(d if i else None)
        (_, dt, *_), = op.row(i, t, 0.0)
        good = sorted(x for x in steps if x and 5 <= x <= 200)
        m = len(good)
        if steps[-1] == 900.0 and m:
            assert dt == (good[m // 2] + good[(m - 1) // 2]) / 2000
    assert len(op.counts) == 4


def test_speeds_keep_their_counts_over_batches(spark, tmp_path):
    """A missing step in the last of several batches is repaired by the median of all good steps before it."""
    rng, rows, t = random.Random(3), [], 0.0
    for i in range(200):
        t += 900.0 if i % 37 == 36 else rng.choice([33.0, 34.0, 40.0])
        rows.append(("a", i, t, rng.random()))
    got, _ = run(spark, tmp_path, rows, lambda s: live.trailing_speed(s, n=5))
    op = live.Speeds(n=5)
    want = [x for _, i, t, v in rows for x in op.row(i, t, v)]
    assert sorted((r["frame_index"], round(r["dt"], 9), round(r["mean"], 9), round(r["sd"], 9)) for r in got) == [(r[0], round(r[1], 9), round(r[3], 9), round(r[4], 9)) for r in want]


def test_ticks_of_a_long_gap_come_in_parts():
    """A day between two rows: the frames are bounded, and all ticks are there."""
    op = live.Ticks(30.0)
    runner = live.Live(lambda: op, ["session", "frame_index", "timestamp_ms", "source_frame_index", "value"], "f", "t", "v", False)
    rows = (x for i, t in ((0, 0.0), (1, 86_400_000.0)) for x in op.row(i, t, 1.0))
    sizes = [len(f) for f in runner._frames(("a",), rows)]
    assert max(sizes) <= live.MOST_ROWS and sum(sizes) == 30 * 86_400
