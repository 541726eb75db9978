"""The causal part of the timeline operators on streams of rows, keyed by session.

Each operator keeps a small typed state per session (a held row, a ring of speeds, counts of steps, a decision and the rows it waits
for) in the state store: values, lists, and a map whose entries are changed one by one. So state grows with open sessions and not with
rows, and a batch writes what it changed. Rows of a session that come at or before one already taken are late and dropped.
With an event time, a session is closed by a timer once the watermark (`idle` behind the latest event of all) has passed its own latest
event, and what it held back is given out. On the same rows in order they give what the batch operators give
(tests/test_streaming.py), but for one thing: a missing step is repaired by the median of the session's good steps so far,
as the batch operator's median of the whole session isn't known yet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Most rows of one frame that an operator gives out: a wrong timestamp makes many ticks but no huge frame.
MOST_ROWS = 10_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ticks:
    """Sample-and-hold: a row answers the ticks from its own time until the next row."""

    columns = "timestamp_ms long, source_frame_index long, value double"
    fields, lists, counted = "t0 double, tick long, frame long, value double, last double", {}, False

    def __init__(self, fps: float):
        self.step = 1000.0 / fps
        self.own: tuple | None = None

    def _upto(self, t: float, inclusive: bool) -> Iterator[tuple]:
        t0, tick, frame, value, last = self.own
        while t0 + tick * self.step < t or inclusive and t0 + tick * self.step <= t + 1e-6:
            yield tick, round(t0 + tick * self.step), frame, value
            tick += 1
        self.own = t0, tick, frame, value, last

    def row(self, frame: int, ms: float, value: float | None) -> Iterator[tuple]:
        if self.own is None:
            self.own = ms, 0, frame, value, ms
        yield from self._upto(ms, False)
        self.own = *self.own[:2], frame, value, ms

    def close(self) -> Iterator[tuple]:
        if self.own is not None:
            yield from self._upto(self.own[4], True)


class Speeds:
    """Step repaired by the running median of good steps, speed, and its trailing mean and deviation over n rows.

    The median is exact: good steps are counted by value, in whole microseconds, at most high - low thousands of them. A good step
    changes one count; the counts are read only for a missing one.
    """

    columns = "dt double, speed double, mean double, sd double"
    fields, lists, counted = "ms double, value double", {"ring": "double"}, True

    def __init__(self, n: int = 31, low: float = 5.0, high: float = 200.0):
        self.n, self.low, self.high = n, low, high
        self.own: tuple | None = None
        self.ring: list[float] = []
        self.counts: Any = {}

    def _median(self) -> float:
        """In ms; of no step: 1000 / 30."""
        counts = sorted(self.counts.items())
        total = sum(n for _, n in counts)
        if not total:
            return 1000 / 30
        found, before, wanted = [], 0, [(total + 1) // 2, total // 2 + 1]
        for step, n in counts:
            before += n
            found += [step for k in wanted[len(found) :] if k <= before]
        return sum(found) / 2000

    def row(self, frame: int, ms: float, value: float | None) -> Iterator[tuple]:
        value, moved = 0.0 if value is None else value, 0.0
        d = None if self.own is None else ms - self.own[0]
        good = d is not None and self.low <= d <= self.high
        if good:
            step = round(d * 1000)
            self.counts[step] = self.counts.get(step, 0) + 1
        dt = (d if good else self._median()) / 1000
        if self.own is not None:
            moved = abs(value - self.own[1])
        self.own = ms, value
        self.ring = [*self.ring, moved / dt][-self.n :]
        k, mean = len(self.ring), sum(self.ring) / len(self.ring)
        sd = math.sqrt(sum((x - mean) ** 2 for x in self.ring) / (k - 1)) if k > 1 else 0.0
        yield frame, dt, self.ring[-1], mean, sd

    def close(self) -> Iterator[tuple]:
        return iter(())


class Decisions:
    """Two thresholds with memory, then least durations; a row is given out once its value is settled (on + off rows later at most)."""

    columns = "pred int"
    fields, lists, counted = "now int, in_one boolean, sure boolean", {"one": "long", "zero": "long"}, False

    def __init__(self, low: float, high: float, on: int = 1, off: int = 1):
        self.low, self.high, self.on, self.off = low, high, on, off
        self.own: tuple | None = None
        self.one: list[int] = []
        self.zero: list[int] = []

    def row(self, frame: int, ms: float, value: float | None) -> Iterator[tuple]:
        first = self.own is None
        now, in_one, sure = self.own or (0, False, False)
        if value is not None and not math.isnan(value):
            now = 1 if value >= self.high else 0 if value < self.low else now
        if now:
            if not in_one:
                in_one, sure, self.one = True, first, []
            self.one += [*self.zero, frame]  # a gap that was too short is filled
            self.zero = []
            if sure or len(self.one) >= self.on:
                sure = True
                yield from ((f, 1) for f in self.one)
                self.one = []
        elif not in_one:
            yield frame, 0
        else:
            self.zero.append(frame)
            if len(self.zero) >= self.off:
                yield from self._end()
                in_one, sure = False, False
        self.own = now, in_one, sure

    def _end(self) -> Iterator[tuple]:
        yield from ((f, 0) for f in (*self.one, *self.zero))  # a run that was too short goes with the gap after it
        self.one, self.zero = [], []

    def close(self) -> Iterator[tuple]:
        if self.zero:
            yield from self._end()
        else:
            yield from ((f, 1) for f in self.one)
            self.one = []


class _Counts:
    """A map state as the mapping that Speeds counts in."""

    def __init__(self, state: Any):
        self.state = state

    def get(self, step: int, default: int) -> int:
        return self.state.getValue((step,))[0] if self.state.containsKey((step,)) else default

    def __setitem__(self, step: int, n: int) -> None:
        self.state.updateValue((step,), (n,))

    def items(self) -> Iterator[tuple[int, int]]:
        return ((k[0], v[0]) for k, v in self.state.iterator())


class Live(StatefulProcessor):
    """Runs an operator over a session's rows with its state in the store, and closes the session by a timer."""

    def __init__(self, make: Callable[[], Any], names: list[str], order: str, ms: str, value: str, timed: bool):
        self.make, self.names, self.order, self.ms, self.value, self.timed = make, names, order, ms, value, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, kind = handle, self.make()
        self.at = handle.getValueState("at", "last long, seen long, timer long")
        self.own = handle.getValueState("own", kind.fields)
        self.lists = {name: handle.getListState(name, f"x {t}") for name, t in kind.lists.items()}
        self.counts = handle.getMapState("counts", "step long", "n long") if kind.counted else None

    def _load(self) -> Any:
        op = self.make()
        if self.own.exists():
            op.own = tuple(self.own.get())
        for name, state in self.lists.items():
            setattr(op, name, [x[0] for x in state.get()] if state.exists() else [])
        if self.counts is not None:
            op.counts = _Counts(self.counts)
        return op

    def _save(self, op: Any) -> None:
        if op.own is not None:
            self.own.update(op.own)
        for name, state in self.lists.items():
            values = [(x,) for x in getattr(op, name)]
            state.put(values) if values else state.clear()

    def _frames(self, key: tuple, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while part := list(islice(rows, MOST_ROWS)):
            yield pd.DataFrame([(key[0], *r) for r in part], columns=self.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, seen, timer = self.at.get() if self.at.exists() else (None, None, None)
        op = self._load()

        def taken() -> Iterator[tuple]:
            nonlocal last, seen
            for frame in rows:
                if self.timed and len(frame):
                    seen = max(seen or 0, int(frame["event_ms"].max()))
                for f, t, v in frame.sort_values(self.order)[[self.order, self.ms, self.value]].itertuples(index=False):
                    if last is None or f > last:
                        last = int(f)
                        yield from op.row(int(f), float(t), None if pd.isna(v) else float(v))

        yield from self._frames(key, taken())
        self._save(op)
        if self.timed:  # the watermark is `idle` behind the latest event, so it passes this session's latest once others are that far ahead
            wanted = max(seen, timerValues.getCurrentWatermarkInMs() + 1)
            if wanted != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(wanted)
                timer = wanted
        self.at.update((last, seen, timer))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._frames(key, self._load().close())
        for state in (self.at, self.own, *self.lists.values(), *([] if self.counts is None else [self.counts])):
            state.clear()

    def close(self) -> None:
        pass


def _apply(df: DataFrame, make: Callable[[], Any], columns: str, key: str, order: str, ms: str, value: str, event_time: str | None, idle: str) -> DataFrame:
    """Typed states need the RocksDB state store, which is set for the session."""
    df.sparkSession.conf.set(_STORE, _ROCKSDB)
    schema = f"{key} string, {order} long, {columns}"
    rows = df.select(F.col(key).cast("string").alias(key), order, F.col(ms).cast("double").alias(ms), F.col(value).cast("double").alias(value), *([event_time, F.unix_millis(event_time).alias("event_ms")] if event_time else []))
    if event_time:
        rows = rows.withWatermark(event_time, idle)
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy(key).transformWithStateInPandas(Live(make, names, order, ms, value, bool(event_time)), schema, "Append", "EventTime" if event_time else "None")


def sample_and_hold(df: DataFrame, fps: float, value: str = "value", key: str = "session", order: str = "frame_index", ms: str = "timestamp_ms", event_time: str | None = None, idle: str = "10 minutes") -> DataFrame:
    return _apply(df, lambda: Ticks(fps), Ticks.columns, key, order, ms, value, event_time, idle)


def trailing_speed(df: DataFrame, n: int = 31, value: str = "value", key: str = "session", order: str = "frame_index", ms: str = "timestamp_ms", event_time: str | None = None, idle: str = "10 minutes") -> DataFrame:
    return _apply(df, lambda: Speeds(n), Speeds.columns, key, order, ms, value, event_time, idle)


def decide(df: DataFrame, low: float, high: float, on: int = 1, off: int = 1, score: str = "score", key: str = "session", order: str = "frame_index", ms: str = "timestamp_ms", event_time: str | None = None, idle: str = "10 minutes") -> DataFrame:
    """on = off = 1: the bare hysteresis, each row at once; else with least durations, delayed."""
    return _apply(df, lambda: Decisions(low, high, on, off), Decisions.columns, key, order, ms, score, event_time, idle)
