"""Registered queries over the given tables, each with the DuckDB SQL of the same result where SQL can say it.

Computed doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions import blocks
from tideframe.functions.expr import over
from tideframe.functions.staging import staged
from tideframe.operators import clean, compare, complement, events, experiment, features, folds, long, metrics, models, runs, smoothing, summary, timing, windows
from tideframe.plans.views import POSES, TIMELINE, poses, table, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LOW, HIGH = 0.30, 0.45


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places (and no negative zero), other columns as they are."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def sql(*ctes: str, of: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + of


# -- decisions and runs

HYST = f"""marked AS (SELECT *, CASE WHEN score >= {HIGH} THEN 1 WHEN score < {LOW} THEN 0 END AS mark FROM timeline),
hyst AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame_index ROWS UNBOUNDED PRECEDING), 0) AS pred FROM marked)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.hysteresis(timeline(spark, sf_dir), "score", LOW, HIGH)


@query(sql(TIMELINE, HYST, of="SELECT session, frame_index, pred FROM hyst"))
def hysteresis(spark, sf_dir):
    return predicted(spark, sf_dir).select("session", "frame_index", "pred")


def _filled(source: str, value: int, least: int, name: str) -> str:
    """CTEs that give interior runs of `value` under `least` rows the other value."""
    return f"""{name}_b AS (SELECT *, CASE WHEN lag(pred) OVER w IS NOT DISTINCT FROM pred THEN 0 ELSE 1 END AS b FROM {source} WINDOW w AS (PARTITION BY session ORDER BY frame_index)),
{name}_r AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS run FROM {name}_b),
{name}_n AS (SELECT *, count(*) OVER (PARTITION BY session, run) AS n, max(run) OVER (PARTITION BY session) AS last FROM {name}_r),
{name} AS (SELECT session, participant, source, frame_index, timestamp_ms, label, score, y, scored, hand_detected,
           CASE WHEN pred = {value} AND n < {least} AND run > 1 AND run < last THEN {1 - value} ELSE pred END AS pred FROM {name}_n)"""


SMOOTH = ",\n".join([HYST, _filled("hyst", 0, 3, "fill"), _filled("fill", 1, 3, "smooth")])


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.least_durations(predicted(spark, sf_dir), "pred", 3, 3)


@query(sql(TIMELINE, SMOOTH, of="SELECT session, frame_index, pred FROM smooth"))
def min_durations(spark, sf_dir):
    return smoothed(spark, sf_dir).select("session", "frame_index", "pred")


def _runs_sql(source: str, value: str, name: str, keys: str = "session") -> str:
    return f"""{name}_p AS (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN lag({value}) OVER w IS NOT DISTINCT FROM {value} AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY frame_index)),
{name}_q AS (SELECT *, sum(b) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS run FROM {name}_p),
{name}_g AS (SELECT {keys}, run, {value} AS v, min(pos) AS s, max(pos) + 1 AS e, count(*) AS n FROM {name}_q GROUP BY ALL),
{name} AS (SELECT *, max(run) OVER (PARTITION BY {keys}) AS last FROM {name}_g)"""


CUT = """cut_a AS (SELECT *, CASE WHEN scored AND NOT coalesce(lag(scored) OVER (PARTITION BY session ORDER BY frame_index), true) THEN 1 ELSE 0 END AS again FROM {0}),
cut_s AS (SELECT *, sum(again) OVER (PARTITION BY session ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS sub FROM cut_a),
cut AS (SELECT * FROM cut_s WHERE scored)"""


@query(sql(TIMELINE, CUT.format("timeline"), of="SELECT session, frame_index, CAST(sub AS BIGINT) AS sub, y FROM cut"))
def split_unscored(spark, sf_dir):
    return runs.split_unscored(timeline(spark, sf_dir)).select("session", "frame_index", "sub", "y")


@query(sql(TIMELINE, _runs_sql("timeline", "y", "r"), of="SELECT session, s AS start, e AS \"end\" FROM r WHERE v = 1 AND n >= 3"))
def find_events(spark, sf_dir):
    return runs.events(timeline(spark, sf_dir), "y")


@query(sql(TIMELINE, _runs_sql("timeline", "y", "r"), of="SELECT session, s AS start, e AS \"end\" FROM r WHERE v = 0 AND n >= 2 AND run > 0 AND run < last"))
def interior_pauses(spark, sf_dir):
    return runs.pauses(timeline(spark, sf_dir), "y", least=2)


@query(sql(TIMELINE, of="SELECT source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY session, frame_index) - 1) / 500) AS BIGINT) AS chunk, session, frame_index FROM timeline"))
def chunked_sessions(spark, sf_dir):
    rows = blocks.dealt(timeline(spark, sf_dir).select("source", "session", "frame_index"), "source", ["session", "frame_index"])
    return long.chunked(rows, 500, "source").select("source", "chunk", "session", "frame_index")


_G = []
for _n, _c in (("runs", "v = 'writing'"), ("pauses", "v = 'not_writing' AND before = 'writing' AND after = 'writing'")):
    _v = f"CASE WHEN {_c} THEN ms END"
    _G += [f"count({_v}) AS n_{_n}"] + [f"CAST(round_even(quantile_cont({_v}, {q / 100}), 0) AS BIGINT) AS {_n}_p{q}" for q in (10, 25, 50, 75, 90)]
    _G += [f"round(avg(CASE WHEN {_v} IS NULL THEN NULL WHEN {_v} < {t} THEN 1.0 ELSE 0.0 END), 4) AS {_n}_under_{t}" for t in (167, 400)]


@query(sql(
    TIMELINE, _runs_sql("timeline", "label", "r"),
    "d AS (SELECT session, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session ORDER BY frame_index) AS dt FROM timeline)",
    "m AS (SELECT session, coalesce(quantile_cont(dt, 0.5), 1000.0 / 30) AS step FROM d GROUP BY session)",
    "x AS (SELECT r.*, n * step AS ms, lag(v) OVER (PARTITION BY r.session ORDER BY run) AS before, lead(v) OVER (PARTITION BY r.session ORDER BY run) AS after FROM r JOIN m USING (session))",
    of=f"SELECT {', '.join(_G)}, CAST(sum(CASE WHEN v = 'unsure' THEN n ELSE 0 END) AS BIGINT) AS unsure_rows FROM x",
))
def label_granularity(spark, sf_dir):
    return runs.granularity(timeline(spark, sf_dir))


# -- events against events

EVENTS = ",\n".join([CUT.format("hyst"), _runs_sql("cut", "y", "t", "session, sub"), _runs_sql("cut", "pred", "p", "session, sub"), """ti AS (SELECT *, row_number() OVER (PARTITION BY session, sub ORDER BY s) - 1 AS i FROM t WHERE v = 1 AND n >= 1),
pj AS (SELECT *, row_number() OVER (PARTITION BY session, sub ORDER BY s) - 1 AS j FROM p WHERE v = 1 AND n >= 1),
pairs AS (SELECT ti.session, ti.sub, i, j, ti.s AS ts, ti.e AS te, pj.s AS ps, pj.e AS pe, (least(ti.e, pj.e) - greatest(ti.s, pj.s))::DOUBLE / (greatest(ti.e, pj.e) - least(ti.s, pj.s)) AS iou
  FROM ti JOIN pj ON ti.session = pj.session AND ti.sub = pj.sub AND ti.s < pj.e AND pj.s < ti.e)"""])


def cut_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    cut = runs.split_unscored(predicted(spark, sf_dir))
    k = ["session", "sub"]
    return runs.events(cut, "y", k, least=1), runs.events(cut, "pred", k, least=1), k


@query(sql(TIMELINE, HYST, EVENTS, of="""SELECT ti.session, CAST(ti.sub AS BIGINT) AS sub, CAST(ti.i AS INTEGER) AS i, count(pairs.j) AS n
FROM ti LEFT JOIN pairs ON ti.session = pairs.session AND ti.sub = pairs.sub AND ti.i = pairs.i GROUP BY ALL"""))
def event_fragments(spark, sf_dir):
    t, p, k = cut_events(spark, sf_dir)
    n = events.overlapping(t, p, k).groupBy(*k, "i").agg(F.count(F.lit(1)).alias("n"))
    return events.numbered(t, k, "i").join(n, [*k, "i"], "left").select(*k, "i", F.coalesce("n", F.lit(0)).alias("n"))


@query(sql(TIMELINE, HYST, EVENTS, of="SELECT ti.session, CAST(ti.sub AS BIGINT) AS sub, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(pj.s - ti.s AS BIGINT) AS delay FROM ti JOIN pj ON ti.session = pj.session AND ti.sub = pj.sub AND abs(ti.s - pj.s) <= 2"))
def onset_candidates(spark, sf_dir):
    t, p, k = cut_events(spark, sf_dir)
    return events.near_onsets(t, p, 2, k).select(*k, "i", "j", F.col("delay").cast("long").alias("delay"))


@query(sql(TIMELINE, HYST, _runs_sql("timeline", "y", "t"), _runs_sql("hyst", "pred", "p"), "x AS (SELECT unnest([5, 10, 12]) AS tolerance)", of="""
SELECT t.session, CAST(x.tolerance AS INTEGER) AS tolerance, CAST(t.s AS BIGINT) AS t_start, CAST(p.s AS BIGINT) AS p_start, CAST(abs(t.s - p.s) + abs(t.e - p.e) AS BIGINT) AS error
FROM t JOIN p USING (session), x WHERE t.v = 0 AND t.n >= 2 AND t.run > 0 AND t.run < t.last AND p.v = 0 AND p.n >= 2 AND p.run > 0 AND p.run < p.last AND abs(t.s - p.s) <= tolerance AND abs(t.e - p.e) <= tolerance"""))
def pause_candidates(spark, sf_dir):
    rows = predicted(spark, sf_dir)
    pairs = events.near_bounds(runs.pauses(rows, "y", least=2), runs.pauses(rows, "pred", least=2))
    return pairs.select("session", "tolerance", F.col("t_start").cast("long").alias("t_start"), F.col("p_start").cast("long").alias("p_start"), F.col("error").cast("long").alias("error"))


SEGMENTS = ",\n".join([CUT.format("hyst"), _runs_sql("cut", "y", "t", "source, session, sub"), _runs_sql("cut", "pred", "p", "source, session, sub")])


@query(sql(TIMELINE, HYST, SEGMENTS, """a AS (SELECT source, session, sub, string_agg(CAST(v AS VARCHAR), '' ORDER BY run) AS w, count(*) AS n FROM t GROUP BY ALL),
b AS (SELECT source, session, sub, string_agg(CAST(v AS VARCHAR), '' ORDER BY run) AS w, count(*) AS n FROM p GROUP BY ALL)""",
    of="SELECT source, round(avg(1 - levenshtein(a.w, b.w)::DOUBLE / greatest(a.n, b.n)), 4) AS edit_score FROM a JOIN b USING (source, session, sub) GROUP BY source"))
def edit_score(spark, sf_dir):
    return events.segment_metrics(runs.split_unscored(predicted(spark, sf_dir)), "y", "pred", group="source", keys=["session", "sub"]).select("source", "edit_score")


_HITS = ", ".join(f"coalesce(sum(CASE WHEN iou >= {o} THEN 1 ELSE 0 END), 0) AS h{round(o * 100)}" for o in (0.1, 0.25, 0.5))


@query(sql(TIMELINE, HYST, SEGMENTS, """o AS (SELECT t.source, t.session, t.sub, t.run AS i, p.run AS j, (least(t.e, p.e) - greatest(t.s, p.s))::DOUBLE / (greatest(t.e, p.e) - least(t.s, p.s)) AS iou
  FROM t JOIN p ON t.source = p.source AND t.session = p.session AND t.sub = p.sub AND t.v = p.v AND t.s < p.e AND p.s < t.e),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, session, sub, j ORDER BY iou DESC, i) AS rn FROM o) WHERE rn = 1),
hit AS (SELECT source, session, sub, i, max(iou) AS iou FROM best GROUP BY ALL)""", f"h AS (SELECT source, {_HITS} FROM hit GROUP BY source)", "nt AS (SELECT source, count(*) AS n FROM t GROUP BY source)", "np AS (SELECT source, count(*) AS n FROM p GROUP BY source)",
    of="SELECT source, " + ", ".join(f"round(2.0 * h{k} / (nt.n + np.n), 4) AS seg_f1_{k}" for k in (10, 25, 50)) + " FROM nt JOIN np USING (source) JOIN h USING (source)"))
def segmental_f1(spark, sf_dir):
    out = events.segment_metrics(runs.split_unscored(predicted(spark, sf_dir)), "y", "pred", group="source", keys=["session", "sub"])
    return out.select("source", "seg_f1_10", "seg_f1_25", "seg_f1_50")


# -- clocks

HOUR = 3_600_000


@query(sql(TIMELINE, """b AS (SELECT session, min(timestamp_ms) AS t0, max(timestamp_ms) AS t1 FROM timeline GROUP BY session),
g AS (SELECT session, t0, unnest(generate_series(0, CAST(floor((t1 + 1e-6 - t0) / 3600000.0) AS BIGINT))) AS tick FROM b),
c AS (SELECT session, tick, t0 + tick * 3600000 AS at FROM g)""",
    of="""SELECT session, frame_index, timestamp_ms, source_frame_index, value FROM (
  SELECT c.session, c.tick AS frame_index, c.at AS timestamp_ms, t.frame_index AS source_frame_index, round(t.value, 6) AS value,
         row_number() OVER (PARTITION BY c.session, c.tick ORDER BY t.frame_index DESC) AS rn
  FROM c JOIN timeline t ON t.session = c.session AND t.timestamp_ms <= c.at) WHERE rn = 1"""))  # fmt: skip
def asof_resample(spark, sf_dir):
    return timing.resample(timeline(spark, sf_dir).select("session", "frame_index", "timestamp_ms", F.round("value", 6).alias("value")), 1000 / HOUR)


@query(sql(TIMELINE, "d AS (SELECT session, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session ORDER BY frame_index) AS dt FROM timeline)",
    of="SELECT session, round(1000000000.0 / quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5), 6) AS uhz FROM d GROUP BY session"))
def session_fps(spark, sf_dir):
    return rounded(timing.session_fps(timeline(spark, sf_dir)).select("session", (F.col("fps") * 1e6).alias("uhz")))


@query(sql(TIMELINE, "d AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session ORDER BY frame_index) AS d0 FROM timeline)",
    f"g AS (SELECT *, CASE WHEN d0 BETWEEN 60000 AND {24 * HOUR} THEN d0 END AS good FROM d)", "m AS (SELECT session, coalesce(quantile_cont(good, 0.5), 1000.0 / 30) AS m FROM g GROUP BY session)",
    of=f"SELECT session, frame_index, round(greatest(least(coalesce(good, m), {24 * HOUR}), 60000) / 1000.0, 6) AS dt, good IS NULL AS dt_repaired FROM g JOIN m USING (session)"))
def dt_repair(spark, sf_dir):
    return rounded(timing.repaired_steps(timeline(spark, sf_dir), low=60_000, high=24 * HOUR).select("session", "frame_index", "dt", "dt_repaired"))


# -- motion and pose


def stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.repaired_steps(poses(spark, sf_dir))


STEPS = """pd AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session ORDER BY frame_index) AS d0 FROM poses),
pg AS (SELECT *, CASE WHEN d0 BETWEEN 5 AND 200 THEN d0 END AS good FROM pd),
pm AS (SELECT session, coalesce(quantile_cont(good, 0.5), 1000.0 / 30) AS m FROM pg GROUP BY session),
st AS (SELECT pg.*, greatest(least(coalesce(good, m), 200), 5) / 1000.0 AS dt FROM pg JOIN pm USING (session))"""
SCALE = """sq AS (SELECT *, sqrt((l9_x - l0_x) * (l9_x - l0_x) + (l9_y - l0_y) * (l9_y - l0_y)) AS d90 FROM st),
sm AS (SELECT quantile_cont(CASE WHEN hand_detected = 1 AND d90 > 1e-6 THEN d90 END, 0.5) AS mid FROM sq),
sc AS (SELECT sq.*, CASE WHEN hand_detected = 1 AND d90 > 1e-6 THEN d90 ELSE mid END AS scale FROM sq, sm)"""


def _speed(x: str, y: str) -> str:
    seen = lambda c: f"CASE WHEN hand_detected = 1 THEN {c} END"
    d = lambda c: f"({seen(c)} - lag({seen(c)}) OVER (PARTITION BY session ORDER BY frame_index))"
    return f"coalesce(sqrt({d(x)} * {d(x)} + {d(y)} * {d(y)}) / dt, 0)"


@query(sql(POSES, STEPS, SCALE, of="SELECT session, frame_index, round(scale, 6) AS scale FROM sc"))
def hand_scale(spark, sf_dir):
    return rounded(features.hand_scale(stepped(spark, sf_dir)).select("session", "frame_index", "scale"))


MOTION = f"mo AS (SELECT session, frame_index, {_speed('l8_x / scale', 'l8_y / scale')} AS tip, {_speed('l0_x / scale', 'l0_y / scale')} AS wrist FROM sc)"
_W = "OVER (PARTITION BY session ORDER BY frame_index ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"


@query(sql(POSES, STEPS, SCALE, MOTION, of="SELECT session, frame_index, round(tip, 5) AS mot_tip_speed, round(wrist, 5) AS mot_wrist_speed FROM mo"))
def point_speed(spark, sf_dir):
    return rounded(features.motion(features.hand_scale(stepped(spark, sf_dir))).select("session", "frame_index", "mot_tip_speed", "mot_wrist_speed"), 5)


def _rolled(causal: bool) -> str:
    frame = lambda n: _W.format(n - 1, 0) if causal else _W.format(n // 2, (n - 1) // 2)
    return ", ".join([f"round(avg({p}) {frame(n)}, 4) AS mot_{p}_speed_m{n}" for p in ("tip", "wrist") for n in features.MEANS] + [f"round(coalesce(stddev_samp({p}) {frame(n)}, 0), 4) AS mot_{p}_speed_sd{n}" for p in ("tip", "wrist") for n in features.DEVIATIONS])


_ROLLED = [f"mot_{p}_speed_{n}" for p in ("tip", "wrist") for n in ("m5", "m15", "m31", "sd15", "sd31")]


@query(sql(POSES, STEPS, SCALE, MOTION, of=f"SELECT session, frame_index, {_rolled(True)} FROM mo"))
def rolling_motion(spark, sf_dir):
    return rounded(features.motion(features.hand_scale(stepped(spark, sf_dir))).select("session", "frame_index", *_ROLLED), 4)


@query(sql(POSES, STEPS, SCALE, MOTION, of=f"SELECT session, frame_index, {_rolled(False)} FROM mo"))
def centred_motion(spark, sf_dir):
    return rounded(features.motion(features.hand_scale(stepped(spark, sf_dir)), causal=False).select("session", "frame_index", *_ROLLED), 4)


def _dist(i: int, j: int = 0) -> str:
    return f"sqrt((l{i}_x - l{j}_x) * (l{i}_x - l{j}_x) + (l{i}_y - l{j}_y) * (l{i}_y - l{j}_y))"


@query(sql(POSES, STEPS, f"ru AS (SELECT *, {_speed('l8_x', 'l8_y')} AS raw FROM st)", of=f"""SELECT session, frame_index, round(avg(raw) {_W.format(2, 2)}, 5) AS heur_speed,
round(CASE WHEN hand_detected = 1 AND {_dist(9)} > 0 THEN ({_dist(8)} - ({_dist(12)} + {_dist(16)} + {_dist(20)}) / 3) / {_dist(9)} ELSE 0 END, 5) AS heur_extension FROM ru"""))
def rule_signals(spark, sf_dir):
    return rounded(features.rule_signals(stepped(spark, sf_dir)).select("session", "frame_index", "heur_speed", "heur_extension"), 5)


_SPAN = "greatest(" + ", ".join(f"(l{i}_x - l0_x) * (l{i}_x - l0_x) + (l{i}_y - l0_y) * (l{i}_y - l0_y) + (l{i}_z - l0_z) * (l{i}_z - l0_z)" for i in range(21)) + ")"
_NORMAL = f"no AS (SELECT session, frame_index, handedness, CASE WHEN {_SPAN} > 0 THEN sqrt({_SPAN}) ELSE 1 END AS span, " + ", ".join(f"l{i}_{a} - l0_{a} AS l{i}_{a}" for i in range(21) for a in "xyz") + " FROM poses)"
_SHOWN = [f"l{i}_{a}" for i in (0, 4, 8, 20) for a in "xyz"]


@query(sql(POSES, _NORMAL, of="SELECT session, frame_index, " + ", ".join(f"round({c} / span, 6) + 0.0 AS {c}" for c in _SHOWN) + " FROM no"))
def wrist_normalise(spark, sf_dir):
    rows = poses(spark, sf_dir)
    return rounded(features.wrist_normalised(rows, features.landmarks(rows.columns)).select("session", "frame_index", *_SHOWN))


@query(sql(POSES, _NORMAL, of="SELECT session, frame_index, " + ", ".join(f"round({f'CASE WHEN handedness = {chr(39)}Left{chr(39)} THEN -{c} ELSE {c} END' if c.endswith('x') else c} / span, 6) + 0.0 AS {c}" for c in _SHOWN) + " FROM no"))
def mirror_pose(spark, sf_dir):
    rows = poses(spark, sf_dir)
    points = features.landmarks(rows.columns)
    return rounded(features.canonical_hand(features.wrist_normalised(rows, points), points).select("session", "frame_index", *_SHOWN))


@query(sql(POSES, of="SELECT session, frame_index, " + ", ".join(f"round(coalesce({c} - lag({c}) OVER (PARTITION BY session ORDER BY frame_index), 0), 6) + 0.0 AS d_{c}" for c in _SHOWN) + " FROM poses"))
def velocity_deltas(spark, sf_dir):
    rows = poses(spark, sf_dir)
    return rounded(features.velocities(rows, features.landmarks(rows.columns)).select("session", "frame_index", *(f"d_{c}" for c in _SHOWN)))


@query(sql(POSES, of="SELECT session, frame_index, " + ", ".join(f"round(CASE WHEN hand_detected = 1 THEN l{i}_x * aspect ELSE l{i}_x END, 6) AS l{i}_x" for i in (0, 8)) + " FROM poses"))
def aspect_correction(spark, sf_dir):
    return rounded(clean.correct_aspect(poses(spark, sf_dir), ["l0_x", "l8_x"]).select("session", "frame_index", "l0_x", "l8_x"))


# -- windows


def _windows_sql(mode: str) -> str:
    target = "y" if mode == "last" else "CASE WHEN 2 * pos > votes THEN 1 ELSE 0 END"
    return sql(TIMELINE, """w AS (SELECT *, row_number() OVER o AS n, sum(CASE WHEN scored THEN y ELSE 0 END) OVER b AS pos, sum(CASE WHEN scored THEN 1 ELSE 0 END) OVER b AS votes, sum(CAST(k AS BIGINT)) OVER b AS total, list(k) OVER b AS ks
  FROM timeline WINDOW o AS (PARTITION BY session ORDER BY frame_index), b AS (PARTITION BY session ORDER BY frame_index ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))""",
        of=f"SELECT session, frame_index AS end_index, {target} AS y, CAST(total AS BIGINT) AS total, ks[1] AS first FROM w WHERE n >= 8 AND (n - 8) % 3 = 0 AND scored")


def _windows(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    out = windows.sliding(timeline(spark, sf_dir), ["k", "score"], 8, 3, mode)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]).cast("long")
    return out.select("session", "end_index", "y", total.alias("total"), F.col("window")[0][0].cast("int").alias("first"))


@query(_windows_sql("last"))
def sliding_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "last")


@query(_windows_sql("majority"))
def majority_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "majority")


@query(sql(TIMELINE, "e AS (SELECT session, frame_index AS end_index, k, lead(frame_index) OVER (PARTITION BY session ORDER BY frame_index) AS nx FROM timeline WHERE frame_index >= 7 AND (frame_index - 7) % 3 = 0 AND scored)",
    of="SELECT session, k AS score, unnest(generate_series(end_index, coalesce(nx, end_index + 1) - 1)) AS frame_index FROM e"))
def hold_windows(spark, sf_dir):
    wins = windows.sliding(timeline(spark, sf_dir), ["k"], 8, 3).select("session", "end_index", F.element_at("window", -1)[0].cast("int").alias("score"))
    return windows.held(wins, "score")


# -- frame metrics by participant fold

COUNTS = "count(*) FILTER (WHERE y = 1 AND p) AS tp, count(*) FILTER (WHERE y = 0 AND p) AS fp, count(*) FILTER (WHERE y = 1 AND NOT p) AS fn, count(*) FILTER (WHERE y = 0 AND NOT p) AS tn"
RATES = """round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(5.0 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2,
round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / (CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END), 6) AS f1_macro"""
RATE_NAMES = ["accuracy", "precision", "recall", "f1", "f2", "f1_macro"]
SCORED = "sr AS (SELECT *, score >= 0.5 AS p FROM timeline WHERE scored)"


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).where("scored")


@query(sql(TIMELINE, SCORED, f"c AS (SELECT participant, {COUNTS} FROM sr GROUP BY participant)", of=f"SELECT participant, tp, fp, fn, tn, {RATES} FROM c"))
def confusion_by_fold(spark, sf_dir):
    return rounded(metrics.evaluate(scored_rows(spark, sf_dir), "y", "score", 0.5, "participant").select("participant", "tp", "fp", "fn", "tn", *RATE_NAMES))


@query(sql(TIMELINE, SCORED, f"c AS (SELECT participant, CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(hand_detected) = 0 THEN 'hand_detected' ELSE 'all' END AS slice, coalesce(CAST(source AS VARCHAR), CAST(hand_detected AS VARCHAR), 'all') AS value, {COUNTS} FROM sr GROUP BY GROUPING SETS ((participant), (participant, source), (participant, hand_detected)))",
    "d AS (SELECT *, count(*) OVER (PARTITION BY participant, slice) AS m FROM c)", of="SELECT participant, slice, value, tp, fp, fn, tn FROM d WHERE slice = 'all' OR m > 1"))
def metric_grouping_sets(spark, sf_dir):
    return metrics.slices(scored_rows(spark, sf_dir), "y", F.col("score") >= 0.5, "participant", ["source", "hand_detected"]).select("participant", "slice", "value", "tp", "fp", "fn", "tn")


CURVE = """sv AS (SELECT participant, score AS s, sum(y) AS p, sum(1 - y) AS q FROM timeline WHERE scored GROUP BY ALL),
cv AS (SELECT *, sum(p) OVER d AS tp, sum(q) OVER d AS fp, sum(p) OVER (PARTITION BY participant) AS np, sum(q) OVER (PARTITION BY participant) AS nq FROM sv WINDOW d AS (PARTITION BY participant ORDER BY s DESC))"""


@query(sql(TIMELINE, CURVE, of="SELECT participant, round(CASE WHEN max(np) > 0 AND max(nq) > 0 THEN sum((tp - p / 2.0) * q) / max(np) / max(nq) END, 6) AS roc_auc FROM cv GROUP BY participant"))
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored_rows(spark, sf_dir), "y", "score", "participant"))


@query(sql(TIMELINE, CURVE, of="SELECT participant, round(CASE WHEN max(np) > 0 THEN sum(p * tp / (tp + fp)) / max(np) ELSE 0 END, 6) AS average_precision FROM cv GROUP BY participant"))
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(scored_rows(spark, sf_dir), "y", "score", "participant"))


@query(sql(TIMELINE, """q AS (SELECT participant, unnest(quantile_cont(score, [0.01 + 0.98 * i / 38.0 for i in range(39)])) AS t FROM timeline WHERE scored GROUP BY participant),
u AS (SELECT DISTINCT * FROM q),
c AS (SELECT u.participant, t, sum(CASE WHEN score >= t AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN 1 ELSE 0 END) AS pp, sum(y) AS pos FROM u JOIN timeline l ON l.participant = u.participant AND l.scored GROUP BY ALL),
f AS (SELECT *, 2.0 * tp / (pp + pos) AS f FROM c)""", of="SELECT participant, round(t, 6) AS threshold, round(f, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY round(f, 12) DESC, t) AS rn FROM f) WHERE rn = 1"))
def threshold_fit(spark, sf_dir):
    return rounded(metrics.fit_threshold(scored_rows(spark, sf_dir), "y", "score", "participant", steps=39))


# -- folds

FOLDS_SQL = """us AS (SELECT CAST(participant AS VARCHAR) AS unit, count(*) AS n, sum(y) AS pos FROM timeline GROUP BY participant),
nu AS (SELECT unit, row_number() OVER (ORDER BY unit) AS fold_no FROM us),
lo AS (SELECT format('fold{:02d}_{}', fold_no, nu.unit) AS fold, CAST(fold_no AS INTEGER) AS fold_no, us.unit, CASE WHEN us.unit = nu.unit THEN 'test' ELSE 'train' END AS split FROM nu, us)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.unit_table(timeline(spark, sf_dir))


@query(sql(TIMELINE, FOLDS_SQL, of="SELECT fold, fold_no, unit, split FROM lo"))
def lopo_folds(spark, sf_dir):
    return folds.leave_one_out(units(spark, sf_dir))


VAL = """pl AS (SELECT fold, lo.unit, n, pos FROM lo JOIN us ON lo.unit = us.unit WHERE split = 'train'),
wh AS (SELECT fold, sum(n) AS tn, sum(pos) AS tp FROM pl GROUP BY fold),
cb AS (SELECT a.fold, a.unit AS u1, b.unit AS u2, a.n + b.n AS n, a.pos + b.pos AS pos, tn, tp FROM pl a JOIN pl b ON a.fold = b.fold AND a.unit < b.unit JOIN wh ON wh.fold = a.fold),
sc AS (SELECT *, round(abs(pos / n - tp / tn) + 0.5 * abs(n / tn - 0.15), 12) AS s FROM cb WHERE pos > 0 AND pos < n AND tp - pos > 0 AND tp - pos < tn - n),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY s, u1, u2) AS rn FROM sc) WHERE rn = 1),
vf AS (SELECT lo.fold, fold_no, unit, CASE WHEN split = 'train' AND (unit = u1 OR unit = u2) THEN 'val' ELSE split END AS split FROM lo LEFT JOIN bs ON bs.fold = lo.fold)"""


def lopo_with_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = staged(units(spark, sf_dir), "units")
    return folds.expanded(staged(folds.held_with_validation(folds.held_one_out(u), u), "held"), u)


@query(sql(TIMELINE, FOLDS_SQL, VAL, of="SELECT * FROM vf"))
def val_selection(spark, sf_dir):
    return lopo_with_validation(spark, sf_dir)


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fold holds back; the rest trains."""
    u = staged(units(spark, sf_dir), "units")
    return staged(folds.held_with_validation(folds.held_one_out(u), u), "held")


@query(sql(TIMELINE, FOLDS_SQL, VAL, of="SELECT fold, split, count(*) AS rows, round(avg(CASE WHEN scored THEN y END), 6) AS prior, round(avg(hand_detected), 6) AS detection_rate, count(DISTINCT participant) AS n_units FROM vf JOIN timeline ON unit = CAST(participant AS VARCHAR) GROUP BY fold, split"))
def fold_priors(spark, sf_dir):
    return rounded(complement.fold_record(timeline(spark, sf_dir), held(spark, sf_dir)))


@query(sql(TIMELINE, FOLDS_SQL, "x AS (SELECT fold, participant, CASE WHEN split = 'train' AND frame_index < 5 AND fold_no % 2 = 0 THEN 'val' ELSE split END AS split FROM lo JOIN timeline ON unit = CAST(participant AS VARCHAR))",
    "g AS (SELECT fold, participant, count(DISTINCT split) AS k, count(*) AS n FROM x GROUP BY fold, participant)", of="SELECT fold, count(*) FILTER (WHERE k > 1) AS n_leaking, round(sum(CASE WHEN k > 1 THEN n ELSE 0 END) / sum(n), 6) AS share FROM g GROUP BY fold"))
def leakage_audit(spark, sf_dir):
    """Every second fold takes the first rows of training units for val: all units with later rows too leak, but the one that it tests."""
    early = (F.col("frame_index") < 5).alias("early")
    parts = timeline(spark, sf_dir).groupBy(F.col("participant").cast("string").alias("unit"), early.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    rules = spark.createDataFrame([(0, 0, "train"), (0, 1, "val"), (1, 0, "train"), (1, 1, "train")], "rule int, part int, split string")
    tests = folds.held_one_out(units(spark, sf_dir)).withColumn("rule", F.col("fold_no") % 2)
    return rounded(complement.leakage(parts, rules, tests))


# -- cleaning


@query(sql(TIMELINE, of="SELECT concat(source, ':', participant) AS participant, concat(source, ':', session) AS session, frame_index FROM timeline"))
def combine_namespaced(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    parts = {str(s): rows.where(F.col("source") == s).drop("source") for s in range(3)}
    return clean.combined(parts, dict.fromkeys(parts, ["score"])).select("participant", "session", "frame_index")


@query(sql(TIMELINE, of="SELECT source, count(DISTINCT session) AS sessions, count(DISTINCT participant) AS participants, count(*) AS rows, count(*) FILTER (WHERE scored) AS scored_rows, count(*) FILTER (WHERE hand_detected = 0) AS no_hand_rows, round(avg(y), 4) AS writing_share, count(*) FILTER (WHERE label = 'writing') AS writing_rows, count(*) FILTER (WHERE label = 'not_writing') AS not_writing_rows, count(*) FILTER (WHERE label = 'unsure') AS unsure_rows FROM timeline GROUP BY source"))
def corpus_profile(spark, sf_dir):
    return clean.profile(timeline(spark, sf_dir), "source")


@query(sql(TIMELINE, of="SELECT session, frame_index, label FROM timeline WHERE participant NOT IN (1, 4)"))
def exclude_participants(spark, sf_dir):
    return clean.exclude(timeline(spark, sf_dir).withColumn("participant", F.col("participant").cast("string")), ["1", "4"]).select("session", "frame_index", "label")


@query("""WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 640 END AS width, 480 AS height, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1.5 END AS aspect, CASE WHEN c_custkey % 2 = 0 THEN 1.25 END AS legacy FROM customer)
SELECT c_custkey, round(CASE WHEN width <> 0 THEN width / height WHEN aspect IS NOT NULL THEN aspect ELSE legacy END, 6) AS aspect, CASE WHEN width <> 0 THEN 'size' WHEN aspect IS NOT NULL THEN 'aspect' WHEN legacy IS NOT NULL THEN 'legacy' ELSE 'unknown' END AS aspect_from FROM m""")
def aspect_resolution(spark, sf_dir):
    k = F.col("c_custkey")
    size = F.when(k % 3 == 0, 0).otherwise(640)
    aspect, origin = clean.resolved_aspect(size, F.lit(480), F.when(k % 5 == 0, F.lit(None)).otherwise(1.5), F.when(k % 2 == 0, 1.25))
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", aspect.alias("aspect"), origin.alias("aspect_from")))


# -- results over folds

RESULTS = f"""mr AS (SELECT source AS dataset, participant AS fold, m.model, y, CASE m.model WHEN 'value' THEN score >= 0.45 WHEN 'k' THEN k >= 40 WHEN 'both' THEN score + k / 100.0 >= 0.9 ELSE true END AS p
  FROM timeline, (SELECT unnest(['value', 'k', 'both', 'always']) AS model) m WHERE scored),
rc AS (SELECT dataset, fold, model, {COUNTS} FROM mr GROUP BY ALL),
rs AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM rc)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four simple detectors on every participant of every source: a results table with a row for each fold."""
    rows = scored_rows(spark, sf_dir)
    decide = F.create_map(F.lit("value"), F.col("score") >= 0.45, F.lit("k"), F.col("k") >= 40, F.lit("both"), F.col("score") + F.col("k") / 100 >= 0.9, F.lit("always"), F.lit(True))
    rows = rows.select(F.col("source").alias("dataset"), F.col("participant").alias("fold"), "y", F.explode(decide).alias("model", "p"))
    return metrics.rates(metrics.confusion(rows, "y", F.col("p"), ["dataset", "fold", "model"])).withColumn("train_seconds", F.lit(0.0))


@query(sql(TIMELINE, RESULTS, of="SELECT dataset, model, count(*) AS n_folds, round(avg(f1), 6) AS f1_mean, round(coalesce(stddev_samp(f1), 0), 6) AS f1_std, round(min(f1), 6) AS f1_min, round(max(f1), 6) AS f1_max, round(avg(accuracy), 6) AS accuracy_mean, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn FROM rs GROUP BY dataset, model"))
def fold_summary(spark, sf_dir):
    rows = results(spark, sf_dir)
    s = summary.over_folds(rows, ["f1", "accuracy"], ["dataset", "model"]).join(summary.pooled_confusion(rows, ["dataset", "model"]), ["dataset", "model"])
    return rounded(s.select("dataset", "model", "n_folds", "f1_mean", "f1_std", "f1_min", "f1_max", "accuracy_mean", "tp", "tn"))


@query(sql(TIMELINE, RESULTS, "l AS (UNPIVOT (SELECT dataset, model, f1, accuracy FROM rs) ON f1, accuracy INTO NAME metric VALUE value)", of="SELECT dataset, model, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n FROM l GROUP BY ALL"))
def metric_summary(spark, sf_dir):
    return rounded(summary.timeline_summary(results(spark, sf_dir), ["f1", "accuracy"], ["dataset", "model"]))


@query(sql(TIMELINE, "pr AS (SELECT source AS dataset, participant, avg(y) AS p FROM timeline WHERE scored GROUP BY ALL)", of="SELECT dataset, count(*) AS n_folds, round(avg(2 * p / (1 + p)), 6) AS f1_mean, round(avg(5 * p / (4 * p + 1)), 6) AS f2_mean, round(avg(p), 6) AS accuracy_mean FROM pr GROUP BY dataset"))
def always_positive(spark, sf_dir):
    priors = scored_rows(spark, sf_dir).groupBy(F.col("source").alias("dataset"), "participant").agg(F.avg("y").alias("prior"))
    return rounded(summary.always_positive(priors).select("dataset", "n_folds", "f1_mean", "f2_mean", "accuracy_mean"))


@query(sql(TIMELINE, RESULTS, "s AS (SELECT dataset, model, avg(f1) AS f1 FROM rs GROUP BY ALL)", of="SELECT model, round(max(f1) FILTER (WHERE dataset = 0), 6) AS \"0\", round(max(f1) FILTER (WHERE dataset = 1), 6) AS \"1\", round(max(f1) FILTER (WHERE dataset = 2), 6) AS \"2\" FROM s GROUP BY model"))
def rank_pivot(spark, sf_dir):
    s = results(spark, sf_dir).groupBy("dataset", "model").agg(F.avg("f1").alias("f1"))
    return rounded(compare.matrix(s.withColumn("dataset", F.col("dataset").cast("string")), "model", "dataset", ["0", "1", "2"], "f1"))


@query(sql(TIMELINE, RESULTS, "s AS (SELECT dataset, model, round(avg(f1), 6) AS f1 FROM rs GROUP BY ALL)", of="SELECT dataset, model, f1, CAST(row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, model) AS INTEGER) AS place FROM s"))
def ranked_models(spark, sf_dir):
    s = rounded(results(spark, sf_dir).groupBy("dataset", "model").agg(F.avg("f1").alias("f1")))
    return compare.ranked(s).drop("best")


@query(sql(TIMELINE, RESULTS, "s AS (SELECT dataset, model, avg(f1) AS f1 FROM rs GROUP BY ALL)", of="SELECT dataset, round(max(f1) FILTER (WHERE model NOT IN ('k', 'always')), 6) AS learned, round(max(f1) FILTER (WHERE model IN ('k', 'always')), 6) AS rule, round(100 * (max(f1) FILTER (WHERE model NOT IN ('k', 'always')) - max(f1) FILTER (WHERE model IN ('k', 'always'))), 6) AS margin_points FROM s GROUP BY dataset"))
def rule_margins(spark, sf_dir):
    s = results(spark, sf_dir).groupBy("dataset", "model").agg(F.avg("f1").alias("f1"))
    return rounded(compare.margins(s, ["k", "always"]))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) > 1 AS superseded FROM orders")
def latest_wins(spark, sf_dir):
    return summary.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate").drop("o_orderdate")


@query(sql(TIMELINE, RESULTS, "s AS (SELECT dataset, model, avg(f1) AS f1 FROM rs GROUP BY ALL)", of="SELECT a.dataset AS corpus_a, b.dataset AS corpus_b, a.model, round(a.f1, 6) AS f1_a, round(b.f1, 6) AS f1_b FROM s a JOIN s b ON a.model = b.model AND a.dataset < b.dataset"))
def shared_configs(spark, sf_dir):
    s = results(spark, sf_dir).groupBy("dataset", "model").agg(F.avg("f1").alias("f1"))
    return rounded(compare.shared_pairs(s, "model"))


def config_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("dataset", F.col("model").alias("config"), "fold", F.round("f1", 9).alias("score"))


@query(sql(TIMELINE, """q AS (SELECT source, participant, quantile_cont(score, 0.5) AS t FROM timeline GROUP BY ALL)""", of="SELECT source, round(quantile_cont(t, 0.5), 6) AS recommended, round(arg_min(t, participant), 6) AS first_fold, round(min(t), 6) AS least, round(max(t), 6) AS greatest, count(t) AS n FROM q GROUP BY source"))
def threshold_summary(spark, sf_dir):
    t = timeline(spark, sf_dir).groupBy("source", "participant").agg(F.percentile("score", 0.5).alias("threshold"))
    return rounded(summary.threshold_summary(t, "source", order="participant"))


# -- whole experiments and models (rows only: thresholds, forests)


@query()
def rule_experiment(spark, sf_dir):
    """Two rule detectors over participant folds: frame, event, pause and segment metrics, raw and smoothed."""
    rows = timeline(spark, sf_dir)
    back = staged(experiment.fold_table(rows).where("split != 'train'"), "held")
    found = experiment.evaluated(complement.rule_rows(rows, experiment.numbered(back), {"value_rule": "score", "k_rule": "k"}, "events"))
    return rounded(experiment.named(found, back))


def lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = over("session").rowsBetween(-4, 0)
    return timeline(spark, sf_dir).withColumns({"k": F.col("k").cast("double"), "mean5": F.avg("score").over(w), "k5": F.avg("k").over(w), "hand": F.col("hand_detected").cast("double")})


FEATURES = ["score", "k", "mean5", "k5", "hand"]


@query()
def model_sweep(spark, sf_dir):
    """Forests of frames and logistic models of two window sizes over all folds of the resolved scheme: every metric, raw and smoothed."""
    rows = lagged(spark, sf_dir)
    table = staged(experiment.fold_table(rows), "folds")
    scores = experiment.sweep(rows, experiment.numbered(table), FEATURES, "events", [(8, 2), (16, 4)], ["score", "k"], trees=10, depth=5)
    return rounded(experiment.named(experiment.evaluated(scores), table))


@query(sql(TIMELINE, of="SELECT source, round(corr(score, k), 6) AS r, count(*) AS n FROM timeline GROUP BY source"))
def signal_correlation(spark, sf_dir):
    return rounded(timeline(spark, sf_dir).groupBy("source").agg(F.corr("score", F.col("k").cast("double")).alias("r"), F.count(F.lit(1)).alias("n")))


from tideframe.plans import further, reports, sessions  # noqa: E402, F401  add their queries
