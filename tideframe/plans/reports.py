"""Queries of report tables, ordered results, and what a run leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import clean, events, features, metrics, runs, summary, tables, timing
from tideframe.plans import registry as r
from tideframe.plans.registry import query, rounded, sql
from tideframe.plans.views import POSES, TIMELINE, poses, timeline

_FOLD = "CAST(floor(session / 10) AS BIGINT)"


@query(sql(TIMELINE, r.HYST, r.SEGMENTS, """a AS (SELECT source, session, sub, min(v) FILTER (WHERE run = 0) AS v, count(*) AS n FROM t GROUP BY ALL),
b AS (SELECT source, session, sub, min(v) FILTER (WHERE run = 0) AS v, count(*) AS n FROM p GROUP BY ALL)""",
    f"ed AS (SELECT a.source, {_FOLD} AS fold, round_even(avg(1 - (CASE WHEN a.n <> b.n THEN abs(a.n - b.n) WHEN a.v = b.v THEN 0 ELSE least(a.n, 2) END)::DOUBLE / greatest(a.n, b.n)), 4) AS e, sum(a.n) AS nt, sum(b.n) AS np FROM a JOIN b USING (source, session, sub) GROUP BY ALL)",
    """o AS (SELECT t.source, t.session, t.sub, t.run AS i, p.run AS j, (least(t.e, p.e) - greatest(t.s, p.s))::DOUBLE / (greatest(t.e, p.e) - least(t.s, p.s)) AS iou
  FROM t JOIN p ON t.source = p.source AND t.session = p.session AND t.sub = p.sub AND t.v = p.v AND t.s < p.e AND p.s < t.e),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, session, sub, j ORDER BY iou DESC, i) AS rn FROM o) WHERE rn = 1),
hit AS (SELECT source, session, sub, i, max(iou) AS iou FROM best GROUP BY ALL)""", f"h AS (SELECT source, {_FOLD} AS fold, {r._HITS} FROM hit GROUP BY ALL)",
    f"sc AS (SELECT source, e, {', '.join(f'round_even(2.0 * coalesce(h{k}, 0) / (nt + np), 4) AS f{k}' for k in (10, 25, 50))} FROM ed LEFT JOIN h USING (source, fold))",
    of="SELECT source AS dataset, count(*) AS n_folds, round(avg(e), 6) AS edit_score_mean, round(coalesce(stddev_samp(e), 0), 6) AS edit_score_sd, " + ", ".join(f"round(avg(f{k}), 6) AS seg_f1_{k}_mean, round(coalesce(stddev_samp(f{k}), 0), 6) AS seg_f1_{k}_sd" for k in (10, 25, 50)) + " FROM sc GROUP BY source"))
def segment_table(spark, sf_dir):
    """Segment metrics of the two-threshold detector by participant, then over participants by corpus."""
    cut = runs.split_unscored(r.predicted(spark, sf_dir)).withColumns({"dataset": F.col("source"), "fold": F.col("participant")})
    return rounded(tables.segments(events.segment_metrics(cut, "y", "pred", group=["dataset", "fold"], keys=["session", "sub"]), "dataset").drop("place"))


@query(sql(TIMELINE, """m AS (SELECT source, participant, hand_detected, model, y, CASE model WHEN 'value' THEN score >= 0.5 ELSE k >= 40 END AS p FROM timeline, (SELECT unnest(['value', 'k']) AS model) WHERE scored)""",
    f"c AS (SELECT source, participant, model, hand_detected, {r.COUNTS} FROM m GROUP BY ALL)", "d AS (SELECT *, count(*) OVER (PARTITION BY source, participant, model) AS states, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fn) / (tp + fp + fn + tn) AS prior FROM c)",
    of="""SELECT source AS dataset, model, round(avg(f1) FILTER (WHERE hand_detected = 1), 6) AS hand_f1, round(avg(f1) FILTER (WHERE hand_detected = 0), 6) AS no_hand_f1, round(avg(prior) FILTER (WHERE hand_detected = 0), 6) AS no_hand_prior
FROM d WHERE states > 1 GROUP BY ALL"""))  # fmt: skip
def detection_table(spark, sf_dir):
    """Where two detectors' F1 comes from: rows with a hand and rows without."""
    decide = F.create_map(F.lit("value"), F.col("score") >= 0.5, F.lit("k"), F.col("k") >= 40)
    rows = timeline(spark, sf_dir).where("scored").select(F.col("source").alias("dataset"), F.col("participant").alias("fold"), "y", "hand_detected", F.explode(decide).alias("model", "p"))
    return rounded(tables.detection(metrics.slices(rows, "y", F.col("p"), ["dataset", "model", "fold"], ["hand_detected"]), ["dataset", "model"]))


@query(sql(TIMELINE, r.RESULTS, r.FOLDS_SQL, of="SELECT nu.unit AS fold, CAST(fold_no AS INTEGER) AS fold_no, dataset, model, round(f1, 6) AS f1, row_number() OVER (ORDER BY fold_no, dataset, model) - 1 AS place FROM rs JOIN nu ON nu.unit = CAST(rs.fold AS VARCHAR)"))
def ordered_results(spark, sf_dir):
    """Results in the order of their folds."""
    rows = r.results(spark, sf_dir).withColumn("fold", F.col("fold").cast("string"))
    folds = r.folds.held_one_out(r.units(spark, sf_dir)).select(F.col("unit").alias("fold"), "fold_no")
    return rounded(summary.in_fold_order(rows, folds, "dataset", "model").select("fold", "fold_no", "dataset", "model", "f1", "place"))


@query(sql(TIMELINE, of="SELECT source, count(*) AS rows, count(*) FILTER (WHERE hand_detected <> 1) AS dropped FROM timeline GROUP BY source"))
def dropped_rows(spark, sf_dir):
    return features.dropped(timeline(spark, sf_dir), "source")


@query(sql(TIMELINE, "d AS (SELECT session, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session ORDER BY frame_index) AS dt FROM timeline)",
    "m AS (SELECT session, round(1e9 / quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5), 1) AS fps FROM d GROUP BY session)", of="SELECT fps, count(*) AS sessions FROM m GROUP BY fps"))
def rate_histogram(spark, sf_dir):
    """How many sessions have each measured rate, in rows in a million seconds."""
    return timing.clock_notes(timeline(spark, sf_dir), scale=1e6)


@query(sql(TIMELINE, "s AS (SELECT DISTINCT source, session FROM timeline)", "q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY session) AS rn FROM s)", of="SELECT source, count(*) AS n_first, string_agg(CAST(session AS VARCHAR), ',' ORDER BY session) FILTER (WHERE rn <= 10) AS first FROM q GROUP BY source"))
def listed_sessions(spark, sf_dir):
    """The first ten sessions of each corpus and how many there are."""
    out = clean.listed(timeline(spark, sf_dir), "session", 10, "source")
    return out.select("source", "n_first", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first"))


#: Frames a second to which the runs are brought, other than the one at its native rate.
RATE = 12.5


@query(sql(POSES, "c AS (SELECT session, min(timestamp_ms) AS t0, max(timestamp_ms) AS t1 FROM poses GROUP BY session)",
    f"g AS (SELECT session, t0 + k * {1000 / RATE} AS moment FROM (SELECT session, t0, unnest(generate_series(0, CAST(floor((t1 + 1e-6 - t0) / {1000 / RATE}) AS BIGINT))) AS k FROM c))",
    "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, timestamp_ms ORDER BY frame_index DESC) AS rn FROM poses) WHERE rn = 1)",
    "h AS (SELECT l.* FROM g ASOF JOIN l ON g.session = l.session AND g.moment >= l.timestamp_ms)",
    *(f"{n} AS (SELECT * REPLACE ({', '.join(f'l{i}_x * CASE WHEN hand_detected = 1 THEN aspect ELSE 1 END AS l{i}_x' for i in range(21))}) FROM {t})" for n, t in (("ha", "h"), ("pa", "poses"))),
    *(f"x{t} AS (SELECT CASE WHEN handedness = 'Left' THEN -1 ELSE 1 END AS side, l8_x - l0_x AS x, {r._SPAN} AS span FROM {t})" for t in ("ha", "h", "pa")),
    of="SELECT variant, n_features, n_rows, x FROM (" + " UNION ALL ".join(
        f"SELECT '{v}' AS variant, {n} AS n_features, count(*) AS n_rows, {'NULL' if v == 'motion_only' else f'round(avg({side}x / CASE WHEN span > 0 THEN sqrt(span) ELSE 1 END), 6)'} AS x FROM x{t}"
        for v, n, t, side in (("default", 76, "ha", "side * "), ("no_motion", 64, "ha", "side * "), ("motion_only", 13, "ha", ""), ("velocity", 139, "ha", "side * "), ("no_mirror", 76, "ha", ""), ("centred", 76, "ha", "side * "), ("no_aspect", 76, "h", "side * "), ("native_rate", 76, "pa", "side * "))) + ")"))
def ablation_runs(spark, sf_dir):
    """The compared runs of the feature plan: how many features and rows each has, and the mean of the fingertip's x."""
    raw = poses(spark, sf_dir)
    x = [p[0] for p in features.landmarks(raw.columns)]
    slow = timing.resample(raw, RATE)
    ready = lambda df, aspect: timing.repaired_steps(clean.correct_aspect(df, x) if aspect else df)
    variants = {k: v for k, v in features.ABLATIONS.items() if k != "world"}
    rows = features.ablations(ready(slow, True), variants, ["session", "frame_index"], {"no_aspect": ready(slow, False), "native_rate": ready(raw, True)})
    out = rows.groupBy("variant").agg(F.max(F.size("features")).alias("n_features"), F.count(F.lit(1)).alias("n_rows"), F.avg(F.try_element_at("features", F.lit("l8_x"))).alias("x"))
    return rounded(out)
