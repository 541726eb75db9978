"""More registered queries with their SQL: splits, matching, statistics, joins, feature variants and report tables. registry.py adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions.expr import over
from tideframe.operators import clean, compare, complement, events, experiment, features, folds, metrics, models, runs, smoothing, summary, timing, windows
from tideframe.plans import registry as r
from tideframe.plans.registry import query, rounded, sql
from tideframe.plans.views import POSES, TIMELINE, poses, table, timeline

# -- one-to-one matching: the cheapest pair of a session first, one pair a step


def greedy_sql(pairs: str, cost: str, keys: str, name: str) -> str:
    """CTEs: `name` has keys, i, j, cost of the pairs that are taken; what is taken so far goes from step to step in two lists."""
    k = [c.strip() for c in keys.split(",")]
    on = " AND ".join(f"g.{c} = p.{c}" for c in k)
    free = "NOT list_contains(g.ui, p.i) AND NOT list_contains(g.uj, p.j)"
    return f"""{name}_o AS (SELECT *, {cost} AS cost, row_number() OVER (PARTITION BY {keys} ORDER BY {cost}, i, j) AS rn FROM {pairs}),
{name}_g AS (SELECT DISTINCT {keys}, 0::BIGINT AS rn, []::BIGINT[] AS ui, []::BIGINT[] AS uj, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS cost FROM {name}_o
  UNION ALL SELECT {", ".join(f"p.{c}" for c in k)}, p.rn, CASE WHEN {free} THEN list_append(g.ui, p.i) ELSE g.ui END, CASE WHEN {free} THEN list_append(g.uj, p.j) ELSE g.uj END,
    CASE WHEN {free} THEN p.i END, CASE WHEN {free} THEN p.j END, CASE WHEN {free} THEN p.cost END FROM {name}_g g JOIN {name}_o p ON {on} AND p.rn = g.rn + 1),
{name} AS (SELECT {keys}, i, j, cost FROM {name}_g WHERE i IS NOT NULL)"""


def recursive(*ctes: str, of: str) -> str:
    return sql(*ctes, of=of).replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(TIMELINE, r.HYST, r.EVENTS, greedy_sql("pairs", "-iou", "session, sub", "mt"), of="SELECT session, CAST(sub AS BIGINT) AS sub, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(-cost, 6) AS iou FROM mt"))
def event_match_iou(spark, sf_dir):
    """Every overlap counts, so that events compete for partners."""
    t, p, k = r.cut_events(spark, sf_dir)
    found = events.matched(events.overlapping(t, p, k), -F.col("iou"), k)
    return rounded(found.select(*k, "i", "j", (-F.col("cost")).alias("iou")))


_ON = """onsets AS (SELECT ti.session, ti.sub, i, j, abs(pj.s - ti.s) AS delta, pj.s - ti.s AS delay FROM ti JOIN pj ON ti.session = pj.session AND ti.sub = pj.sub AND abs(ti.s - pj.s) <= {0})"""


@query(recursive(TIMELINE, r.HYST, r.EVENTS, _ON.format(12), greedy_sql("onsets", "delta", "session, sub", "mo"), of="SELECT session, CAST(sub AS BIGINT) AS sub, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(cost AS BIGINT) AS delta FROM mo"))
def event_match_onset(spark, sf_dir):
    t, p, k = r.cut_events(spark, sf_dir)
    found = events.matched(events.near_onsets(t, p, 12, k), F.col("delta"), k)
    return found.select(*k, "i", "j", F.col("cost").cast("long").alias("delta"))


_BY = "source, session, sub"
_T2 = r.CUT.format("hyst") + ",\n" + r._runs_sql("cut", "y", "t", _BY) + ",\n" + r._runs_sql("cut", "pred", "p", _BY)
_EV = f"""ti AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY s) - 1 AS i FROM t WHERE v = 1 AND n >= 2),
pj AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY s) - 1 AS j FROM p WHERE v = 1 AND n >= 2),
pairs AS (SELECT ti.source, ti.session, ti.sub, i, j, (least(ti.e, pj.e) - greatest(ti.s, pj.s))::DOUBLE / (greatest(ti.e, pj.e) - least(ti.s, pj.s)) AS iou
  FROM ti JOIN pj USING (source, session, sub) WHERE ti.s < pj.e AND pj.s < ti.e),
half AS (SELECT * FROM pairs WHERE iou >= 0.5),
onsets AS (SELECT ti.source, ti.session, ti.sub, i, j, abs(pj.s - ti.s) AS delta, pj.s - ti.s AS delay FROM ti JOIN pj USING (source, session, sub) WHERE abs(ti.s - pj.s) <= 12)"""


def _prf(matched: str, prefix: str = "", n_true: str = "n_true", n_pred: str = "n_pred") -> str:
    p, q = f"coalesce({matched}::DOUBLE / nullif({n_pred}, 0), 0)", f"coalesce({matched}::DOUBLE / nullif({n_true}, 0), 0)"
    f = lambda b: f"coalesce({1 + b} * {p} * {q} / nullif({b} * {p} + {q}, 0), 0)"
    return f"round_even({p}, 4) AS {prefix}precision, round_even({q}, 4) AS {prefix}recall, round_even({f(1)}, 4) AS {prefix}f1, round_even({f(4)}, 4) AS {prefix}f2"


@query(recursive(TIMELINE, r.HYST, _T2, _EV, greedy_sql("half", "-iou", _BY, "mi"), greedy_sql("onsets", "delta", _BY, "mo"),
    f"fr AS (SELECT ti.source, ti.e - ti.s AS len, count(pairs.j) AS n FROM ti LEFT JOIN pairs ON ti.source = pairs.source AND ti.session = pairs.session AND ti.sub = pairs.sub AND ti.i = pairs.i GROUP BY ti.source, ti.session, ti.sub, ti.i, ti.e, ti.s)",
    "a AS (SELECT source, count(*) AS n_true, round_even(avg(n), 2) AS mean_fragments, count(*) FILTER (WHERE n = 0) AS missed_entirely, CAST(floor(quantile_cont(len, 0.5)) AS INTEGER) AS median_true_rows FROM fr GROUP BY source)",
    "b AS (SELECT source, count(*) AS n_pred FROM pj GROUP BY source)", "c AS (SELECT source, count(*) AS n_iou, round_even(quantile_cont(-cost, 0.5), 4) AS median_iou FROM mi GROUP BY source)",
    "d AS (SELECT mo.source, count(*) AS n_onset, CAST(floor(quantile_cont(mo.cost, 0.5)) AS INTEGER) AS median_onset_error, quantile_cont(o.delay, 0.5)::DOUBLE AS median_onset_delay FROM mo JOIN onsets o USING (source, session, sub, i, j) GROUP BY mo.source)",
    "s AS (SELECT DISTINCT source FROM cut)", "z AS (SELECT s.source, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(n_iou, 0) AS n_iou, coalesce(n_onset, 0) AS n_onset, coalesce(missed_entirely, 0) AS missed_entirely, median_iou, median_onset_error, median_onset_delay, mean_fragments, median_true_rows FROM s LEFT JOIN a USING (source) LEFT JOIN b USING (source) LEFT JOIN c USING (source) LEFT JOIN d USING (source))",
    of=f"SELECT source, n_true, n_pred, n_iou, n_onset, missed_entirely, {_prf('n_iou', 'iou_')}, {_prf('n_onset', 'onset_')}, median_iou, median_onset_error, median_onset_delay, mean_fragments, median_true_rows FROM z"))
def event_metrics(spark, sf_dir):
    return events.event_metrics(runs.split_unscored(r.predicted(spark, sf_dir)), "y", "pred", group="source", keys=["session", "sub"], least=2)


@query(recursive(TIMELINE, r.HYST, _T2, f"""ti AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY s) - 1 AS i FROM t WHERE v = 0 AND run > 0 AND run < last),
pj AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY s) - 1 AS j FROM p WHERE v = 0 AND run > 0 AND run < last),
x AS (SELECT unnest([5, 10, 12]) AS tolerance),
near AS (SELECT ti.source, ti.session, ti.sub, x.tolerance, i, j, abs(ti.s - pj.s) + abs(ti.e - pj.e) AS error FROM ti JOIN pj USING (source, session, sub), x WHERE abs(ti.s - pj.s) <= x.tolerance AND abs(ti.e - pj.e) <= x.tolerance)""",
    greedy_sql("near", "error", f"{_BY}, tolerance", "mp"), "a AS (SELECT source, count(*) AS n_true, CAST(floor(quantile_cont(e - s, 0.5)) AS INTEGER) AS median_true_rows FROM ti GROUP BY source)", "b AS (SELECT source, count(*) AS n_pred FROM pj GROUP BY source)", "c AS (SELECT source, tolerance, count(*) AS n_matched FROM mp GROUP BY ALL)",
    "z AS (SELECT s.source, CAST(x.tolerance AS INTEGER) AS tolerance, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(n_matched, 0) AS n_matched, median_true_rows FROM (SELECT DISTINCT source FROM cut) s CROSS JOIN x LEFT JOIN a USING (source) LEFT JOIN b USING (source) LEFT JOIN c ON c.source = s.source AND c.tolerance = x.tolerance)",
    of=f"SELECT source, tolerance, n_true, n_pred, n_matched, {_prf('n_matched')}, median_true_rows FROM z"))
def pause_metrics(spark, sf_dir):
    return events.pause_metrics(runs.split_unscored(r.predicted(spark, sf_dir)), "y", "pred", group="source", keys=["session", "sub"], least=1)


# -- splits

UNITS = """us AS (SELECT CAST(participant AS VARCHAR) AS unit, count(*) AS n, sum(y) AS pos, md5(concat('42:', participant)) AS tie FROM timeline GROUP BY participant)"""


@query(recursive(TIMELINE, UNITS, "ou AS (SELECT unit, n, row_number() OVER (ORDER BY n DESC, tie, unit) AS rn FROM us)",
    """gr AS (SELECT 0::BIGINT AS rn, '' AS unit, 0::BIGINT AS grp, list_transform(range(greatest(2, least(5, (SELECT count(*) FROM us)))), lambda x: 0::HUGEINT) AS filled
  UNION ALL SELECT ou.rn, ou.unit, list_position(filled, list_min(filled)) - 1, list_transform(filled, lambda x, i: CASE WHEN i = list_position(filled, list_min(filled)) THEN x + ou.n ELSE x END) FROM gr JOIN ou ON ou.rn = gr.rn + 1)""",
    "gs AS (SELECT unit, grp FROM gr WHERE rn > 0)", "nm AS (SELECT grp, format('fold{:02d}_{}', grp + 1, string_agg(unit, '+' ORDER BY unit)) AS fold FROM gs GROUP BY grp)",
    of="SELECT nm.fold, CAST(nm.grp + 1 AS INTEGER) AS fold_no, gs.unit, CASE WHEN gs.grp = nm.grp THEN 'test' ELSE 'train' END AS split FROM nm, gs"))
def group_kfold(spark, sf_dir):
    return folds.group_k_fold(r.units(spark, sf_dir), 5)


@query(sql(TIMELINE, """un AS (SELECT CAST(session AS VARCHAR) AS unit, count(*) AS n, coalesce(string_agg(DISTINCT label, '+' ORDER BY label) FILTER (WHERE label <> 'unsure'), '') AS classes, md5(concat('42:', session)) AS tie FROM timeline GROUP BY session)""",
    "wc AS (SELECT string_agg(DISTINCT label, '+' ORDER BY label) AS whole FROM timeline WHERE label <> 'unsure')", "fu AS (SELECT un.* FROM un, wc WHERE classes = whole)",
    "p1 AS (SELECT unit, n, 'train' AS split FROM fu ORDER BY n DESC, tie LIMIT 1)", "p2 AS (SELECT unit, n, 'test' AS split FROM (SELECT * FROM fu ORDER BY n, tie LIMIT 1) WHERE unit NOT IN (SELECT unit FROM p1))",
    "p3 AS (SELECT unit, n, 'val' AS split FROM (SELECT * FROM fu ORDER BY n, tie LIMIT 1 OFFSET 1) WHERE unit NOT IN (SELECT unit FROM p1 UNION ALL SELECT unit FROM p2))", "pi AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)",
    "wa AS (SELECT greatest(0, 0.70 * t - coalesce((SELECT sum(n) FROM pi WHERE split = 'train'), 0)) AS a, greatest(0, 0.15 * t - coalesce((SELECT sum(n) FROM pi WHERE split = 'val'), 0)) AS b, greatest(0, 0.15 * t - coalesce((SELECT sum(n) FROM pi WHERE split = 'test'), 0)) AS c FROM (SELECT sum(n)::DOUBLE AS t FROM un))",
    "fr AS (SELECT unit, (sum(n) OVER (PARTITION BY classes ORDER BY tie) - n + n / 2.0) / sum(n) OVER (PARTITION BY classes) AS place FROM un WHERE unit NOT IN (SELECT unit FROM pi))",
    of="SELECT 'holdout' AS fold, CAST(1 AS INTEGER) AS fold_no, unit, split FROM pi UNION ALL SELECT 'holdout', 1, unit, CASE WHEN place * (a + b + c) < a THEN 'train' WHEN place * (a + b + c) < a + b THEN 'val' ELSE 'test' END FROM fr, wa"))
def holdout_split(spark, sf_dir):
    return folds.holdout(timeline(spark, sf_dir))


@query(sql(TIMELINE, "q AS (SELECT session, frame_index, row_number() OVER (ORDER BY md5(concat('42:', session, ':', frame_index))) AS k, count(*) OVER () AS n FROM timeline)",
    of="SELECT session, frame_index, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM q"))
def random_row_split(spark, sf_dir):
    return folds.random_rows(timeline(spark, sf_dir), ["session", "frame_index"]).select("session", "frame_index", "split")


_CHOSEN = """pl AS (SELECT CAST(participant AS VARCHAR) AS unit, count(*) AS n, sum(y) AS pos FROM timeline WHERE source = 1 GROUP BY participant),
wh AS (SELECT sum(n) AS tn, sum(pos) AS tp, count(*) AS m FROM pl),
cb AS (SELECT [a.unit, b.unit] AS us, a.n + b.n AS n, a.pos + b.pos AS pos FROM pl a JOIN pl b ON a.unit < b.unit, wh WHERE m > 2 UNION ALL SELECT [unit], n, pos FROM pl, wh WHERE m = 2),
bs AS (SELECT us FROM cb, wh WHERE pos > 0 AND pos < n AND tp - pos > 0 AND tp - pos < tn - n ORDER BY round(abs(pos / n - tp / tn) + 0.5 * abs(n / tn - 0.15), 12), us LIMIT 1),
vu AS (SELECT unnest(us) AS unit FROM bs)"""


@query(sql(TIMELINE, _CHOSEN, of="SELECT session, frame_index, CASE WHEN source = 2 THEN 'test' WHEN CAST(participant AS VARCHAR) IN (SELECT unit FROM vu) THEN 'val' ELSE 'train' END AS split FROM timeline WHERE source IN (1, 2)"))
def transfer_split(spark, sf_dir):
    """Validation units are chosen on the training corpus."""
    rows = timeline(spark, sf_dir).withColumn("source", F.col("source").cast("string"))
    return folds.transfer(rows, "1", "2").select("session", "frame_index", "split")


@query(sql(TIMELINE, "n AS (SELECT source, count(DISTINCT participant) AS n FROM timeline GROUP BY source)", of="SELECT source, CASE WHEN n < 3 THEN 'holdout' WHEN n <= 16 THEN 'lopo' ELSE 'group_kfold' END AS scheme FROM n"))
def fold_scheme(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    sources = sorted(x for (x,) in rows.select("source").distinct().collect())  # corpora: a handful
    return spark.createDataFrame([(s, folds.scheme(rows.where(F.col("source") == s))) for s in sources], "source long, scheme string")


# -- cleaning and joins


@query("SELECT conv_id AS session, turn AS frame_index, role AS label FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = c.conv_id AND b.role NOT IN ('user', 'assistant'))")
def quarantine_sessions(spark, sf_dir):
    """Conversations as sessions; a turn of another role makes the whole conversation bad."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("frame_index"), F.col("role").alias("label"))
    return clean.quarantine(rows, vocabulary=("user", "assistant"))[0]


@query("SELECT conv_id AS session, string_agg(DISTINCT role, ',' ORDER BY role) AS unknown FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY conv_id")
def quarantined_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("label"))
    return clean.quarantine(rows, vocabulary=("user", "assistant"))[1].select("session", F.array_join("unknown_labels", ",").alias("unknown"))


@query(sql(TIMELINE, "l AS (SELECT source, session, frame_index, label FROM timeline WHERE k >= 20 UNION ALL SELECT source, session, frame_index, label FROM timeline WHERE k >= 90)", of="SELECT t.source, t.session, t.frame_index, l.label, count(*) AS n FROM timeline t JOIN l ON t.source = l.source AND t.session = l.session AND t.frame_index = l.frame_index GROUP BY ALL"))
def label_join(spark, sf_dir):
    """Frames without a label row go, frames with two come twice."""
    rows = timeline(spark, sf_dir)
    given = rows.select("source", "session", "frame_index", "label", "k")
    given = given.where("k >= 20").unionByName(given.where("k >= 90")).drop("k")
    return clean.with_labels(rows.drop("label"), given).groupBy("source", "session", "frame_index", "label").agg(F.count(F.lit(1)).alias("n"))


_META = """me AS (SELECT DISTINCT source, session, CASE WHEN session % 3 = 0 THEN NULL ELSE 640 END AS width, 480 AS height, CASE WHEN session % 5 = 0 THEN 1.5 END AS aspect FROM timeline),
le AS (SELECT concat(source, '/', session) AS key, CASE WHEN session % 2 = 0 THEN 1.25 ELSE 1.0 END AS aspect FROM me WHERE session % 7 <> 0)"""


def _session_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = timeline(spark, sf_dir)
    s = F.col("session")
    meta = rows.select("source", "session").distinct().select("source", "session", F.when(s % 3 != 0, 640).alias("width"), F.lit(480).alias("height"), F.when(s % 5 == 0, 1.5).alias("aspect"))
    legacy = meta.where(s % 7 != 0).select(F.concat_ws("/", "source", "session").alias("key"), F.when(s % 2 == 0, 1.25).otherwise(1.0).alias("aspect"))
    return rows, meta, legacy


@query(sql(TIMELINE, _META, of="SELECT t.session, t.frame_index, round(coalesce(width / height, me.aspect, le.aspect)::DOUBLE, 6) AS aspect, CASE WHEN width IS NOT NULL THEN 'size' WHEN me.aspect IS NOT NULL THEN 'aspect' WHEN le.aspect IS NOT NULL THEN 'legacy' ELSE 'unknown' END AS aspect_from FROM timeline t LEFT JOIN me USING (source, session) LEFT JOIN le ON le.key = concat(t.source, '/', t.session)"))
def aspect_join(spark, sf_dir):
    rows, meta, legacy = _session_tables(spark, sf_dir)
    return rounded(clean.with_aspect(rows, meta, legacy).select("session", "frame_index", "aspect", "aspect_from"))


@query(sql(TIMELINE, _META, of="SELECT t.session, t.frame_index, CAST(CASE WHEN le.aspect <> 1.0 THEN le.aspect END AS DOUBLE) AS legacy_aspect FROM timeline t LEFT JOIN le ON le.key = concat(t.source, '/', t.session)"))
def legacy_aspect(spark, sf_dir):
    """Sessions are named `corpus:session`, so that no whole name is known and the tail is looked up."""
    rows, _, legacy = _session_tables(spark, sf_dir)
    named = rows.withColumn("id", F.col("session")).withColumn("session", F.concat(F.lit("own:"), F.col("session")))
    return clean.legacy_aspect(named, legacy).select(F.col("id").alias("session"), "frame_index", "legacy_aspect")


@query(sql(TIMELINE, of="SELECT session, frame_index, label <> 'unsure' AS scored, hand_detected FROM timeline"))
def row_flags(spark, sf_dir):
    rows = timeline(spark, sf_dir).drop("scored").withColumn("hand_detected", F.when(F.col("hand_detected") == 1, "True").otherwise("False"))
    return clean.flags(rows).select("session", "frame_index", "scored", "hand_detected")


@query(sql(TIMELINE, of="SELECT session, frame_index, k FROM timeline WHERE hand_detected = 1"))
def detected_rows(spark, sf_dir):
    return features.drop_undetected(timeline(spark, sf_dir)).select("session", "frame_index", "k")


@query(sql(TIMELINE, "d AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session ORDER BY frame_index) AS d0 FROM timeline)", "g AS (SELECT *, CASE WHEN d0 BETWEEN 60000 AND 86400000 THEN d0 END AS good FROM d)",
    "m AS (SELECT session, coalesce(quantile_cont(good, 0.5), 1000.0 / 30) AS m FROM g GROUP BY session)", "s AS (SELECT source, session, greatest(least(coalesce(good, m), 86400000), 60000) / 1000.0 AS dt, good IS NULL AS rep FROM g JOIN m USING (session))",
    of="SELECT source, count(*) AS rows, count(*) FILTER (WHERE rep) AS repaired, round(quantile_cont(1e6 / dt, 0.5), 4) AS median_rate FROM s GROUP BY source"))
def repair_notes(spark, sf_dir):
    rows = timing.repaired_steps(timeline(spark, sf_dir), low=60_000, high=24 * r.HOUR)
    return rounded(timing.repair_notes(rows, "source", scale=1e6), 4)


@query(sql(TIMELINE, _META, "w AS (SELECT me.source, me.session, concat(coalesce(CAST(width AS VARCHAR), '?'), 'x', height) AS resolution, CASE WHEN width IS NOT NULL THEN 'size' WHEN me.aspect IS NOT NULL THEN 'aspect' WHEN le.aspect IS NOT NULL THEN 'legacy' ELSE 'unknown' END AS aspect_from, CASE WHEN me.session % 4 > 0 THEN CAST(me.session % 4 AS VARCHAR) ELSE 'unknown' END AS schema_version FROM me LEFT JOIN le ON le.key = concat(me.source, '/', me.session))",
    "l AS (UNPIVOT w ON resolution, aspect_from, schema_version INTO NAME what VALUE value)", of="SELECT source, what, value, count(DISTINCT session) AS sessions FROM l GROUP BY ALL"))
def values_seen(spark, sf_dir):
    """Resolutions, origins of the aspect and schema versions by number of sessions."""
    rows, meta, legacy = _session_tables(spark, sf_dir)
    one = clean.with_aspect(rows.select("source", "session").distinct(), meta, legacy).join(meta.select("source", "session", "width", "height"), ["source", "session"])
    one = one.withColumns({"resolution": F.concat(F.coalesce(F.col("width").cast("string"), F.lit("?")), F.lit("x"), F.col("height")), "schema_version": F.when(F.col("session") % 4 > 0, F.col("session") % 4)})
    return clean.seen(one, ["resolution", "aspect_from", "schema_version"], "source")


@query(sql(TIMELINE, r.FOLDS_SQL, r.VAL, "c AS (SELECT count(DISTINCT fold) AS n FROM vf)", "u AS (SELECT fold, fold_no, " + ", ".join(f"coalesce(string_agg(unit, '+' ORDER BY unit) FILTER (WHERE split = '{s}'), '') AS {s}" for s in ("train", "val", "test")) + " FROM vf GROUP BY ALL)",
    of="SELECT fold, fold_no, train, val, test, CASE WHEN n > 3 THEN concat(n, ' folds available, 3 run') END AS note FROM u, c WHERE fold_no <= 3"))
def fold_layout(spark, sf_dir):
    u = r.staged(r.units(spark, sf_dir), "units")
    held = r.staged(folds.held_one_out(u), "held")
    first = r.staged(folds.held_with_validation(held.where("fold_no <= 3"), u), "first")
    out = folds.layout(folds.expanded(first, u), 3, held.select("fold").distinct().count())
    return out.select("fold", "fold_no", *(F.array_join(s, "+").alias(s) for s in ("train", "val", "test")), "note")


# -- feature variants


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poses with world points beside the picture's: the same points, twice as large and moved; none on rows without a hand."""
    rows = r.stepped(spark, sf_dir)
    points = [c for p in features.landmarks(rows.columns) for c in p]
    return rows.withColumns({f"w{c}": F.when(F.col("hand_detected") == 1, 2 * F.col(c) + 0.25) for c in points})


_SPAN = "greatest(" + ", ".join(f"(l{i}_x - l0_x) * (l{i}_x - l0_x) + (l{i}_y - l0_y) * (l{i}_y - l0_y) + (l{i}_z - l0_z) * (l{i}_z - l0_z)" for i in range(21)) + ")"


def _world_sql(c: str) -> str:
    flip = "CASE WHEN handedness = 'Left' THEN -1 ELSE 1 END * " if c.endswith("x") else ""
    return f"round(CASE WHEN hand_detected = 1 AND span > 0 THEN {flip}({c} - l0_{c[-1]}) / sqrt(span) ELSE 0 END, 6) + 0.0 AS w{c}"


_VELOCITY = ", ".join(f"round(coalesce({c} - lag({c}) OVER (PARTITION BY session ORDER BY frame_index), 0), 6) + 0.0 AS d_{c}" for c in r._SHOWN)


@query(sql(POSES, f"sp AS (SELECT *, {_SPAN} AS span FROM poses)", of="SELECT session, frame_index, " + ", ".join(_world_sql(c) for c in r._SHOWN) + f", {_VELOCITY} FROM sp"))
def world_pose(spark, sf_dir):
    """The world's points normalised and mirrored; velocities are of the picture's raw points."""
    rows, names = features.prepare(world(spark, sf_dir), pose="world", with_motion=False, with_velocity=True)
    shown = [f"w{c}" for c in r._SHOWN] + [f"d_{c}" for c in r._SHOWN]
    assert set(shown) <= set(names)
    return rounded(rows.select("session", "frame_index", *shown))


@query(sql(POSES, of="SELECT session, frame_index, " + ", ".join(f"round({f'CASE WHEN handedness = {chr(39)}Left{chr(39)} THEN coalesce(CASE WHEN vec_id % 5 <> 0 THEN aspect END, 1.0) - {c} ELSE {c} END' if c.endswith('x') else c}, 6) + 0.0 AS {c}" for c in r._SHOWN) + " FROM poses"))
def unnormalised_pose(spark, sf_dir):
    """Without normalisation left hands are mirrored about the picture's middle, of width 1 where the aspect isn't known."""
    rows = r.stepped(spark, sf_dir).withColumn("aspect", F.when(F.col("vec_id") % 5 != 0, F.col("aspect")))
    return rounded(features.prepare(rows, with_motion=False, normalise=False)[0].select("session", "frame_index", *r._SHOWN))


@query(sql(POSES, r.STEPS, r.SCALE, r.MOTION, r._NORMAL, f"ro AS (SELECT session, frame_index, {r._rolled(True)} FROM mo)",
    of="SELECT session, frame_index, hand_detected, " + ", ".join(f"round({f'CASE WHEN no.handedness = {chr(39)}Left{chr(39)} THEN -no.{c} ELSE no.{c} END' if c.endswith('x') else f'no.{c}'} / span, 4) + 0.0 AS {c}" for i in range(21) for c in (f"l{i}_x", f"l{i}_y", f"l{i}_z")) + ", round(tip, 4) AS mot_tip_speed, round(wrist, 4) AS mot_wrist_speed, " + ", ".join(r._ROLLED) + " FROM no JOIN mo USING (session, frame_index) JOIN ro USING (session, frame_index) JOIN (SELECT session, frame_index, hand_detected FROM poses) USING (session, frame_index)"))
def prepared_features(spark, sf_dir):
    """The whole feature plan: 76 columns in their order."""
    rows, names = features.prepare(r.stepped(spark, sf_dir))
    return rounded(rows.select("session", "frame_index", *names), 4)


_VARIANTS = {"pose": {"with_motion": False}, "no_mirror": {"with_motion": False, "mirror": False}, "plain": {"with_motion": False, "normalise": False, "mirror": False}, "velocity": {"with_motion": False, "with_velocity": True}}


@query(sql(POSES, r._NORMAL, of="""SELECT n.session, n.frame_index, 64 AS n_pose, 127 AS n_velocity, round(CASE WHEN n.handedness = 'Left' THEN -n.l8_x ELSE n.l8_x END / span, 6) + 0.0 AS pose, round(n.l8_x / span, 6) + 0.0 AS no_mirror, round(p.l8_x, 6) + 0.0 AS plain
FROM no n JOIN poses p ON n.session = p.session AND n.frame_index = p.frame_index"""))
def ablation_variants(spark, sf_dir):
    """Variants of the feature plan as rows, then one row a frame with the fingertip's x by variant."""
    rows = features.ablations(r.stepped(spark, sf_dir), _VARIANTS, ["session", "frame_index"])
    rows = rows.select("session", "frame_index", "variant", F.size("features").alias("n"), F.element_at("features", "l8_x").alias("x"))
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return rounded(rows.groupBy("session", "frame_index").agg(of("pose", "n").alias("n_pose"), of("velocity", "n").alias("n_velocity"), *(of(v, "x").alias(v) for v in ("pose", "no_mirror", "plain"))))


# -- decisions, thresholds, metrics


@query(sql(TIMELINE, r.HYST.replace(str(r.HIGH), "(0.45 + 0.2 / 2)").replace(str(r.LOW), "(0.45 - 0.2 / 2)"), r._filled("hyst", 0, 3, "fill"), r._filled("fill", 1, 2, "smooth"), of="SELECT session, frame_index, pred FROM smooth"))
def smoothing_chain(spark, sf_dir):
    return smoothing.smooth(timeline(spark, sf_dir), "score", 0.45, band=0.2, on=2, off=3).select("session", "frame_index", "pred")


@query(sql(TIMELINE, of="SELECT session, frame_index, round((rank() OVER (PARTITION BY source ORDER BY score) - 1)::DOUBLE / count(*) OVER (PARTITION BY source), 6) AS percentile FROM timeline"))
def percentile_map(spark, sf_dir):
    """Every row's score among all scores of its source."""
    rows = timeline(spark, sf_dir)
    return rounded(smoothing.percentile_map(rows, "score", rows, "score", "source").select("session", "frame_index", "percentile"))


def _fit_sql(where: str, name: str) -> str:
    return f"""{name}_l AS (SELECT * FROM timeline WHERE scored AND {where}),
{name}_k AS (SELECT participant FROM {name}_l GROUP BY participant HAVING min(y) <> max(y)),
{name}_q AS (SELECT DISTINCT participant, unnest(quantile_cont(score, [0.01 + 0.98 * i / 38.0 for i in range(39)])) AS t FROM {name}_l GROUP BY participant),
{name}_c AS (SELECT q.participant, t, sum(CASE WHEN score >= t AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN 1 ELSE 0 END) AS pp, sum(y) AS pos FROM {name}_q q JOIN {name}_l l ON l.participant = q.participant GROUP BY ALL),
{name} AS (SELECT participant, t FROM (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY round(2.0 * tp / (pp + pos), 12) DESC, t) AS rn FROM {name}_c) WHERE rn = 1 AND participant IN (SELECT participant FROM {name}_k))"""


@query(sql(TIMELINE, _fit_sql("k < 8 AND score > 0.4 AND session % 4 = 0", "va"), _fit_sql("session % 10 <> 0", "tr"), "ps AS (SELECT DISTINCT participant FROM timeline)",
    of="SELECT participant, round(coalesce(va.t, tr.t, 0.5), 6) AS threshold, CASE WHEN va.t IS NOT NULL THEN 'val' WHEN tr.t IS NOT NULL THEN 'train' ELSE 'fallback' END AS threshold_source FROM ps LEFT JOIN va USING (participant) LEFT JOIN tr USING (participant)"))
def operating_points(spark, sf_dir):
    """Thresholds of a small validation set where it has both classes, else of the training rows."""
    rows = timeline(spark, sf_dir).where("scored")
    fit = lambda where: metrics.fit_threshold(rows.where(where), "y", "score", "participant", steps=39)
    points = metrics.operating_point({"val": fit("k < 8 and score > 0.4 and session % 4 = 0"), "train": fit("session % 10 <> 0")}, "participant")
    every = rows.select("participant").distinct().join(points, "participant", "left")
    return rounded(every.select("participant", F.coalesce("threshold", F.lit(0.5)).alias("threshold"), F.coalesce("threshold_source", F.lit("fallback")).alias("threshold_source")))


_TWO = "one AS (SELECT *, tp + fp + fn + tn AS n, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS s1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0, tn + fp AS s0 FROM c)"


@query(sql(TIMELINE, r.SCORED, f"c AS (SELECT participant, {r.COUNTS} FROM sr GROUP BY participant)", _TWO, of="""SELECT participant, '1' AS class, round(p1, 6) AS precision, round(r1, 6) AS recall, round(f1, 6) AS f1, s1 AS support FROM one
UNION ALL SELECT participant, '0', round(p0, 6), round(r0, 6), round(f0, 6), s0 FROM one
UNION ALL SELECT participant, 'macro', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM one
UNION ALL SELECT participant, 'weighted', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6), round((f0 * s0 + f1 * s1) / n, 6), n FROM one"""))
def class_report(spark, sf_dir):
    counts = metrics.confusion(r.scored_rows(spark, sf_dir), "y", F.col("score") >= 0.5, "participant")
    return rounded(metrics.class_report(counts, "participant"))


# -- results over folds

SLICED = f"""sl AS (SELECT 'all' AS slice, 'all' AS value, participant, {r.COUNTS} FROM sr GROUP BY participant
UNION ALL SELECT 'source', CAST(source AS VARCHAR), participant, {r.COUNTS} FROM sr GROUP BY participant, source UNION ALL SELECT 'hand_detected', CAST(hand_detected AS VARCHAR), participant, {r.COUNTS} FROM sr GROUP BY participant, hand_detected),
sk AS (SELECT *, count(*) OVER (PARTITION BY participant, slice) AS m, tp + fp + fn + tn AS n, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM sl)"""


@query(sql(TIMELINE, r.SCORED, SLICED, of="SELECT slice, value, CAST(sum(n) AS BIGINT) AS n_test, count(*) AS n_folds, round(avg(f1), 6) AS f1_mean, round(coalesce(stddev_samp(f1), 0), 6) AS f1_std FROM sk WHERE slice = 'all' OR m > 1 GROUP BY slice, value"))
def sliced_summary(spark, sf_dir):
    parts = metrics.slices(r.scored_rows(spark, sf_dir), "y", F.col("score") >= 0.5, "participant", ["source", "hand_detected"])
    return rounded(summary.sliced_summary(parts, ["f1"], ()))


@query(sql(TIMELINE, r.FOLDS_SQL, r.VAL, "rc AS (SELECT fold, split, avg(CASE WHEN scored THEN y END) AS prior FROM vf JOIN timeline ON unit = CAST(participant AS VARCHAR) GROUP BY fold, split)", "g AS (SELECT a.fold, abs(a.prior - b.prior) AS gap FROM rc a JOIN rc b ON a.fold = b.fold WHERE a.split = 'train' AND b.split = 'val')",
    of="SELECT round(max(gap), 6) AS max_gap, round(quantile_cont(gap, 0.5), 6) AS median_gap FROM g"))
def prior_gap(spark, sf_dir):
    return rounded(summary.prior_gap(complement.fold_record(timeline(spark, sf_dir), r.held(spark, sf_dir))))


@query(sql(TIMELINE, "s AS (SELECT source, session, count(*) AS rows, max(timestamp_ms) - min(timestamp_ms) AS ms FROM timeline GROUP BY ALL)", of="SELECT source, min(rows) AS rows_min, quantile_cont(rows, 0.5)::DOUBLE AS rows_median, max(rows) AS rows_max, min(ms) AS ms_min, quantile_cont(ms, 0.5)::DOUBLE AS ms_median, max(ms) AS ms_max FROM s GROUP BY source"))
def session_spans(spark, sf_dir):
    rows = timeline(spark, sf_dir).groupBy("source", "session").agg(F.count(F.lit(1)).alias("rows"), (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("ms"))
    return summary.spans(rows, ["rows", "ms"], "source")


@query(sql(TIMELINE, r.RESULTS, of="SELECT dataset, fold, model, round(f1, 6) AS f1 FROM (SELECT *, round(f1, 6) AS f FROM rs) ORDER BY f DESC, dataset, fold, model LIMIT 20"))
def top_results(spark, sf_dir):
    """The twenty highest scores of all folds: the limit is the feature."""
    return summary.top(rounded(r.results(spark, sf_dir).select("dataset", "fold", "model", "f1")), "f1", 20)


@query(sql(TIMELINE, of="SELECT label, min(frame_index * 1000000 + session) AS first FROM timeline GROUP BY label"))
def first_seen(spark, sf_dir):
    rows = timeline(spark, sf_dir).withColumn("first", F.col("frame_index") * 1_000_000 + F.col("session"))
    return compare.ordered_distinct(rows, "label", "first")


_RAW = sql(TIMELINE, r.SMOOTH, f"bo AS (SELECT source, 'raw' AS variant, y, pred = 1 AS p FROM hyst WHERE scored UNION ALL SELECT source, 'smoothed', y, pred = 1 FROM smooth WHERE scored)", f"c AS (SELECT source, variant, {r.COUNTS} FROM bo GROUP BY ALL)",
    "f AS (SELECT source, variant, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c)",
    of="SELECT a.source, round(a.f1, 6) AS f1_raw, round(b.f1, 6) AS f1_smoothed, round(b.f1 - a.f1, 6) AS f1_gain, round(a.accuracy, 6) AS accuracy_raw, round(b.accuracy, 6) AS accuracy_smoothed, round(b.accuracy - a.accuracy, 6) AS accuracy_gain FROM f a JOIN f b USING (source) WHERE a.variant = 'raw' AND b.variant = 'smoothed'")


@query(_RAW)
def raw_and_smoothed(spark, sf_dir):
    raw, even = r.predicted(spark, sf_dir), r.smoothed(spark, sf_dir)
    both = raw.select("source", "y", "pred", "scored", F.lit("raw").alias("variant")).unionByName(even.select("source", "y", "pred", "scored", F.lit("smoothed").alias("variant")))
    rates = metrics.rates(metrics.confusion(both.where("scored"), "y", "pred", ["source", "variant"]))
    return rounded(compare.raw_and_smoothed(rates, ["f1", "accuracy"], "source"))


@query(sql(TIMELINE, r.RESULTS, "v AS (SELECT model, CASE WHEN fold % 2 = 0 THEN 'even' ELSE 'odd' END AS variant, f1 FROM rs)", of="SELECT model, round(avg(f1) FILTER (WHERE variant = 'even'), 6) AS even, round(avg(f1) FILTER (WHERE variant = 'odd'), 6) AS odd FROM v GROUP BY model"))
def variant_pivot(spark, sf_dir):
    rows = r.results(spark, sf_dir).withColumn("variant", F.when(F.col("fold") % 2 == 0, "even").otherwise("odd"))
    return rounded(compare.matrix(rows.groupBy("model", "variant").agg(F.avg("f1").alias("f1")), "model", "variant", ["even", "odd"], "f1"))


@query("""SELECT o_orderkey, coalesce(nullif(concat_ws(', ', CASE WHEN o_orderpriority <> '1-URGENT' THEN concat('priority=', o_orderpriority) END, CASE WHEN o_orderstatus <> 'O' THEN concat('status=', o_orderstatus) END), ''), 'baseline') AS name,
CASE WHEN o_custkey % 4 = 0 THEN 'frames' ELSE concat('w', o_custkey % 30, '/s', o_orderkey % 7) END AS win FROM orders""")
def config_names(spark, sf_dir):
    """Orders as configurations, named by how they differ from a base, and by window."""
    o = table(spark, sf_dir, "orders")
    config = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    base = F.create_map(F.lit("status"), F.lit("O"), F.lit("priority"), F.lit("1-URGENT"))
    size = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 30)
    return o.select("o_orderkey", compare.config_diff(config, base).alias("name"), compare.window_name(size, F.col("o_orderkey") % 7).alias("win"))


_STAMPED = "st AS (SELECT source AS dataset, participant % 4 AS run, CAST(y AS VARCHAR) AS kind, count(*) AS n FROM timeline WHERE scored GROUP BY ALL)"


@query(sql(TIMELINE, _STAMPED, "bs AS (SELECT dataset, run, CAST(sum(n) AS BIGINT) AS n, string_agg(concat(kind, '=', n), ', ' ORDER BY kind) AS sources FROM st GROUP BY ALL)",
    "k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY run DESC) > 1 AS superseded FROM bs)", of="SELECT k.dataset, k.run, k.superseded, st.kind, st.n FROM k JOIN st USING (dataset, run)"))
def merged_runs(spark, sf_dir):
    """Runs of each corpus, the latest marked, and their breakdown as rows."""
    parts = timeline(spark, sf_dir).where("scored").groupBy(F.col("source").alias("dataset"), (F.col("participant") % 4).alias("run"), F.col("y").cast("string").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    records = parts.groupBy("dataset", "run").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("by_source"))
    return summary.latest(records, "dataset", "run").select("dataset", "run", "superseded", F.explode("by_source").alias("kind", "n"))


# -- statistics

_PAIRS = """s AS (SELECT dataset, model, round(avg(f1), 9) AS f1 FROM rs GROUP BY ALL),
pq AS (SELECT a.dataset AS corpus_a, b.dataset AS corpus_b, a.model AS m1, x.model AS m2, sign(x.f1 - a.f1) AS sa, sign(y.f1 - b.f1) AS sb
  FROM s a JOIN s b ON a.model = b.model AND a.dataset < b.dataset JOIN s x ON x.dataset = a.dataset AND x.model > a.model JOIN s y ON y.dataset = b.dataset AND y.model = x.model),
ct AS (SELECT corpus_a, corpus_b, count(*) AS pairs, sum(sa * sb) AS s, sum(sa * sa) AS ta, sum(sb * sb) AS tb, CAST(round((1 + sqrt(1 + 8 * count(*))) / 2) AS BIGINT) AS n FROM pq GROUP BY ALL)"""
# permutations of n by inversions, as far as the four detectors need them
_WAYS = """w1 AS (SELECT 1 AS n, 0 AS k, 1 AS ways), w2 AS (SELECT k + j AS k, sum(ways) AS ways FROM w1, (SELECT unnest(range(0, 2)) AS j) GROUP BY 1),
w3 AS (SELECT k + j AS k, sum(ways) AS ways FROM w2, (SELECT unnest(range(0, 3)) AS j) GROUP BY 1), w4 AS (SELECT k + j AS k, sum(ways) AS ways FROM w3, (SELECT unnest(range(0, 4)) AS j) GROUP BY 1)"""


# erfc(z): the power series below 2, where nothing cancels, and from there on the continued fraction, which is the better the larger z is
_ERFC = """(CASE WHEN z < 2 THEN 1 - 2 / sqrt(pi()) * (SELECT sum(power(-1, k) * power(z, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))) FROM (SELECT unnest(range(0, 100)) AS k))
  ELSE exp(-z * z) / sqrt(pi()) / list_reduce(range(100, 0, -1), lambda x, k: z + k / 2.0 / x, z) END)"""
_TIES = """tg AS (SELECT dataset, count(*) AS t FROM s GROUP BY dataset, f1),
ti AS (SELECT dataset, sum(t * (t - 1)) AS t1, sum(t * (t - 1) * (t - 2)) AS t2, sum(t * (t - 1) * (2 * t + 5)) AS tv FROM tg GROUP BY dataset),
z AS (SELECT ct.*, s / sqrt(ta * tb) AS tau, least((pairs - s) / 2, pairs - (pairs - s) / 2) AS c,
  (n * (n - 1) * (2 * n + 5) - a.tv - b.tv) / 18.0 + a.t1 * b.t1 / (2.0 * n * (n - 1)) + a.t2 * b.t2 / (9.0 * n * (n - 1) * (n - 2)) AS var
  FROM ct JOIN ti a ON a.dataset = corpus_a JOIN ti b ON b.dataset = corpus_b),
zz AS (SELECT *, abs(s) / sqrt(2 * var) AS z FROM z)"""


@query(sql(TIMELINE, r.RESULTS, _PAIRS, _WAYS, _TIES,
    of=f"""SELECT CAST(corpus_a AS VARCHAR) AS corpus_a, CAST(corpus_b AS VARCHAR) AS corpus_b, n, round(tau, 6) AS tau, CASE WHEN tau > 0.4 THEN 'agree' WHEN abs(tau) <= 0.4 THEN 'unrelated' ELSE 'inverted' END AS verdict,
round(CASE WHEN ta = pairs AND tb = pairs THEN CASE WHEN 2 * c = pairs THEN 1.0 ELSE least(1.0, 2.0 * (SELECT sum(ways) FROM w4 WHERE k <= c) / 24) END ELSE {_ERFC} END, 6) AS p FROM zz"""))  # fmt: skip
def kendall_tau(spark, sf_dir):
    """tau, p and verdict; the SQL counts the permutations of the four detectors, and has the error function where scores tie."""
    s = r.results(spark, sf_dir).groupBy(F.col("dataset").cast("string").alias("dataset"), F.col("model").alias("config")).agg(F.round(F.avg("f1"), 9).alias("f1"))
    return rounded(compare.kendall(s).select("corpus_a", "corpus_b", "n", "tau", "verdict", "p"))


@query(sql(TIMELINE, r.RESULTS, _PAIRS, _TIES, of="SELECT CAST(corpus_a AS VARCHAR) AS corpus_a, CAST(corpus_b AS VARCHAR) AS corpus_b, CAST(s AS BIGINT) AS s, CAST(pairs - ta AS BIGINT) AS tied_a, CAST(pairs - tb AS BIGINT) AS tied_b FROM z"))
def rank_counts(spark, sf_dir):
    """Concordant less discordant pairs of each two corpora, and tied ones, by counted inversions."""
    s = r.results(spark, sf_dir).groupBy(F.col("dataset").cast("string").alias("dataset"), "model").agg(F.round(F.avg("f1"), 9).alias("f1"))
    a, b = (s.select(F.col("dataset").alias(f"corpus_{x}"), "model", F.col("f1").alias(f"f1_{x}")) for x in "ab")
    out = compare.rank_counts(a.join(b, "model").where("corpus_a < corpus_b"), "f1_a", "f1_b", ["corpus_a", "corpus_b"])
    return out.select("corpus_a", "corpus_b", "s", (F.col("a1") / 2).cast("long").alias("tied_a"), (F.col("b1") / 2).cast("long").alias("tied_b"))


@query(sql(TIMELINE, r.RESULTS, "v AS (SELECT dataset, fold, model, round(f1, 9) AS f FROM rs)", "r AS (SELECT *, rank() OVER (PARTITION BY dataset, fold ORDER BY f) + (count(*) OVER (PARTITION BY dataset, fold, f) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY dataset, fold, f) AS t FROM v)",
    "s AS (SELECT dataset, model, sum(r) AS rr, count(*) AS n FROM r GROUP BY ALL)", "a AS (SELECT dataset, sum(rr * rr) AS ss, count(*) AS m, max(n) AS n FROM s GROUP BY dataset)", "b AS (SELECT dataset, sum(t * t - 1) AS t FROM r GROUP BY dataset)",
    "x AS (SELECT dataset, n AS n_folds, m AS n_configs, (12.0 / (n * m * (m + 1)) * ss - 3 * n * (m + 1)) / (1 - t / (n * m * (m * m - 1))) AS chi2 FROM a JOIN b USING (dataset))",
    "g AS (SELECT *, sqrt(greatest(chi2, 0) / 2) AS z FROM x)",
    of=f"SELECT dataset, n_folds, n_configs, round(chi2, 6) AS chi2, round({_ERFC} + 2 * z / sqrt(pi()) * exp(-z * z), 6) AS p FROM g"))
def friedman(spark, sf_dir):
    """With p: the SQL has the closed form of the chi-squared tail for the three degrees of freedom of four detectors."""
    return rounded(compare.friedman(r.config_scores(spark, sf_dir), keys="dataset"))


_WAYS_OF_RANKS = """wy AS (SELECT 0::BIGINT AS n, [1::HUGEINT] AS ways UNION ALL
  SELECT n + 1, list_transform(range(len(ways) + n + 1), lambda k: coalesce(ways[k + 1], 0) + CASE WHEN k > n THEN coalesce(ways[k - n], 0) ELSE 0 END) FROM wy WHERE n < 50)"""


@query(recursive(TIMELINE, r.RESULTS, _WAYS_OF_RANKS, "v AS (SELECT dataset, fold, model, round(f1, 9) AS f FROM rs)", "mn AS (SELECT dataset, model, avg(f) AS m FROM v GROUP BY ALL)",
    "be AS (SELECT dataset, model AS best FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY m DESC, model) AS rn FROM mn) WHERE rn = 1)",
    "di AS (SELECT v.dataset, be.best, v.model AS other, w.f - v.f AS d FROM v JOIN be USING (dataset) JOIN v w ON w.dataset = v.dataset AND w.fold = v.fold AND w.model = be.best WHERE v.model <> be.best)",
    "rk AS (SELECT *, rank() OVER q + (count(*) OVER (PARTITION BY dataset, other, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY dataset, other, abs(d)) AS t FROM di WHERE d <> 0 WINDOW q AS (PARTITION BY dataset, other ORDER BY abs(d)))",
    "a AS (SELECT dataset, best, other, avg(d) AS mean_diff, count(*) AS n_all FROM di GROUP BY ALL HAVING max(abs(d)) > 1e-8)", "c AS (SELECT dataset, other, count(*) AS n, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS plus, sum(t * t - 1) AS ties FROM rk GROUP BY ALL)",
    "e AS (SELECT a.*, n, ties, least(plus, n * (n + 1) / 2.0 - plus) AS w FROM a JOIN c USING (dataset, other))", "y AS (SELECT *, abs(w - n * (n + 1) / 4.0) / sqrt(2 * (n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)) AS z FROM e)",
    f"p AS (SELECT y.dataset, best, other, mean_diff, CASE WHEN y.n <= 50 AND ties = 0 AND y.n = n_all THEN least(1.0, 2.0 * list_sum(wy.ways[1:CAST(floor(w) AS BIGINT) + 1]) / power(2, y.n)) ELSE {_ERFC} END AS p FROM y LEFT JOIN wy ON wy.n = y.n)",
    "h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY p, other) + 1) * p) AS s FROM p)",
    of="SELECT dataset, best, other, round(mean_diff, 6) AS mean_diff, round(p, 6) AS p, round(max(s) OVER (PARTITION BY dataset ORDER BY p, other ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h"))
def wilcoxon_holm(spark, sf_dir):
    """The SQL counts sets of ranks by their sum where p is exact, and has the error function where it is normal."""
    return rounded(compare.wilcoxon_holm(r.config_scores(spark, sf_dir), keys="dataset"))


# -- models (rows only)


@query()
def forest_scores(spark, sf_dir):
    """Every scored row by a forest that did not see its participant, with the operator's own parameters."""
    rows = r.lagged(spark, sf_dir).where("scored")
    return rounded(experiment.unseen_rows(rows, r.FEATURES).select("session", "frame_index", "score", "y"))


@query()
def window_model_scores(spark, sf_dir):
    """Every window by a model that did not see its participant, held on frames."""
    wins = windows.sliding(r.lagged(spark, sf_dir), ["score", "k"], 8, 2, keep=("participant",))
    return rounded(windows.held(models.windows_out_of_fold(wins).select("session", "end_index", "p"), "p"))


@query()
def forest_importances(spark, sf_dir):
    """The most important features of a forest over all scored rows: a list of at most twenty."""
    rows = r.lagged(spark, sf_dir).where("scored")
    return rounded(experiment.importances(rows, r.FEATURES))
