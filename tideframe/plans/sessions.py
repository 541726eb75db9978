"""Queries over one session of all rows: what no single task could order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions import blocks
from tideframe.operators import features, long
from tideframe.plans import registry as r
from tideframe.plans.views import POSES, TIMELINE, poses, timeline

#: All users' rows after one another as one session.
ONE = """one AS (SELECT 0 AS session, row_number() OVER (ORDER BY t.session, t.frame_index) - 1 AS frame_index, t.session AS user_id, t.frame_index AS user_row,
  participant, source, timestamp_ms, label, score, y, scored, hand_detected FROM timeline t)"""


def one_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).withColumnsRenamed({"session": "user_id", "frame_index": "user_row"}).withColumn("session", F.lit(0))
    return blocks.dealt(rows, "session", ["user_id", "user_row"])


_HYST = r.HYST.replace("FROM timeline", "FROM one")
assert _HYST != r.HYST
_SMOOTH = ",\n".join([_HYST, r._filled("hyst", 0, 3, "fill"), r._filled("fill", 1, 3, "smooth")])


@r.query(r.sql(TIMELINE, ONE, _SMOOTH, of="SELECT o.user_id, o.user_row, s.pred FROM smooth s JOIN one o USING (frame_index)"))
def long_decisions(spark, sf_dir):
    rows = long.hysteresis(one_session(spark, sf_dir), "score", r.LOW, r.HIGH)
    return long.least_durations(rows, "pred", 3, 3).select("user_id", "user_row", "pred")


_RUNS = r._runs_sql("one", "y", "g")


@r.query(r.sql(TIMELINE, ONE, _RUNS, of="SELECT CASE WHEN v = 1 THEN 'event' ELSE 'pause' END AS kind, s AS start, e AS \"end\" FROM g WHERE n >= 3 AND (v = 1 OR run > 0 AND run < last)"))
def long_events(spark, sf_dir):
    rows = one_session(spark, sf_dir)
    both = long.events(rows, "y").withColumn("kind", F.lit("event")).unionByName(long.pauses(rows, "y").withColumn("kind", F.lit("pause")))
    return both.select("kind", "start", "end")


@r.query(r.sql(TIMELINE, ONE, r.CUT.format("one"), of="SELECT user_id, user_row, CAST(sub AS BIGINT) AS sub FROM cut"))
def long_split(spark, sf_dir):
    return long.split_unscored(one_session(spark, sf_dir)).select("user_id", "user_row", "sub")


@r.query(r.sql(TIMELINE, """b AS (SELECT min(timestamp_ms) AS t0, max(timestamp_ms) AS t1 FROM timeline),
c AS (SELECT tick, t0 + tick * 600000 AS moment FROM (SELECT t0, unnest(generate_series(0, CAST(floor((t1 + 1e-6 - t0) / 600000.0) AS BIGINT))) AS tick FROM b)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timestamp_ms ORDER BY session DESC, frame_index DESC) AS rn FROM timeline) WHERE rn = 1)""",
    of="SELECT tick AS frame_index, moment AS timestamp_ms, l.session AS user_id, l.frame_index AS source_frame_index FROM c ASOF JOIN l ON c.moment >= l.timestamp_ms"))
def long_resample(spark, sf_dir):
    """All rows on one clock of ten minutes, by time."""
    rows = timeline(spark, sf_dir).select(F.lit(0).alias("session"), F.col("session").alias("user_id"), "frame_index", "timestamp_ms")
    return long.resample(blocks.dealt(rows, "session", ["timestamp_ms", "user_id", "frame_index"]), 1 / 600, ["user_id", "frame_index", "timestamp_ms"])


_ONE_POSES = POSES.replace("label AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id)", "0 AS session, row_number() OVER (ORDER BY vec_id)")
assert _ONE_POSES != POSES


@r.query(r.sql(_ONE_POSES, r.STEPS, r.SCALE, r.MOTION, of=f"SELECT frame_index, {r._rolled(True)} FROM mo"))
def long_motion(spark, sf_dir):
    """Repaired steps, hand scale, speeds and their rolling means and deviations over one session."""
    rows = blocks.dealt(poses(spark, sf_dir).drop("session", "frame_index", "timestamp_ms").withColumn("session", F.lit(0)), "session", ["vec_id"])
    rows = blocks.positions(rows, "session", "frame_index").withColumn("timestamp_ms", F.col("frame_index") * 33 + F.pmod("vec_id", F.lit(3)))
    rows = features.hand_scale(long.repaired_steps(rows, "session"))
    # a rolling value looks 30 rows back, and their speeds one row more
    rows = blocks.local(rows, "session", max(*features.MEANS, *features.DEVIATIONS), 0, lambda x, k, order: features.motion(x, k, order))
    return r.rounded(rows.select("frame_index", *r._ROLLED), 4)
