"""The given tables as timelines, in Spark and as the text of the equal DuckDB query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a labelled, scored timeline: session is the user, order is the time, the label comes from the kind of event."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = F.when(F.col("event_type").isin("click", "view", "purchase"), "writing").when(F.col("event_type") == "signup", "not_writing").otherwise("unsure")
    return e.select(
        F.col("user_id").alias("session"), F.floor(F.col("user_id") / 10).alias("participant"), (F.col("user_id") % 3).alias("source"),
        (F.row_number().over(w) - 1).cast("long").alias("frame_index"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("timestamp_ms"), label.alias("label"),
        (F.col("value") / (F.col("value") + 50)).alias("score"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value",
    ).withColumns({"hand_detected": (F.col("k") >= 12).cast("int"), "y": (F.col("label") == "writing").cast("int"), "scored": F.col("label") != "unsure"})


TIMELINE = """timeline AS (
  SELECT user_id AS session, CAST(floor(user_id / 10) AS BIGINT) AS participant, user_id % 3 AS source,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, epoch_us(ts) // 1000 AS timestamp_ms,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'writing' WHEN event_type = 'signup' THEN 'not_writing' ELSE 'unsure' END AS label,
         value / (value + 50) AS score, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, value,
         CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 12 THEN 1 ELSE 0 END AS hand_detected,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS y,
         event_type <> 'error' AS scored
  FROM events)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 21 points of three coordinates: the first number is the hand flag, the label the session."""
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    points = [F.element_at("embedding", 2 + 3 * i + a).cast("double").alias(f"l{i}_{x}") for i in range(21) for a, x in enumerate("xyz")]
    rows = e.select(F.col("label").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("frame_index"), "vec_id", F.when(F.element_at("embedding", 1) > -0.1, 1).otherwise(0).alias("hand_detected"), *points)
    return rows.withColumns({"timestamp_ms": F.col("frame_index") * 33 + F.pmod("vec_id", F.lit(3)), "handedness": F.when(F.col("vec_id") % 4 == 0, "Left").otherwise("Right"), "aspect": F.lit(4 / 3)})


_POINTS = ", ".join(f"CAST(embedding[{2 + 3 * i + a}] AS DOUBLE) AS l{i}_{x}" for i in range(21) for a, x in enumerate("xyz"))
POSES = f"""poses AS (
  SELECT *, frame_index * 33 + vec_id % 3 AS timestamp_ms, CASE WHEN vec_id % 4 = 0 THEN 'Left' ELSE 'Right' END AS handedness, 4.0 / 3 AS aspect
  FROM (SELECT label AS session, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, vec_id,
               CASE WHEN embedding[1] > CAST(-0.1 AS DOUBLE) THEN 1 ELSE 0 END AS hand_detected, {_POINTS} FROM embeddings))"""
