"""Session exports on disk: `<root>/P###/S###/{landmarks,labels}.csv` and metadata.json, read as tables by Spark.

Paths are whatever Spark reads; nothing here opens a file itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.expr import number, scored, truthy
from tideframe.functions.staging import staged
from tideframe.operators import clean, timing
from tideframe.sources import formats

POINTS = range(21)
#: A line with this cell is a header; columns may stand in any order.
IS_HEADER = r'(^|,)\s*"?frame_index"?\s*(,|\r?$)'
LANDMARKS = [f"l{i}_{a}" for i in POINTS for a in "xyz"]
WORLD = [f"wl{i}_{a}" for i in POINTS for a in "xyz"]
_PLACE = r"([^/]+)/([^/]+)/[^/]+$"
META = T.StructType([
    T.StructField("schema_version", T.LongType()),
    T.StructField("video", T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("aspect", T.DoubleType())])),
])
RESOLUTION = T.StructType([T.StructField(n, t) for n, t in (("width", T.LongType()), ("height", T.LongType()), ("aspect", T.DoubleType()), ("fps", T.DoubleType()), ("frames", T.LongType()), ("video", T.StringType()))])
RESOLUTIONS = T.StructType([T.StructField("sessions", T.MapType(T.StringType(), RESOLUTION)), T.StructField("missing", T.ArrayType(T.StringType()))])


def _placed(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    participant, session = F.regexp_extract(path, _PLACE, 1), F.regexp_extract(path, _PLACE, 2)
    return df.select("*", participant.alias("participant"), F.concat_ws("/", participant, session).alias("session"))


def read_landmarks(spark: SparkSession, root: str) -> DataFrame:
    """Frames of all sessions. Values are read as text by header and cast, as sessions differ in columns and in how they write true.

    Files are read by their own headers, in which columns may stand in any order, one group of equal headers at a time: under one
    schema Spark would bind columns by position. There are as many groups as kinds of export, not as sessions. A file
    without such a header is refused.
    """
    glob = f"{root}/*/S*/landmarks.csv"
    lines = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("path"))
    heads = lines.groupBy("path").agg(F.max(F.when(F.col("value").rlike(IS_HEADER), F.regexp_replace("value", "^\uFEFF|\r$", ""))).alias("header"))
    heads = staged(heads, "headers")  # a row a file
    bad = heads.where("header is null").limit(3).collect()
    if bad:
        raise ValueError(f"no header with frame_index in {[r['path'] for r in bad]}")
    out = None
    for (header,) in heads.select("header").distinct().orderBy("header").collect():
        columns = [c.strip().strip('"') for c in header.split(",")]
        paths = [r["path"] for r in heads.where(F.col("header") == header).select("path").collect()]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        rows = _placed(spark.read.schema(schema).option("header", True).csv(paths))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no sessions under {root}")
    return typed(out)


def typed(frames: DataFrame) -> DataFrame:
    """Text columns of landmarks as numbers and flags."""
    kinds = {"frame_index": F.col("frame_index").cast("long"), "hand_detected": truthy("hand_detected")}
    kinds |= {c: number(c) for c in frames.columns if c in LANDMARKS or c in WORLD or c in ("timestamp_ms", "detection_confidence", "tracking_confidence")}
    return frames.withColumns(kinds)


def read_tree(spark: SparkSession, root: str, *more: str) -> DataFrame:
    """read_landmarks() by the `sessions` data source: tasks find the files of a participant and read each once; usual columns and `more`, null where a file hasn't them."""
    formats.register(spark)
    schema = ", ".join(f"`{c}` string" for c in dict.fromkeys([*formats.COLUMNS, *more]))
    return typed(spark.read.format("sessions").schema(schema).load(root))


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    rows = _placed(spark.read.schema("frame_index long, label string").option("header", True).csv(f"{root}/*/S*/labels.csv"))
    return rows.select("session", "frame_index", "label")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """session, schema_version (1 where it isn't given), width, height, aspect; malformed files give nulls, absent ones no row."""
    rows = spark.read.schema(META).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "metadata.json").json(f"{root}/*/S*")
    return _placed(rows).select("session", F.coalesce("schema_version", F.lit(1)).alias("schema_version"), F.col("video.width").alias("width"), F.col("video.height").alias("height"), F.col("video.aspect").alias("aspect"))


def read_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """key (`source/P###/S###`), width, height, aspect (of the size if that is given), fps, frames, video."""
    rows = spark.read.schema(RESOLUTIONS).option("multiLine", True).json(path)
    rows = rows.select(F.explode("sessions").alias("key", "r")).select("key", "r.*")
    return rows.withColumn("aspect", F.coalesce(F.when(F.col("height") != 0, F.col("width") / F.col("height")), "aspect"))


def load(spark: SparkSession, root: str, source: str, exclude: list[str] | None = None, fps: float | None = None, legacy: DataFrame | None = None, reader: Callable[[SparkSession, str], DataFrame] = read_landmarks) -> tuple[DataFrame, DataFrame]:
    """The timeline of a corpus (landmarks joined with labels, aspect resolved, put on a common clock if fps is given), and the sessions left out.

    Sessions with an empty join or an unknown label are left out whole and listed with their unknown labels. reader: read_tree for
    trees of many sessions, read_landmarks where columns that nobody named are to be kept.
    """
    frames = clean.exclude(reader(spark, root), exclude or [])
    rows = clean.with_labels(frames, read_labels(spark, root), "session").withColumn("source", F.lit(source))
    good, bad = clean.quarantine(rows)
    empty = frames.select("session").distinct().join(rows.select("session").distinct(), "session", "left_anti")
    bad = bad.unionByName(empty.withColumn("unknown_labels", F.array().cast("array<string>")))
    try:
        meta = read_metadata(spark, root)
    except Exception as e:  # no metadata file in any session
        if "PATH_NOT_FOUND" not in str(e):
            raise
        meta = spark.createDataFrame([], "session string, schema_version long, width long, height long, aspect double")
    legacy = legacy if legacy is not None else spark.createDataFrame([], "key string, aspect double")
    out = clean.with_aspect(good, meta.withColumn("source", F.lit(source)), legacy)
    out = out.withColumn("scored", scored())
    if fps and "timestamp_ms" in out.columns and not out.where("timestamp_ms is not null").isEmpty():
        out = timing.resample(out, fps)
    return out, bad
