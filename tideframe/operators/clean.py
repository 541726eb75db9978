"""From raw rows to a labelled timeline: joins, quarantine, flags, aspect ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions import ranks
from tideframe.functions.expr import Key, names, scored, truthy

VOCABULARY = ("writing", "not_writing", "unsure")


def exclude(df: DataFrame, participants: list[str], column: str = "participant") -> DataFrame:
    """Rows of other participants; the filter is a plain predicate, so it reaches the scan and prunes partitions. Null participants stay."""
    return df.where(~F.coalesce(F.col(column).isin(*participants), F.lit(False))) if participants else df


def with_labels(frames: DataFrame, labels: DataFrame, keys: Key = ("source", "session"), order: str = "frame_index") -> DataFrame:
    """Rows that have a label row; several label rows of one frame multiply it."""
    return frames.join(labels, [*names(keys), order], "inner")


def quarantine(df: DataFrame, keys: Key = "session", label: str = "label", vocabulary=VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Rows of the sessions whose labels are all in the vocabulary (nulls aside), and keys and unknown labels of the other sessions."""
    k = names(keys)
    unknown = F.array_except(F.collect_set(label), F.array(*map(F.lit, vocabulary)))
    bad = df.groupBy(*k).agg(F.array_sort(unknown).alias("unknown_labels")).where(F.size("unknown_labels") > 0)
    return df.join(bad, k, "left_anti"), bad


def flags(df: DataFrame, label: str = "label", hand: str = "hand_detected") -> DataFrame:
    return df.withColumns({"scored": scored(label), hand: truthy(hand)})


def resolved_aspect(width: Column, height: Column, aspect: Column, legacy: Column) -> tuple[Column, Column]:
    """Aspect and where it is from: the size, else the recorded aspect, else the legacy file, else unknown. Zero counts as missing."""
    some = lambda c: F.when(c != 0, c)
    size = some(width) / some(height)
    return F.coalesce(size, some(aspect), some(legacy)), F.when(size.isNotNull(), "size").when(some(aspect).isNotNull(), "aspect").when(some(legacy).isNotNull(), "legacy").otherwise("unknown")


def with_aspect(df: DataFrame, meta: DataFrame, legacy: DataFrame, keys: Key = ("source", "session")) -> DataFrame:
    """df with aspect and aspect_from. meta: keys, width, height, aspect; legacy: key (`source/session`), aspect.

    Both tables have a row a session, so Spark broadcasts them while they are small.
    """
    k = names(keys)
    m = meta.select(*k, "width", "height", F.col("aspect").alias("meta_aspect"))
    old = legacy.select(F.col("key").alias("_key"), F.col("aspect").alias("legacy_aspect"))
    key = F.concat_ws("/", *k)
    rows = df.join(m, k, "left").withColumn("_key", key).join(old, "_key", "left")
    aspect, origin = resolved_aspect(F.col("width"), F.col("height"), F.col("meta_aspect"), F.col("legacy_aspect"))
    return rows.withColumns({"aspect": aspect, "aspect_from": origin}).drop("_key", "width", "height", "meta_aspect", "legacy_aspect")


def legacy_aspect(df: DataFrame, legacy: DataFrame, source: str = "source", session: str = "session") -> DataFrame:
    """df with legacy_aspect by `source/session`; only if no row at all has one, by what follows the last ':' of the session. Exactly 1.0 is unknown."""
    old = legacy.select(F.col("key").alias("_key"), F.when(F.col("aspect") != 1.0, F.col("aspect")).alias("legacy_aspect"))
    whole = df.withColumn("_key", F.concat_ws("/", source, session)).join(old, "_key", "left").drop("_key")
    if not whole.where("legacy_aspect is not null").isEmpty():
        return whole
    tail = F.concat_ws("/", F.col(source), F.element_at(F.split(F.col(session), ":"), -1))
    return df.withColumn("_key", tail).join(old, "_key", "left").drop("_key")


def correct_aspect(df: DataFrame, x_columns: list[str], require: bool = True, hand: str = "hand_detected", session: str = "session", aspect: str = "aspect") -> DataFrame:
    """x times aspect on rows with a hand. Sessions of unknown aspect are refused, or left as they are (require=False)."""
    if require:
        missing = [r[0] for r in df.where(F.col(aspect).isNull()).select(session).distinct().orderBy(session).limit(10).collect()]
        if missing:
            raise ValueError(f"aspect ratio unknown for sessions {missing}")
    factor = F.when(F.col(hand) == 1, F.coalesce(F.col(aspect), F.lit(1.0))).otherwise(F.lit(1.0))
    return df.withColumns({c: F.col(c) * factor for c in x_columns})


def listed(df: DataFrame, value: str, most: int, group: Key = (), name: str = "first") -> DataFrame:
    """group, <name>: the first `most` distinct values in their order, and n_<name>, how many there are. For display: no list is longer than `most`."""
    g = names(group)
    distinct = df.where(F.col(value).isNotNull()).select(*g, value).distinct()
    shown = distinct.withColumn("_rank", F.row_number().over(Window.partitionBy(*g).orderBy(value))).where(F.col("_rank") <= most)
    lists = shown.groupBy(*g).agg(F.array_sort(F.collect_list(value)).alias(name))
    return ranks.same_keys(distinct.groupBy(*g).agg(F.count(F.lit(1)).alias(f"n_{name}")), lists, g)


def namespaced(df: DataFrame, source: str = "source", participant: str = "participant", also: tuple[str, ...] = ("session",)) -> DataFrame:
    """`source:id` in place of every id where any participant occurs in several sources; else unchanged."""
    shared = not df.groupBy(participant).agg(F.count_distinct(source).alias("n")).where("n > 1").isEmpty()
    return df.withColumns({c: F.concat_ws(":", source, c) for c in (participant, *also)}) if shared else df


def combined(frames: dict[str, DataFrame], features: dict[str, list[str]]) -> DataFrame:
    """Union by name of corpora with equal features, ids namespaced where they must be. Refuses fewer than two, or differing features."""
    if len(frames) < 2:
        raise ValueError("at least two corpora are needed")
    if len({tuple(features[name]) for name in frames}) > 1:
        raise ValueError("feature columns differ between corpora")
    out = None
    for name, df in frames.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return namespaced(out)


def profile(df: DataFrame, group: Key = (), session: str = "session", participant: str = "participant", label: str = "label", hand: str = "hand_detected") -> DataFrame:
    """Per group: sessions, participants, rows, scored rows, rows without a hand, share of writing (4 places), rows by label."""
    g = names(group)
    counts = df.groupBy(*g).agg(
        F.count_distinct(session).alias("sessions"), F.count_distinct(participant).alias("participants"), F.count(F.lit(1)).alias("rows"),
        F.count_if(scored(label)).alias("scored_rows"), F.count_if(F.col(hand) == 0).alias("no_hand_rows"),
        F.bround(F.avg(F.coalesce(F.col(label) == "writing", F.lit(False)).cast("int")), 4).alias("writing_share"),
        *(F.count_if(F.coalesce(F.col(label) == v, F.lit(False))).alias(f"{v}_rows") for v in VOCABULARY),
    )
    return counts


def seen(df: DataFrame, columns: list[str], group: Key = (), session: str = "session") -> DataFrame:
    """group, what, value, sessions: how many sessions have each value of each column (resolution, schema version, origin of the aspect, rate); null is 'unknown'.

    A session with several values counts at each of them.
    """
    g = names(group)
    pairs = F.array(*(F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns))
    return df.select(*g, session, F.inline(pairs)).groupBy(*g, "what", "value").agg(F.count_distinct(session).alias("sessions"))
