"""Motion, pose and rule signals from landmark columns `l{i}_{axis}` of a keyed timeline.

Every ordered step uses one window (keys, order), so a whole feature plan has one exchange and one sort. Speeds are of
hand-scaled points in hand widths a second; the rule speed is of raw points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions import ranks
from tideframe.functions.expr import Key, over

AXES = ("x", "y", "z")
MEANS, DEVIATIONS, POINTS = (5, 15, 31), (15, 31), (("tip", 8), ("wrist", 0))


def landmarks(columns: list[str], prefix: str = "l") -> list[tuple[str, str, str]]:
    """(x, y, z) column names of the complete points, in the order of their numbers."""
    found: dict[int, set[str]] = {}
    for c in columns:
        if m := re.fullmatch(rf"{prefix}(\d+)_([xyz])", c):
            found.setdefault(int(m[1]), set()).add(m[2])
    return [tuple(f"{prefix}{i}_{a}" for a in AXES) for i in sorted(found) if found[i] == set(AXES)]


def feature_order(columns: list[str], pose: str = "image", motion: bool = True, pose_features: bool = True, velocity: bool = False) -> list[str]:
    """The ordered feature list: hand flag, pose, motion, velocities (76 of them by default)."""
    names = ["hand_detected"]
    if pose_features:
        names += [c for p in landmarks(columns, "wl" if pose == "world" else "l") for c in p]
    if motion:
        for label, _ in POINTS:
            names += [f"mot_{label}_speed", *(f"mot_{label}_speed_m{n}" for n in MEANS), *(f"mot_{label}_speed_sd{n}" for n in DEVIATIONS)]
    if velocity:
        names += [f"d_{c}" for p in landmarks(columns) for c in p]
    return names


def family_counts(features: list[str]) -> dict[str, int]:
    kind = lambda f: "motion" if f.startswith("mot_") else "velocity" if f.startswith("d_") else "pose" if re.fullmatch(r"w?l\d+_[xyz]", f) else "other"
    out: dict[str, int] = {}
    for f in features:
        out[kind(f)] = out.get(kind(f), 0) + 1
    return out


def drop_undetected(df: DataFrame, hand: str = "hand_detected") -> DataFrame:
    return df.where(F.col(hand) == 1)


def dropped(df: DataFrame, keys: Key = (), hand: str = "hand_detected") -> DataFrame:
    """keys, rows, dropped: how many rows drop_undetected leaves out."""
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(F.col(hand) == 1, F.lit(False))).alias("dropped"))


def _distance(i: int, j: int) -> Column:
    return F.sqrt(F.pow(F.col(f"l{i}_x") - F.col(f"l{j}_x"), 2) + F.pow(F.col(f"l{i}_y") - F.col(f"l{j}_y"), 2))


def hand_scale(df: DataFrame, hand: str = "hand_detected", a: int = 9, b: int = 0, name: str = "scale") -> DataFrame:
    """df with the distance of two points; rows without a hand, or with none to speak of, take the median of all good rows (1 without any)."""
    d = _distance(a, b)
    good = F.when((F.col(hand) == 1) & (d > 1e-6), d)
    middle = ranks.percentiles(df.select(good.alias("d")), "d", [0.5]).agg(F.max(F.try_element_at("percentiles", F.lit(1))).alias("_middle"))  # one row
    return ranks.same_keys(df, F.broadcast(middle), []).withColumn(name, F.coalesce(good, F.col("_middle"), F.lit(1.0))).drop("_middle")


def point_speed(df: DataFrame, x: Column, y: Column, dt: str = "dt", detected: Column | None = None, keys: Key = "session", order: str = "frame_index") -> Column:
    """Distance to the row before over dt. A row without a hand breaks the difference; what has none is 0."""
    w = over(keys, order)
    seen = (lambda c: c) if detected is None else (lambda c: F.when(detected, c))
    dx, dy = (seen(c) - F.lag(seen(c)).over(w) for c in (x, y))
    return F.coalesce(F.sqrt(dx * dx + dy * dy) / F.col(dt), F.lit(0.0))


def motion(df: DataFrame, keys: Key = "session", order: str = "frame_index", dt: str = "dt", hand: str = "hand_detected", causal: bool = True, scale: str = "scale") -> DataFrame:
    """Speeds of two points with rolling means (one row is enough) and deviations (n - 1; 0 under two rows), trailing or centred."""
    w, names = over(keys, order), {}
    for label, i in POINTS:
        df = df.withColumn(f"mot_{label}_speed", point_speed(df, F.col(f"l{i}_x") / F.col(scale), F.col(f"l{i}_y") / F.col(scale), dt, F.col(hand) == 1, keys, order))
    frame = lambda n: w.rowsBetween(-(n - 1), 0) if causal else w.rowsBetween(-(n // 2), (n - 1) // 2)
    for label, _ in POINTS:
        speed = f"mot_{label}_speed"
        names |= {f"{speed}_m{n}": F.avg(speed).over(frame(n)) for n in MEANS}
        names |= {f"{speed}_sd{n}": F.coalesce(F.stddev_samp(speed).over(frame(n)), F.lit(0.0)) for n in DEVIATIONS}
    return df.withColumns(names)


def rule_signals(df: DataFrame, keys: Key = "session", order: str = "frame_index", dt: str | None = "dt", hand: str = "hand_detected", smooth: int = 5) -> DataFrame:
    """heur_speed: raw fingertip speed in a centred mean; heur_extension: how much further the fingertip is from the wrist than three others, in palms."""
    w = over(keys, order).rowsBetween(-(smooth // 2), (smooth - 1) // 2)
    rows = df.withColumn("_dt", F.col(dt) if dt else F.lit(1.0))
    rows = rows.withColumn("_raw", point_speed(rows, F.col("l8_x"), F.col("l8_y"), "_dt", F.col(hand) == 1, keys, order))
    palm = _distance(9, 0)
    extension = (_distance(8, 0) - (_distance(12, 0) + _distance(16, 0) + _distance(20, 0)) / 3) / palm
    good = (F.col(hand) == 1) & (palm > 0)
    return rows.withColumns({"heur_speed": F.avg("_raw").over(w), "heur_extension": F.when(good, extension).otherwise(0.0)}).drop("_dt", "_raw")


def wrist_normalised(df: DataFrame, points: list[tuple[str, str, str]]) -> DataFrame:
    """Points less the first point, over the largest distance from it (1 if that is 0)."""
    first = points[0]
    moved = {c: F.col(c) - F.col(o) for p in points for c, o in zip(p, first, strict=True)}
    squares = [sum((moved[c] * moved[c] for c in p[1:]), moved[p[0]] * moved[p[0]]) for p in points]
    span = F.sqrt(F.greatest(*squares)) if len(squares) > 1 else F.sqrt(squares[0])
    df = df.withColumn("_span", F.when(span > 0, span).otherwise(1.0))
    return df.withColumns({c: e / F.col("_span") for c, e in moved.items()}).drop("_span")


def canonical_hand(df: DataFrame, points: list[tuple[str, str, str]], relative: bool = True, handedness: str = "handedness", aspect: str = "aspect") -> DataFrame:
    """Left hands mirrored in x: negated where x is relative to the hand, else taken from the aspect (the picture's width; 1 where it isn't known)."""
    left = F.coalesce(F.col(handedness) == "Left", F.lit(False))
    width = F.coalesce(F.col(aspect), F.lit(1.0)) if aspect in df.columns else F.lit(1.0)
    mirrored = (lambda c: -F.col(c)) if relative else (lambda c: width - F.col(c))
    return df.withColumns({p[0]: F.when(left, mirrored(p[0])).otherwise(F.col(p[0])) for p in points})


def velocities(df: DataFrame, points: list[tuple[str, str, str]], keys: Key = "session", order: str = "frame_index") -> DataFrame:
    """d_<column>: difference to the row before, 0 at a session's first row."""
    w = over(keys, order)
    return df.withColumns({f"d_{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for p in points for c in p})


def world_pose(df: DataFrame, hand: str = "hand_detected") -> DataFrame:
    """World landmarks with nulls of rows without a hand as 0; a row with a hand must have all of them."""
    points = landmarks(df.columns, "wl")
    columns = [c for p in points for c in p]
    if len(points) < 21:
        raise ValueError("world landmarks are incomplete")
    if not df.where((F.col(hand) == 1) & F.greatest(*(F.col(c).isNull().cast("int") for c in columns)).cast("boolean")).isEmpty():
        raise ValueError("world landmarks are missing on rows with a hand")
    return df.fillna(0.0, columns)


def prepare(df: DataFrame, pose: str = "image", with_motion: bool = True, with_pose: bool = True, with_velocity: bool = False, causal: bool = True, mirror: bool = True, normalise: bool = True, keys: Key = "session", order: str = "frame_index") -> tuple[DataFrame, list[str]]:
    """The feature plan in its fixed order: rule signals, motion, wrist normalisation of the pose points, mirroring, velocities. Needs dt (repaired_steps).

    The pose points are the picture's or, with pose='world', the world's, which replace them as features; signals and motion are of the
    picture's points before normalisation. Velocities are of the picture's points as they are then: raw ones if the pose is the world's.
    Without normalisation (normalise=False) world points are mirrored about the hand all the same, the picture's about its middle.
    """
    points = landmarks(df.columns)
    df = rule_signals(df, keys, order)
    if with_motion:
        df = motion(hand_scale(df), keys, order, causal=causal)
    if pose == "world":
        df = world_pose(df)
    chosen = landmarks(df.columns, "wl") if pose == "world" else points
    if normalise:
        df = wrist_normalised(df, chosen)
    if mirror and "handedness" in df.columns:
        df = canonical_hand(df, chosen, relative=normalise or pose == "world")
    if with_velocity:
        df = velocities(df, points, keys, order)
    return df, feature_order(df.columns, pose, with_motion, with_pose, with_velocity)


#: The runs that the reference compares with the default: arguments of prepare.
ABLATIONS = {
    "default": {}, "no_motion": {"with_motion": False}, "motion_only": {"with_pose": False}, "velocity": {"with_velocity": True}, "world": {"pose": "world"},
    "no_mirror": {"mirror": False}, "centred": {"causal": False}, "no_aspect": {}, "native_rate": {},
}


def ablations(df: DataFrame, variants: dict[str, dict], keep: list[str], inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of each variant (name -> arguments of prepare) under one another: variant, keep, and its features as one map.

    Variants differ in their features, so these are a map from name to value. inputs: rows of variants that don't start from df, such as
    those without aspect correction or at their native rate.
    """
    out = None
    for name, args in variants.items():
        rows, features = prepare((inputs or {}).get(name, df), **args)
        values = F.create_map(*(x for f in features for x in (F.lit(f), F.col(f).cast("double"))))
        rows = rows.select(F.lit(name).alias("variant"), *keep, values.alias("features"))
        out = rows if out is None else out.unionByName(rows)
    return out
