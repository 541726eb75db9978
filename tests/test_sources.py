"""Session trees on disk, quarantine, aspect, features and models end to end on small synthetic sessions."""

import json
import math

import pytest

from tideframe.functions.staging import staged
from tideframe.operators import clean, features, folds, models, timing
from tideframe.sources import results, sessions


def export(root, participant, session, n, fps, label="writing", size=(640, 480), hand="Right", points=True):
    d = root / participant / session
    d.mkdir(parents=True)
    columns = ["frame_index", "timestamp_ms", "hand_detected", *sessions.LANDMARKS, *(["handedness"] if hand else [])]
    lines = [",".join(columns)]
    for i in range(n):
        values = [math.sin(i / 9 + k) * 0.1 + 0.5 for k in range(63)]
        lines.append(",".join(map(str, [i, round(i * 1000 / fps), "True" if i % 7 else "False", *values, *([hand] if hand else [])])))
    (d / "landmarks.csv").write_text("\n".join(lines) + "\n")
    (d / "labels.csv").write_text("frame_index,label\n" + "".join(f"{i},{label if i % 3 else 'not_writing'}\n" for i in range(n)))
    if size:
        (d / "metadata.json").write_text(json.dumps({"schema_version": 2, "video": {"width": size[0], "height": size[1]}}))


def test_corpus(spark, tmp_path):
    export(tmp_path, "P001", "S001", 60, 30)
    export(tmp_path, "P002", "S002", 120, 60, size=(1080, 1920), hand="Left")
    export(tmp_path, "P003", "S003", 30, 30, label="maybe")
    export(tmp_path, "P004", "S004", 30, 30, size=None, hand=None)
    (tmp_path / "P004/S004/metadata.json").write_text("{not json")
    rows, bad = sessions.load(spark, f"file://{tmp_path}", "own", fps=30.0)
    assert [(r["session"], r["unknown_labels"]) for r in bad.collect()] == [("P003/S003", ["maybe"])]
    n = {r["session"]: r["count"] for r in rows.groupBy("session").count().collect()}
    assert n["P001/S001"] == 60 and 58 <= n["P002/S002"] <= 61 and n["P004/S004"] == 30
    aspects = {r["session"]: (r["aspect"], r["aspect_from"]) for r in rows.select("session", "aspect", "aspect_from").distinct().collect()}
    assert aspects["P002/S002"] == (0.5625, "size") and aspects["P004/S004"] == (None, "unknown")
    with pytest.raises(ValueError, match="P004/S004"):
        clean.correct_aspect(rows, ["l0_x"])
    assert clean.correct_aspect(rows, ["l0_x"], require=False).count() == rows.count()
    profile = clean.profile(rows, "source").first()
    assert profile["sessions"] == 3 and profile["rows"] == rows.count()
    excluded, _ = sessions.load(spark, f"file://{tmp_path}", "own", exclude=["P001"])
    assert "P001/S001" not in {r["session"] for r in excluded.select("session").distinct().collect()}


def test_resolutions(spark, tmp_path):
    path = tmp_path / "resolutions.json"
    path.write_text(json.dumps({"sessions": {"own/P1/S1": {"width": 640, "height": 480}, "own/P2/S2": {"aspect": 1.0}}, "missing": []}))
    old = sessions.read_resolutions(spark, f"file://{path}")
    df = spark.createDataFrame([("own", "P1/S1"), ("own", "P2/S2"), ("own", "P3/S3")], "source string, session string")
    got = {r["session"]: r["legacy_aspect"] for r in clean.legacy_aspect(df, old).collect()}
    assert got == {"P1/S1": pytest.approx(4 / 3), "P2/S2": None, "P3/S3": None}
    tail = clean.legacy_aspect(df.selectExpr("source", "concat('x:', session) as session"), old)
    assert {r["session"]: r["legacy_aspect"] for r in tail.collect()}["x:P1/S1"] == pytest.approx(4 / 3)


def test_features_and_mirror(spark, tmp_path):
    export(tmp_path, "P001", "S001", 50, 30)
    export(tmp_path, "P002", "S001", 50, 30, hand="Left")
    rows, _ = sessions.load(spark, f"file://{tmp_path}", "own")
    out, names = features.prepare(timing.repaired_steps(clean.correct_aspect(rows, ["l0_x", "l8_x"])))
    assert len(names) == 76 and features.family_counts(names) == {"other": 1, "pose": 63, "motion": 12}
    assert set(names) <= set(out.columns)
    plain, _ = features.prepare(timing.repaired_steps(clean.correct_aspect(rows, ["l0_x", "l8_x"])), mirror=False)
    a = {(r["session"], r["frame_index"]): r for r in out.collect()}
    for r in plain.collect():
        b = a[r["session"], r["frame_index"]]
        sign = -1 if r["handedness"] == "Left" else 1
        assert b["l8_x"] == pytest.approx(sign * r["l8_x"]) and b["l8_y"] == r["l8_y"] and b["mot_tip_speed_m5"] == r["mot_tip_speed_m5"]


def test_models_and_folders(spark, tmp_path):
    data = [("p%d" % (i % 4), f"s{i % 4}", i // 4, float((i * 37) % 100), int((i * 37) % 100 > 50), True) for i in range(160)]
    df = spark.createDataFrame(data, "participant string, session string, frame_index int, x double, y int, scored boolean").withColumn("label", __import__("pyspark").sql.functions.expr("if(y = 1, 'writing', 'not_writing')"))
    table = folds.leave_one_out(folds.unit_table(df))
    rows = models.rule_scores(staged(folds.assigned(df, table)), "x")
    assert rows.where("split = 'test' and pred != y").count() <= 4
    assert folds.leakage(rows.select("fold", "participant", "split")).where("share > 0").count() == 0
    model = models.forest(df, ["x"], trees=5, depth=3)
    results.save_model(model, f"file://{tmp_path}/model")
    again = models.scored_by(results.load_model(f"file://{tmp_path}/model"), df)
    assert again.where("(score >= 0.5) != (y = 1)").count() <= 4
    results.write_config(spark, {"a": 1, "b": "x"}, f"file://{tmp_path}/config")
    assert results.read_config(spark, f"file://{tmp_path}/config").first()["config"] == {"a": "1", "b": "x"}


def test_summaries_on_disk(spark, tmp_path):
    run = tmp_path / "run_a"
    run.mkdir()
    metric = {"mean": 0.5, "std": 0.1, "min": 0.4, "max": 0.6, "values": [0.4, 0.6]}
    (run / "summary.json").write_text(json.dumps([{"dataset": "d", "model": "m", "window": {"size": 15, "stride": 5}, "n_folds": 2, "metrics": {"f1_writing": metric}}]))
    (tmp_path / "run_b").mkdir()
    rows = results.read_summaries(spark, f"file://{tmp_path}")
    wide = results.wide(rows).first()
    assert (wide["run"], wide["window"], wide["f1_writing_mean"], wide["accuracy_mean"]) == ("run_a", "w15/s5", 0.5, None)
    results.write_csv(results.wide(rows), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 1


def test_headers_in_any_order(spark, tmp_path):
    export(tmp_path, "P001", "S001", 20, 30)
    f = tmp_path / "P001/S001/landmarks.csv"
    cells = [line.split(",") for line in f.read_text().splitlines()]
    (tmp_path / "P002/S001").mkdir(parents=True)
    (tmp_path / "P002/S001/landmarks.csv").write_text("\r\n".join(",".join(c[::-1]) for c in cells))
    rows = sessions.read_landmarks(spark, f"file://{tmp_path}")
    a, b = ({r["frame_index"]: (r["timestamp_ms"], r["hand_detected"], r["l20_z"], r["handedness"]) for r in rows.where(f"participant = '{p}'").collect()} for p in ("P001", "P002"))
    assert a == b and len(a) == 20
    (tmp_path / "P003/S001").mkdir(parents=True)
    (tmp_path / "P003/S001/landmarks.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="P003"):
        sessions.read_landmarks(spark, f"file://{tmp_path}")


def test_world_pose_golden(spark):
    """By hand: the wrist at the origin, the furthest point at distance 1, left hands negated in x; pictures' points stay as they are."""
    point = lambda i: (100 + 3.0 * i, 50 + 4.0 * i, 0.0)
    row = {"session": "a", "frame_index": 0, "hand_detected": 1, "handedness": "Left", "dt": 0.04}
    row |= {f"{p}l{i}_{x}": v for p in ("", "w") for i in range(21) for x, v in zip("xyz", point(i), strict=True)}
    none = {**row, "frame_index": 1, "hand_detected": 0} | {c: None for c in sessions.WORLD}
    df = spark.createDataFrame([row, none], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in row.items()))
    out, names = features.prepare(df, pose="world", with_motion=False, with_velocity=True)
    a, b = out.orderBy("frame_index").collect()
    assert (a["wl0_x"], a["wl20_x"], a["wl20_y"]) == (0.0, pytest.approx(-0.6), pytest.approx(0.8)) and a["wl10_x"] == pytest.approx(-0.3)
    assert (a["l0_x"], a["l20_x"]) == (100.0, 160.0) and b["wl20_x"] == 0.0
    assert names[:4] == ["hand_detected", "wl0_x", "wl0_y", "wl0_z"] and names[-1] == "d_l20_z"
    with pytest.raises(ValueError, match="missing on rows with a hand"):
        features.prepare(df.withColumn("hand_detected", __import__("pyspark").sql.functions.lit(1)), pose="world")


def test_contract_and_importances(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 10), float(i % 3), int(i % 10 > 5)) for i in range(100)], "a double, b double, y int")
    model = models.forest(df, ["a", "b"], trees=5, depth=3)
    top = models.importances(model, ["a", "b"], df, 1).collect()
    assert [r["feature"] for r in top] == ["a"]
    points = spark.createDataFrame([("own", 0.4)], "dataset string, threshold double")
    results.write_contract(spark, ["a", "b"], points, {"band": 0.2}, {"writing": 1}, f"file://{tmp_path}/contract")
    r = spark.read.json(f"file://{tmp_path}/contract").first()
    assert (r["features"], r["threshold"], r["fps"], r["smoothing"]["band"], r["labels"]["writing"]) == (["a", "b"], 0.4, 30.0, 0.2, 1)


def test_breakdowns_and_folds_on_disk(spark, tmp_path):
    (tmp_path / "runs/a").mkdir(parents=True)
    (tmp_path / "runs/a/summary.json").write_text(json.dumps([{"dataset": "d", "model": "m", "n_folds": 1, "metrics": {}, "by_source": {"own": {"f1": 0.5, "n": 3}, "web": {"f1": 0.25, "n": 1}}}, {"dataset": "d", "model": "x", "n_folds": 1, "metrics": {}}]))
    rows = results.breakdown(results.read_summaries(spark, f"file://{tmp_path}/runs")).collect()
    assert {(r["model"], r["slice"], r["metric"], r["value"]) for r in rows} == {("m", "own", "f1", 0.5), ("m", "own", "n", 3.0), ("m", "web", "f1", 0.25), ("m", "web", "n", 1.0)}
    units = spark.createDataFrame([(u, 10, 5, "") for u in "abcd"], "unit string, n long, pos long, tie string")
    results.write_folds(folds.layout(folds.leave_one_out(units), 2), f"file://{tmp_path}/folds")
    lines = [json.loads(line) for f in sorted((tmp_path / "folds").glob("part-*")) for line in f.read_text().splitlines()]
    assert [(x["fold"], x["test"], x["train"], x["note"]) for x in lines] == [("fold01_a", ["a"], ["b", "c", "d"], "4 folds available, 2 run"), ("fold02_b", ["b"], ["a", "c", "d"], "4 folds available, 2 run")]
