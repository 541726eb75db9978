"""Session trees and published runs as data sources: read in batch and as a stream, written whole or not at all."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tests.test_sources import export
from tideframe.sources import formats, sessions


@pytest.fixture(scope="module")
def sources(spark):
    formats.register(spark)
    return spark


def test_tree_equals_plain_reader(sources, tmp_path):
    export(tmp_path, "P001", "S001", 40, 30)
    export(tmp_path, "P002", "S001", 25, 30, hand=None)
    f = tmp_path / "P001/S001/landmarks.csv"
    cells = [line.split(",") for line in f.read_text().splitlines()]
    (tmp_path / "P003/S002").mkdir(parents=True)
    (tmp_path / "P003/S002/landmarks.csv").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(",".join(c[::-1]) for c in cells).encode())
    (tmp_path / "P004/notes").mkdir(parents=True)
    names = ["participant", "session", "frame_index", "timestamp_ms", "hand_detected", "handedness", "l0_x", "l20_z"]
    plain, tree = (sorted(map(tuple, read(sources, f"file://{tmp_path}").select(names).collect()), key=str) for read in (sessions.read_landmarks, sessions.read_tree))
    assert plain == tree and len(tree) == 105
    rows, bad = sessions.load(sources, f"file://{tmp_path}", "own", fps=30.0, reader=sessions.read_tree)
    assert {r["session"] for r in rows.select("session").distinct().collect()} == {"P001/S001", "P002/S001"}
    assert [r["session"] for r in bad.collect()] == ["P003/S002"]  # no labels


def test_tree_of_odd_files(sources, tmp_path):
    assert sources.read.format("sessions").load(f"file://{tmp_path}").count() == 0
    d = tmp_path / "P1/S1"
    d.mkdir(parents=True)
    (d / "landmarks.csv").write_text('note,frame_index\n"a, ""b""",0\n\nshort\n,2\n')
    got = sources.read.format("sessions").schema("frame_index string, note string, session string, l0_x string").load(f"file://{tmp_path}").collect()
    assert [tuple(r) for r in got] == [("0", 'a, "b"', "P1/S1", None), (None, "short", "P1/S1", None), ("2", None, "P1/S1", None)]
    (d / "landmarks.csv").write_text("")
    with pytest.raises(Exception, match="no header with frame_index in .*P1/S1"):
        sources.read.format("sessions").load(f"file://{tmp_path}").count()
    with pytest.raises(Exception, match="columns of sessions are text"):
        sources.read.format("sessions").schema("frame_index long").load(f"file://{tmp_path}").count()


def test_a_task_for_each_participant(sources, tmp_path):
    for p in range(5):
        for s in range(3):
            export(tmp_path, f"P{p}", f"S{s}", 4, 30)
    df = sources.read.format("sessions").load(f"file://{tmp_path}")
    by_task = df.select("participant", F.spark_partition_id().alias("task")).distinct().collect()
    assert df.rdd.getNumPartitions() == 5 and len(by_task) == 5


def test_stream_reads_new_sessions_once(sources, tmp_path):
    tree, out = tmp_path / "tree", tmp_path / "out"
    export(tree, "P1", "S1", 10, 30)

    def run():
        rows = sources.readStream.format("sessions").load(f"file://{tree}").select("session", "frame_index")
        rows.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start(f"file://{out}").awaitTermination(120)
        return {r["session"]: r["count"] for r in sources.read.parquet(f"file://{out}").groupBy("session").count().collect()}

    assert run() == {"P1/S1": 10}
    time.sleep(0.02)
    export(tree, "P1", "S2", 7, 30)
    export(tree, "P2", "S1", 5, 30)
    assert run() == {"P1/S1": 10, "P1/S2": 7, "P2/S1": 5}
    assert run() == {"P1/S1": 10, "P1/S2": 7, "P2/S1": 5}


def lines(path):
    return [json.loads(x) for name in sorted(os.listdir(path)) if name.startswith("part-") for x in open(f"{path}/{name}")]


def test_run_is_published_whole(sources, tmp_path):
    path = f"{tmp_path}/runs/a"
    rows = sources.range(100).select("id", (F.col("id") * 0.5).alias("f1"), F.struct(F.lit(1).alias("x")).alias("s")).repartitionByRange(4, "id").sortWithinPartitions("id")

    def write(df, mode, folds):
        df.write.format("published").mode(mode).option("json.folds", json.dumps(folds)).option("json.config", '{"fps": 30}').save(f"file://{path}")

    write(rows, "append", [["a"], ["b"]])
    assert lines(path) == [{"id": i, "f1": i * 0.5, "s": {"x": 1}} for i in range(100)]
    assert json.load(open(f"{path}/folds.json")) == [["a"], ["b"]] and json.load(open(f"{path}/config.json")) == {"fps": 30}
    manifest = json.load(open(f"{path}/_manifest.json"))
    assert manifest["rows"] == 100 and sum(p["rows"] for p in manifest["parts"]) == 100
    with pytest.raises(Exception, match="there is a published run"):
        write(rows, "append", [])
    # a task that dies after its first rows leaves the run before as it was, and nothing of its own
    broken = rows.where("id < 60").withColumn("f1", F.when(F.col("id") == 55, F.raise_error(F.lit("lost"))).otherwise(F.col("f1")))
    with pytest.raises(Exception, match="lost"):
        write(broken, "overwrite", [["c"]])
    assert os.listdir(tmp_path / "runs") == ["a"] and len(lines(path)) == 100 and json.load(open(f"{path}/folds.json")) == [["a"], ["b"]]
    write(rows.where("id < 3"), "overwrite", [["c"]])
    assert os.listdir(tmp_path / "runs") == ["a"] and len(lines(path)) == 3 and json.load(open(f"{path}/folds.json")) == [["c"]]
    write(rows.where("id < 0"), "overwrite", [])
    assert lines(path) == [] and json.load(open(f"{path}/_manifest.json"))["rows"] == 0
