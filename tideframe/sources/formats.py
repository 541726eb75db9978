"""Session trees and published results as data sources: `spark.read.format("sessions")`, `spark.readStream.format("sessions")`, `df.write.format("published")`.

Files are reached through pyarrow.fs (local, S3, HDFS), by the tasks alone; the driver lists participants' folders and renames one folder.
"""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a batch that a reader yields.
ROWS = 10_000
POINTS = [f"{kind}{i}_{axis}" for kind in ("l", "wl") for i in range(21) for axis in "xyz"]
COLUMNS = ["participant", "session", "frame_index", "timestamp_ms", "hand_detected", "detection_confidence", "tracking_confidence", "handedness", *POINTS]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri}")
    return fs, path.rstrip("/")


def _listed(fs: pafs.FileSystem, path: str, kind: pafs.FileType) -> list[pafs.FileInfo]:
    return sorted((f for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == kind), key=lambda f: f.path)


def _modified(f: pafs.FileInfo) -> int:
    return f.mtime_ns or 0


def _session_files(fs: pafs.FileSystem, folder: str, name: str) -> list[pafs.FileInfo]:
    """The file of this name of each session `S*` of a participant."""
    sessions = [s.path for s in _listed(fs, folder, pafs.FileType.Directory) if s.base_name.startswith("S")]
    return [f for f in fs.get_file_info([f"{s}/{name}" for s in sessions]) if f.type == pafs.FileType.File]


@dataclass
class Participant(InputPartition):
    """A participant's folder, and the times of change between which its files are read."""

    folder: str
    after: int = -1
    until: int | None = None


class SessionReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.root, self.file, self.names = options["path"], options.get("file", "landmarks.csv"), schema.fieldNames()
        odd = [f.name for f in schema.fields if f.dataType != T.StringType()]
        if odd:
            raise ValueError(f"columns of sessions are text, cast them after reading: {odd}")

    def partitions(self) -> list[Participant]:
        fs, path = opened(self.root)
        return [Participant(p.path) for p in _listed(fs, path, pafs.FileType.Directory)]

    def read(self, partition: Participant | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no participants
            return
        fs, _ = opened(self.root)
        for f in _session_files(fs, partition.folder, self.file):
            if partition.after < _modified(f) and (partition.until is None or _modified(f) <= partition.until):
                yield from self._rows(fs, f.path)

    def _rows(self, fs: pafs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        *_, participant, session, _ = path.split("/")
        with fs.open_input_stream(path) as raw:
            lines = csv.reader(line.replace("\0", "") for line in _text_lines(raw))
            header = [c.strip() for c in next(lines, [])]
            if "frame_index" not in header:
                raise ValueError(f"no header with frame_index in {path}")
            at = [header.index(n) if n in header else None for n in self.names]
            known = {"participant": participant, "session": f"{participant}/{session}"}
            rows: list[list[str]] = []
            for row in lines:
                if row:
                    rows.append(row)
                if len(rows) == ROWS:
                    yield self._batch(rows, at, known)
                    rows = []
            if rows:
                yield self._batch(rows, at, known)

    def _batch(self, rows: list[list[str]], at: list[int | None], known: dict[str, str]) -> pa.RecordBatch:
        def column(name: str, k: int | None) -> pa.Array:
            if name in known:
                return pa.array([known[name]] * len(rows), pa.string())
            return pa.nulls(len(rows), pa.string()) if k is None else pa.array([(r[k] or None) if k < len(r) else None for r in rows], pa.string())

        return pa.RecordBatch.from_arrays([column(n, k) for n, k in zip(self.names, at, strict=True)], names=self.names)


def _text_lines(raw: pa.NativeFile) -> Iterator[str]:
    """Lines of UTF-8, a mark at the start left out, read in bounded blocks."""
    left, first = b"", True
    while block := raw.read(1 << 20):
        *lines, left = (left + block).split(b"\n")
        for line in lines:
            text = line.decode("utf-8", "replace").rstrip("\r")
            yield (text.removeprefix("\ufeff") if first else text) + "\n"
            first = False
    if left:
        text = left.decode("utf-8", "replace").rstrip("\r")
        yield text.removeprefix("\ufeff") if first else text


class SessionStream(SessionReader, DataSourceStreamReader):
    """Files that changed after the last batch. A file that appears later with an earlier time than one already read isn't seen."""

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        fs, path = opened(self.root)
        folders = [p.path for p in _listed(fs, path, pafs.FileType.Directory)]
        return {"until": max((_modified(f) for p in folders for f in _session_files(fs, p, self.file)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Participant]:
        return [Participant(p.folder, start["until"], end["until"]) for p in SessionReader.partitions(self)]


class Sessions(DataSource):
    """`<root>/P###/S###/landmarks.csv` (option file: another name) as text columns, a task for each participant; each file is read once.

    Columns are found by each file's own header, in any order; those that a file doesn't have are null. Other columns than the
    usual ones are asked for by `.schema(...)`. participant and session are those of the path. A file without a header with
    frame_index is an error, an empty tree gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sessions"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])

    def reader(self, schema: T.StructType) -> SessionReader:
        return SessionReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> SessionStream:
        return SessionStream(schema, self.options)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class PublishedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.extras = {k.removeprefix("json."): json.loads(v) for k, v in options.items() if k.startswith("json.")}
        fs, path = opened(self.root)
        self.attempt = f"{path}.attempt-{uuid.uuid4().hex}"
        if not overwrite and fs.get_file_info(path).type != pafs.FileType.NotFound:
            raise ValueError(f"there is a published run at {self.root}")

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        fs, _ = opened(self.root)
        fs.create_dir(self.attempt, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.json"
        with fs.open_output_stream(f"{self.attempt}/{name}") as out:
            for row in rows:
                out.write((json.dumps(row.asDict(recursive=True), default=str) + "\n").encode())
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = opened(self.root)
        fs.create_dir(self.attempt, recursive=True)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        wanted = {p.name for p in parts if p.rows}
        for f in _listed(fs, self.attempt, pafs.FileType.File):  # of tasks that were lost or ran twice, and empty ones
            if f.base_name not in wanted:
                fs.delete_file(f.path)
        extras = self.extras | {"_manifest": {"rows": sum(p.rows for p in parts), "parts": [{"name": p.name, "rows": p.rows} for p in parts if p.rows]}}
        for name, value in extras.items():
            with fs.open_output_stream(f"{self.attempt}/{name}.json") as out:
                out.write(json.dumps(value, indent=1).encode())
        old = f"{path}.old-{uuid.uuid4().hex}"
        if there := fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.move(path, old)
        fs.move(self.attempt, path)
        if there:
            fs.delete_dir(old)

    def abort(self, messages: list[Part | None]) -> None:
        fs, _ = opened(self.root)
        if fs.get_file_info(self.attempt).type != pafs.FileType.NotFound:
            fs.delete_dir(self.attempt)


class Published(DataSource):
    """A run's results as JSON lines, with folds, configuration and contract (options `json.<name>`: JSON text), visible all at once by one rename.

    Parts keep the order of the rows' partitions; `_manifest.json` lists them with their rows. A write that fails leaves nothing,
    and an overwritten run stays until the new one is whole. Stores without a rename of folders (S3) aren't for this.
    """

    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema: T.StructType, overwrite: bool) -> PublishedWriter:
        return PublishedWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (Sessions, Published):
        spark.dataSource.register(source)
