"""Token ids of a corpus in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents in ascending doc_id, one array, and says where each
document begins by an Elias-Fano sequence: of the n + 1 boundaries, `low` bits each are stored as they
are and the rest as a bit vector in unary, about 2 + log2(ids / documents) bits a document instead of
64. Every STEP-th one of that vector has its position noted, so select reads the notes around the wanted
values and the bytes between them; reading a file goes by it too, some thousand documents at a time. The doc_ids, ascending too, are stored the same way.

Layout, little endian: MAGIC, 8 longs (id width, documents, ids, least doc_id, documents without doc_id,
and the lengths in bytes of the two sequences, 0), the doc_id sequence, the boundary sequence, the ids.
A sequence: 4 longs (n, low, bytes of low bits, bytes of the vector), low bits, vector, notes (4 bytes each).

Writing: Spark deals the texts by ranges of doc_id (rows of one doc_id by a hash of their text), each task sorts its range
and writes files of at most FILE_IDS ids and FILE_DOCS documents, first under a name of its own attempt and then renamed, so that a task run again, or
twice, leaves the same files. Readers get the files by Spark's binaryFile source.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm import tokens
from tideframe.llm.common import keyed_text, new_path, partitions, written

TOKENIZER, END_ID, FILE_IDS, FILE_DOCS, STEP, BLOCK = "byte_bpe_50k.json", 0, 4_000_000, 250_000, 256, 1 << 16
MAGIC = b"EFTOKEN1"
HEAD, PART = struct.Struct("<8q"), struct.Struct("<4q")


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 to 2^64 - 1, in near-minimal space."""

    def __init__(self, n: int, low: int, lows: np.ndarray, vector: np.ndarray, notes: np.ndarray):
        self.n, self.low, self.lows, self.vector, self.notes = n, low, lows, vector, notes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """BLOCK values at a time are spread out to bits."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        lows = []
        for k in range(0, n if low else 0, BLOCK):
            part = values[k : k + BLOCK]
            bits = np.empty((len(part), low), np.uint8)
            for i in range(low):
                bits[:, i] = (part >> np.uint64(i)) & np.uint64(1)
            lows.append(np.packbits(bits.ravel(), bitorder="little"))
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        vector[ones] = 1
        return cls(n, low, np.concatenate(lows) if lows else np.zeros(0, np.uint8), np.packbits(vector, bitorder="little"), ones[::STEP].astype("<u4"))

    def _lows(self, first: int, count: int) -> np.ndarray:
        out = np.zeros(count, np.uint64)
        if self.low:
            at = first * self.low
            bits = np.unpackbits(self.lows[at // 8 : (at + count * self.low + 7) // 8], bitorder="little")[at % 8 :]
            bits = bits[: count * self.low].reshape(count, self.low)
            for i in range(self.low):
                out |= bits[:, i].astype(np.uint64) << np.uint64(i)
        return out

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """Values first, first + 1, ...: the vector is read from the note before the first to the note after the last, no further."""
        if not count:
            return np.zeros(0, np.uint64)
        note, after = first // STEP, -(-(first + count) // STEP)
        start = int(self.notes[note]) // 8
        end = int(self.notes[after]) // 8 + 1 if after < len(self.notes) else len(self.vector)
        ones = np.flatnonzero(np.unpackbits(self.vector[start:end], bitorder="little")) + start * 8
        ones = ones[np.searchsorted(ones, int(self.notes[note])) + first - note * STEP :][:count]
        return ((ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.low)) | self._lows(first, count)

    def to_bytes(self) -> bytes:
        return PART.pack(self.n, self.low, len(self.lows), len(self.vector)) + self.lows.tobytes() + self.vector.tobytes() + self.notes.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, low, a, b = PART.unpack_from(data)
        raw = np.frombuffer(data, np.uint8, offset=PART.size)
        return cls(n, low, raw[:a], raw[a : a + b], raw[a + b : a + b + 4 * -(-n // STEP)].view("<u4"))


class TokenFile:
    """What a file holds: doc_ids, boundaries and ids."""

    @staticmethod
    def to_bytes(doc_ids: list[int | None], sizes: list[int], ids: bytes, width: int) -> bytes:
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        keys = EliasFano.of(known.view(np.uint64) - np.uint64(least % (1 << 64))).to_bytes()  # differences wrap to what they are
        bounds = EliasFano.of(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])).to_bytes()
        head = HEAD.pack(width, len(doc_ids), len(ids) // width, least, len(doc_ids) - len(known), len(keys), len(bounds), 0)
        return MAGIC + head + keys + bounds + ids

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        view = memoryview(data)
        width, self.n_docs, self.n_ids, self.least, self.unkeyed, keys, bounds, _ = HEAD.unpack_from(view, len(MAGIC))
        at = len(MAGIC) + HEAD.size
        self.keys = EliasFano.from_bytes(view[at : at + keys])
        self.bounds = EliasFano.from_bytes(view[at + keys : at + keys + bounds])
        self.ids = np.frombuffer(view, np.dtype(f"<u{width}"), offset=at + keys + bounds)

    def doc_ids(self, first: int, count: int) -> list[int | None]:
        """Documents without a doc_id come first, as in Spark's ascending order."""
        none = max(0, min(count, self.unkeyed - first))
        keys = self.keys.select(first + none - self.unkeyed, count - none)
        return [None] * none + (keys + np.uint64(self.least % (1 << 64))).view(np.int64).tolist()

    def starts(self, first: int, count: int) -> np.ndarray:
        """Where documents begin, by select structures; the place after the last one's end is the next start."""
        return self.bounds.select(first, count + 1).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        a, b = self.starts(i, 1).tolist()
        return self.ids[a:b]


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files into `folder` and returns file, n_docs, n_ids of each, in the order of `file`.

    Null text: the end id alone. A null doc_id sorts first; equal doc_ids stand in the order of a hash of their text.
    """
    path = path or tokens.path_of(TOKENIZER)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        task = TaskContext.get().partitionId()
        t = tokens.tokenizer(path)
        end = np.array([end_id], t.dtype).tobytes()
        keys, sizes, parts, held, seq = [], [], [], 0, 0

        def flush():
            nonlocal held, seq
            name = f"part-{task:08d}-{seq:06d}.tokens"
            own = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(TokenFile.to_bytes(keys, sizes, b"".join(parts), t.dtype.itemsize))
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(keys)], "n_ids": [held]})
            seq, held = seq + 1, 0
            for x in (keys, sizes, parts):
                x.clear()
            return row

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                for key, got in zip(part.column(0).to_pylist(), t.encode(part.column(1).to_pylist()), strict=True):
                    n = len(got) // t.dtype.itemsize + 1
                    if held and (held + n > file_ids or len(keys) >= FILE_DOCS):
                        yield flush()
                    keys.append(key)
                    sizes.append(n)
                    parts.append(got + end)
                    held += n
        if keys:
            yield flush()

    order = ["doc_id", F.xxhash64("text")]  # so that the rows of one doc_id, or without any, need not be one task's
    dealt = keyed_text(docs).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    return written(dealt.mapInArrow(of, "file string, n_docs long, n_ids long"), "token-files")


def starts(files: DataFrame) -> DataFrame:
    """file, first: ids in all files before it. Two levels: within a task's files, then over tasks (a row for each)."""
    task = files.withColumn("task", F.substring("file", 6, 8))
    sums = task.groupBy("task").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("task")) - F.col("n"))
    within = F.sum("n_ids").over(Window.partitionBy("task").orderBy("file")) - F.col("n_ids")
    return task.withColumn("within", within).join(sums.drop("n"), "task").select("file", (F.col("before") + F.col("within")).alias("first"))


def read(docs_folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    spark = files.sparkSession

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"], strict=True):
                f = TokenFile(content)
                for k in range(0, f.n_docs, STEP * 16):
                    n = min(STEP * 16, f.n_docs - k)
                    starts = f.starts(k, n)
                    crcs = [tokens.crc32(f.ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                    yield pd.DataFrame({"file": name, "doc_id": pd.array(f.doc_ids(k, n), "Int64"), "start": starts[:-1], "n_tokens": np.diff(starts), "ids_crc32": crcs})

    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tokens").load(docs_folder)
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = content.mapInPandas(of, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    # the documents' few numbers meet the files' first places, not the files' content
    return rows.join(starts(files), "file").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write into a new folder of the shared one, read back; no row for an empty table."""
    folder = new_path(docs.sparkSession, "token-arrays")
    files = write(docs, folder, path)
    if files.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(folder, files)
