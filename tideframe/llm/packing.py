"""Packing documents into sequences of a fixed token length: shortest-pack-first over the length histogram.

1. Each document is tokenized once and cut into whole sequences of `size` tokens and a rest. A row is
   kept for each piece, without its ids; and a second set of rows in which the rest is cut
   further, at `size` / 4, for inputs whose lengths would not fit together uncut.
2. Only the histogram of piece lengths (at most `size` rows, whatever the input) reaches the driver.
   Lengths are placed longest first; each goes to the shortest open pack that it fits, and packs
   of the same content are one pattern with a count, so the work depends on `size`, not on documents.
3. Patterns go back to pieces by rank: within a length, pieces are ranked by (doc_id, start) in
   hashed buckets (no length, however frequent, meets in one task). A pattern's place for a length takes as many
   ranks as the pattern has packs, so the places are a table of some thousand rows, whatever the
   input; it is sent to tasks, and a piece finds its place by binary search for its rank.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.llm import tokens
from tideframe.llm.common import keyed_text, written

NAMES = ["cut", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
SIZE, END_ID, TOKENIZER = 4096, 2, "word_bpe_49k.json"
PIECES = ", ".join(f"{n} {'int' if n == 'cut' else 'long'}" for n in NAMES)
#: Share of padding above which the further cut pieces are taken, if they leave less.
PADDING = 0.005
#: Buckets in which the pieces of one length are ranked, a table of at most size * BUCKETS rows.
BUCKETS = 1024
#: Most places in all patterns (some 20,000 at 4096, whatever the input); bits of a rank.
SLOTS, RANKS = 4_000_000, 48


def cuts(n: int, cut: int, size: int = SIZE) -> list[int]:
    """Piece lengths of a document of n tokens: whole sequences, then the rest in pieces of at most `cut`."""
    rest = n % size
    return [size] * (n // size) + [cut] * (rest // cut) + [rest % cut] * bool(rest % cut)


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.tokenizer(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                rows: list[tuple] = []
                for key, got in zip(part.column(0).to_pylist(), t.encode(part.column(1).to_pylist()), strict=True):
                    ids = np.concatenate([np.frombuffer(got, t.dtype).astype("<u4"), end])
                    for cut in (size, size // 4):
                        at = 0
                        for n in cuts(len(ids), cut, size):
                            rows.append((cut, key, at, n, tokens.crc32(ids[at : at + n]), len(ids)))
                            at += n
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int32()), *columns[1:]], names=NAMES)

    return keyed_text(docs).mapInArrow(of, PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs: every length of the histogram placed, longest first, in the shortest pack that has room."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # room -> patterns
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = max((r for r, p in open_.items() if p and r >= length), default=None)
            if room is None:
                open_[size - length].append((n, (length,)))
                break
            count, pack = open_[room].pop()
            placed = min(n, count)
            if count > placed:
                open_[room].append((count - placed, pack))
            open_[room - length].append((placed, (*pack, length)))
            n -= placed
    return [x for r in sorted(open_) for x in open_[r]]


def padding(packs: list[tuple[int, tuple[int, ...]]], size: int = SIZE) -> int:
    """Padded tokens: up to `size`, none where the pack's own length is a power of two."""
    return sum(c * (size - n) for c, p in packs if (n := sum(p)) & (n - 1))


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Null or empty text: the end id alone. Repeated rows are packed each on its own. A null doc_id is
    kept. A text of any length is cut, never shortened. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    rows = written(pieces(docs, path or tokens.path_of(TOKENIZER), end_id, size), "pieces")
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for r in rows.groupBy("cut", "length").count().collect():  # 2 * size rows at most
        counts[r["cut"]][r["length"]] = r["count"]
    best, packs = size, shortest_pack_first(counts[size], size)
    total = sum(n * c for n, c in counts[size].items())
    if padding(packs, size) > PADDING * total:
        finer = shortest_pack_first(counts[size // 4], size)
        if padding(finer, size) < padding(packs, size):
            best, packs = size // 4, finer
    rows = rows.where(F.col("cut") == best).drop("cut")

    slots, taken, sequence = [], defaultdict(int), 0  # length, first rank, first sequence, offset of a pattern's place
    for count, lengths in packs:
        offset = 0
        for n in lengths:
            slots.append((n, taken[n], sequence, offset))
            taken[n] += count
            offset += n
        sequence += count
    if len(slots) > SLOTS:
        raise ValueError(f"{len(slots)} slots in {len(packs)} patterns; at most {SLOTS} are sent to tasks")
    table = spark.sparkContext.broadcast(np.array(sorted(slots), np.int64).reshape(-1, 4))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        """By binary search for the last slot of this length that begins at this rank or before it."""
        t = table.value
        at = np.searchsorted((t[:, 0] << RANKS) + t[:, 1], (length.to_numpy(np.int64) << RANKS) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 2] + rank.to_numpy(np.int64) - t[at, 1], "offset": t[at, 3]})

    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)))
    before = (
        rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    )
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = rows.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    return ranked.withColumn("slot", place("length", "rank")).select(*NAMES[1:], "slot.sequence_id", "slot.offset")
