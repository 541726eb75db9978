"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's bytes (each step doubles it and adds the byte's number from a fixed table, so it
depends on the last 32 bytes alone); a chunk ends where its top bits are zero. The mask is normalised: more bits
must be zero before a chunk has NORMAL bytes, fewer after, which keeps lengths near NORMAL; no chunk is
shorter than LEAST (but the last) or longer than MOST. Boundaries depend on content, so an edit changes
the chunks around it and leaves the rest. The fingerprint is the set of chunk digests with their
lengths; likeness is containment: the share of a document's distinct chunk length found in the other.

The hash of all positions of a batch is taken at once in numpy, in five doublings.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm.common import keyed_text, partitions

LEAST, NORMAL, MOST = 16, 48, 160
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xE0000000)
_REACH = 32
#: Ranges of doc_id for each shuffle partition (several, so that hashing them evens out); sampled ids for each range's bounds.
RANGES, BOUNDS = 4, 32


def _gear_table() -> np.ndarray:
    """256 numbers from a fixed generator."""
    x, out = 0x9E3779B97F4A7C15, []
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) & (1 << 64) - 1
        out.append(x >> 32)
    return np.array(out, np.uint32)


GEAR = _gear_table()


def _chunk_ends(strict: list[int], loose: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end]; strict and loose hold the places after which the masks allow an end."""
    ends, n_strict, n_loose = [], len(strict), len(loose)
    i, j = bisect_left(strict, start), bisect_left(loose, start)
    while end - start > LEAST:
        first, mid, last = start + LEAST, start + NORMAL, min(start + MOST, end)
        while i < n_strict and strict[i] < first:
            i += 1
        if i < n_strict and strict[i] < mid:
            cut = strict[i]
        else:
            while j < n_loose and loose[j] < mid:
                j += 1
            cut = loose[j] if j < n_loose and loose[j] < last else last
        ends.append(cut)
        start = cut
    if start < end:
        ends.append(end)
    return ends


def fingerprints(texts: list[bytes]) -> list[dict[str, int]]:
    """digest -> chunk length, of each text."""
    # _REACH zero bytes between texts, whose table entry is taken as 0, keep one text's hash from the next
    sizes = [len(t) for t in texts]
    data = np.frombuffer((b"\0" * _REACH).join(texts), np.uint8)
    if not len(data):
        return [{} for _ in texts]
    starts = np.concatenate([[0], np.cumsum(np.array(sizes[:-1], np.int64) + _REACH)]).astype(np.int64)
    h = GEAR[data]
    for a, n in zip(starts[:-1].tolist(), sizes[:-1], strict=True):
        h[a + n : a + n + _REACH] = 0
    # after k doublings h is the sum of GEAR[byte] << distance over the last 2^k bytes
    step = 1
    while step < _REACH:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    loose = np.flatnonzero((h & LOOSE) == 0) + 1
    strict = loose[(h[loose - 1] & STRICT) == 0]
    out = []
    digest = xxhash.xxh3_64_intdigest
    for text, a, n in zip(texts, starts.tolist(), sizes, strict=True):
        s = strict[np.searchsorted(strict, a) : np.searchsorted(strict, a + n)] - a
        l = loose[np.searchsorted(loose, a) : np.searchsorted(loose, a + n)] - a
        found, at = {}, 0
        for e in _chunk_ends(s.tolist(), l.tolist(), 0, n):
            found[digest(text[at:e])] = e - at
            at = e
        out.append(found)
    return out


def as_text(fingerprint: dict[int, int]) -> str:
    """digest:length of each chunk by digest, in hexadecimal; equal texts give equal strings."""
    return ",".join(f"{d:016x}:{n:x}" for d, n in sorted(fingerprint.items()))


def from_text(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in fingerprint.split(",") if x)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's chunk length that b has too; two empty texts are alike (1), an empty and another not (0)."""
    whole = sum(a.values())
    if not whole:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / whole


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of `following` (or all it has)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


_KEY = np.dtype([("none", "i1"), ("order", "<i8"), ("hash", "<i8")])


def _keys(none, order, hashes) -> np.ndarray:
    out = np.empty(len(none), _KEY)
    out["none"], out["order"], out["hash"] = none, order, hashes
    return out


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """part, guest, doc_id, text: rows dealt by ranges of descending doc_id (rows of one doc_id, or without any, by a hash of their
    text) and sorted within them, each range followed by the first row of the next (guest); after the last range comes the first row of all.

    The ranges' bounds are taken from a sample of BOUNDS ids a range, which deals rows out and nothing else; a row finds its range by
    binary search. The first row of each range is found by an aggregate, a row a range, so texts move once.
    """
    spark: SparkSession = docs.sparkSession
    parts = parts or RANGES * partitions(spark)
    rows = keyed_text(docs).withColumns({"hash": F.xxhash64("text"), "none": F.col("doc_id").isNull().cast("int"), "order": F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long")))})
    ids = rows.select("none", "order", "hash")
    n = ids.count()
    some = ids.where(F.pmod(F.xxhash64(F.lit(41), "order", "hash"), F.lit(1 << 40)) <= min(1 << 40, (BOUNDS * parts << 40) // max(n, 1))).collect()
    keys = np.sort(_keys(*zip(*some, strict=True))) if some else np.zeros(0, _KEY)
    bounds = spark.sparkContext.broadcast(np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if len(keys) else keys)

    @F.pandas_udf("int")
    def range_of(none: pd.Series, order: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, _keys(none, order, hashes), side="right").astype(np.int32))

    first = ids.groupBy(range_of("none", "order", "hash").alias("part")).agg(F.min(F.struct("none", "order", "hash")).alias("x")).collect()
    heads = {r["part"]: tuple(r["x"]) for r in first}
    order = sorted(heads)
    # the first row of a range also goes to the range before it, the first of all to the last
    table = spark.sparkContext.broadcast({heads[p]: order[k - 1] for k, p in enumerate(order)})

    @F.pandas_udf("part int, host int")
    def placed(none: pd.Series, order: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        keys = _keys(none, order, hashes)
        hosts = [table.value.get(k) for k in keys.tolist()]
        return pd.DataFrame({"part": np.searchsorted(bounds.value, keys, side="right").astype(np.int32), "host": pd.array(hosts, "Int32")})

    copies = F.filter(F.array(F.struct(F.col("at.part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("at.host").alias("part"), F.lit(True).alias("guest"))), lambda x: x["part"].isNotNull())
    dealt = rows.withColumn("at", placed("none", "order", "hash")).withColumn("copy", F.explode(copies)).select("copy.part", "copy.guest", "doc_id", "text", "none", "order", "hash")
    return dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "guest", "none", "order", "hash", "text").select("part", "guest", "doc_id", "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Null text counts as empty. Rows of one doc_id follow one another in the order of a hash of their text. A single row is
    its own next. An empty table gives no rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the range in work, up to a batch; the last waits for its next
        part, done = None, False

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            """All but the last of rows, each with the one after it."""
            texts = [r[1] for r in rows]
            changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
            prints = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
            edits = fingerprints([t.encode("utf-8", "surrogatepass") for t in changed])
            own = prints[:-1]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(changed, pa.string()),
                pa.array(list(map(as_text, own)), pa.string()), pa.array(list(map(as_text, edits)), pa.string()),
                pa.array([containment(a, b) for a, b in zip(own, edits, strict=True)], pa.float64()),
                pa.array([containment(a, b) for a, b in zip(own, prints[1:], strict=True)], pa.float64()),
            ], names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for p, guest, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    part, held, done = p, [], False
                if done:  # a further guest: rows that share the head's doc_id
                    continue
                held.append((key, text))
                done = guest
                if done or len(held) > 200:
                    yield emit(held)
                    held = held[-1:]

    rows = with_next(docs).mapInArrow(of, RESULT)
    return rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row, by its whole text (null: empty); no shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                found = fingerprints([t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(as_text, found)), pa.string())], names=["doc_id", "fingerprint"])

    return keyed_text(docs).mapInArrow(of, "doc_id long, fingerprint string")
