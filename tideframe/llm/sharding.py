"""Shards of near equal size by a consistent-hash ring with virtual nodes and bounded loads.

1. Each shard has POINTS virtual nodes on a ring of 64-bit hashes. A text's key is a place on the ring; the shards whose virtual
   nodes follow clockwise are its choices, in that order. Equal texts have one key, so they stay together.
2. No shard holds more than 1 + SLACK times the mean of bytes: keys take their choices one after another, and where a shard is full,
   a key continues clockwise. The order of keys is fixed (below), so the outcome doesn't depend on how rows are dealt.
3. First come heavy keys, those of more than GRAIN of the mean, the largest first. There are at most shards / GRAIN of them, so
   they are placed one by one on the driver. A key of more than SPLIT of the mean with several rows is split: each of its rows is a
   key of its own, or a group of copies could fill a shard alone.
4. All other keys follow in LEVELS levels of a second hash. Shards fill up one after another, so what decides for a key is
   only which shards are full at its level: bytes by level and arc of the ring, a table of a fixed size, say at which
   level each shard fills up, and every row then finds its shard by itself. More rows make no larger table.
5. Slots are ranks within the shard, in two levels: buckets of a hash, and rows within a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import written

SHARDS, POINTS, LEVELS, BUCKETS = 8, 32, 2048, 4096
SLACK, GRAIN, SPLIT = 0.005, 0.001, 0.05


@dataclass
class Ring:
    """points: where arcs end (sorted). choices: for each arc all shards in their order clockwise."""

    points: np.ndarray
    choices: np.ndarray

    @classmethod
    def of(cls, shards: int, points: int = POINTS) -> Ring:
        nodes = sorted((xxhash.xxh3_64_intdigest(f"{s}:{i}"), s) for s in range(shards) for i in range(points))
        owners = [s for _, s in nodes]
        rows = [list(dict.fromkeys(owners[k:] + owners[:k])) for k in range(len(nodes))]
        return cls(np.array([h for h, _ in nodes], np.uint64), np.array(rows, np.int32))

    def arc(self, keys: np.ndarray) -> np.ndarray:
        """The arc of each key: that of the first virtual node at it or after it, clockwise."""
        return np.searchsorted(self.points, keys) % len(self.points)

    def first_open(self, is_open: np.ndarray) -> np.ndarray:
        """For each arc its first choice among the open shards."""
        return self.choices[np.arange(len(self.choices)), is_open[self.choices].argmax(1)]


def mixed(keys: np.ndarray) -> np.ndarray:
    """A second hash, which doesn't go by the place on the ring."""
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return keys ^ (keys >> np.uint64(28))


def level_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) >> np.uint64(40)).astype(np.int64) * LEVELS >> 24


def unsigned(keys: pd.Series) -> np.ndarray:
    return keys.to_numpy(np.int64).view(np.uint64)


def place_heavy(ring: Ring, keys: np.ndarray, sizes: np.ndarray, load: np.ndarray, capacity: float) -> np.ndarray:
    """Shards of the heavy keys, largest first; load grows by them. A key that fits nowhere goes to the least loaded shard."""
    out = np.empty(len(keys), np.int32)
    arcs = ring.arc(keys)
    for k in np.lexsort((keys, -sizes)).tolist():
        order = ring.choices[arcs[k]]
        fits = np.flatnonzero(load[order] + sizes[k] <= capacity)
        out[k] = order[fits[0]] if len(fits) else int(load.argmin())
        load[out[k]] += sizes[k]
    return out


def fill(ring: Ring, cells: np.ndarray, load: np.ndarray, capacity: float) -> tuple[np.ndarray, np.ndarray]:
    """closing, tables: the levels after which a shard is closed, and which shard each arc has before the first, after the first, ...

    cells: bytes by level and arc. load, of the heavy keys, grows to that of all.
    """
    is_open = load < capacity
    if not is_open.any():
        is_open[load.argmin()] = True
    closing, tables, level = [], [ring.first_open(is_open)], 0
    while level < len(cells):
        by_shard = np.zeros((len(cells) - level, len(load)))
        for s in range(len(load)):
            by_shard[:, s] = cells[level:, tables[-1] == s].sum(1)
        full = (load + by_shard.cumsum(0) >= capacity) & is_open
        at = int(full.any(1).argmax()) if full.any() and is_open.sum() > 1 else len(by_shard) - 1
        load += by_shard[: at + 1].sum(0)
        level += at + 1
        still = is_open & (load < capacity)
        if level < len(cells) and still.any() and (still != is_open).any():
            is_open = still
            closing.append(level)
            tables.append(ring.first_open(is_open))
    return np.array(closing, np.int64), np.array(tables)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, key (a hash of the text) and row (a number of its own) of every row, written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"),
    ), "shard-rows")


def _sums(rows: DataFrame, key: Column, more: float) -> pd.DataFrame:
    """key, size, n of the keys of more than `more` bytes: at most all bytes / more."""
    return rows.groupBy(key.alias("key")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).where(F.col("size") > more).toPandas()


def assign(rows: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """rows (of rows_of) with home_shard, where the key's ring place leads, and shard, where bounded loads lead it."""
    spark, ring = rows.sparkSession, Ring.of(shards)
    mean = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    capacity = mean * (1 + slack)
    heavy = _sums(rows, F.col("key"), GRAIN * mean)
    split = np.sort(heavy.loc[(heavy["size"] > SPLIT * mean) & (heavy["n"] > 1), "key"].to_numpy(np.int64))
    own = F.xxhash64("key", "row")
    key = F.when(F.col("key").isin(split.tolist()), own).otherwise(F.col("key")) if len(split) else F.col("key")
    if len(split):
        heavy = _sums(rows, key, GRAIN * mean)
    keys, load = unsigned(heavy["key"]), np.zeros(shards)
    places = place_heavy(ring, keys, heavy["size"].to_numpy(np.float64), load, capacity)
    order = np.argsort(keys)
    keys, places = keys[order], places[order]

    def is_heavy(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
        return (keys[at] == k if len(keys) else np.zeros(len(k), bool)), at

    @F.pandas_udf("int")
    def cell(k: pd.Series) -> pd.Series:
        """level * arcs + arc; null for heavy keys."""
        k = unsigned(k)
        return pd.Series(level_of(k) * len(ring.points) + ring.arc(k), dtype="Int32").mask(is_heavy(k)[0])

    light = rows.groupBy(cell(key).alias("cell")).agg(F.sum("size").alias("size")).where("cell is not null").toPandas()  # LEVELS * arcs rows at most
    cells = np.zeros(LEVELS * len(ring.points))
    cells[light["cell"].to_numpy(np.int64)] = light["size"].to_numpy(np.float64)
    closing, tables = fill(ring, cells.reshape(LEVELS, -1), load, capacity)
    table = spark.sparkContext.broadcast((keys, places, closing, tables))

    @F.pandas_udf("home_shard int, shard int")
    def shard_of(k: pd.Series) -> pd.DataFrame:
        keys, places, closing, tables = table.value
        k = unsigned(k)
        arc = ring.arc(k)
        shard = tables[np.searchsorted(closing, level_of(k), side="right"), arc]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            shard = np.where(keys[at] == k, places[at], shard)
        return pd.DataFrame({"home_shard": ring.choices[arc, 0], "shard": shard.astype(np.int32)})

    return rows.withColumn("at", shard_of(key)).select("*", "at.*").drop("at")


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard of every row; the law is `bytes`.

    Null and empty texts have size 1 and are equal texts. Repeated rows are rows of their own. A null doc_id is kept; ids play no part.
    A text larger than a shard's share has a shard of its own, which then holds more than the bound. An empty table gives no rows.
    """
    rows = assign(rows_of(docs), shards, slack).withColumn("bucket", F.pmod(F.xxhash64("key", "row"), F.lit(BUCKETS)))
    before = (
        rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    )
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "row")) - 1
    out = rows.withColumn("within", within).join(before, ["shard", "bucket"])
    slot = (F.col("before") + F.col("within")).alias("slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"), "home_shard")
