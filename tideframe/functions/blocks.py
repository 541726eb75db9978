"""Ordered groups that are longer than one task: rows dealt by ranges of (keys, order), so that a group is cut into blocks.

What a block needs to know of the blocks before it is one of two things. A running state (a count, a sum, the last mark) is carried: each
block is summed up in a row, and the rows of a group's blocks are ordered and run over, not its rows. Neighbours are copied:
a block gets the last rows of the block before it and the first of the next as guests (a halo), whose own results are dropped.
Blocks are consecutive ranges, so only the group at a block's end can go on in the next: what is carried or said about
ends is at most a row for each block, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions import ranks
from tideframe.functions.expr import Key, names, over
from tideframe.functions.staging import staged


def dealt(df: DataFrame, keys: Key, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """df, written, in blocks: _block grows with (keys, order), _id with the rows' order within a block and over blocks.

    Rows that are equal in keys and order are one block's. Nulls come first.
    """
    spark = df.sparkSession
    by = [*(F.col(k).asc_nulls_first() for k in names(keys)), *(o if isinstance(o, Column) else F.col(o).asc_nulls_first() for o in order)]
    rows = df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    return staged(rows.withColumns({"_block": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "blocks")


def starts(blocks: DataFrame, keys: Key) -> DataFrame:
    """keys, _block, _first (least _id), _n (rows), _before (rows of the group in earlier blocks)."""
    k = names(keys)
    per = blocks.groupBy(*k, "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return per.withColumn("_before", F.sum("_n").over(Window.partitionBy(*k).orderBy("_block")) - F.col("_n"))


def _hosts(spans: list[tuple[int, int, int]], before: int, after: int) -> list[tuple[int, int, int, int]]:
    """(block, host, least, most): rows of `block` with these _ids are among the `before` rows before `host`, or the `after` rows after it."""
    out = []
    for i, (host, _, _) in enumerate(spans):
        for want, step in ((before, -1), (after, 1)):
            j = i + step
            while want > 0 and 0 <= j < len(spans):
                block, low, high = spans[j]
                n = min(want, high - low + 1)
                out.append((block, host, *((high - n + 1, high) if step < 0 else (low, low + n - 1))))
                want, j = want - n, j + step
    return out


def with_halo(rows: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """rows (of dealt) and their copies as guests (_guest) of the blocks whose rows they are near to; _block is the host's."""
    spans = sorted(tuple(r) for r in rows.groupBy("_block").agg(F.min("_id"), F.max("_id")).collect())  # a row for each block
    hosts = rows.sparkSession.createDataFrame(_hosts(spans, before, after), "_block int, _host int, _least long, _most long")
    guests = rows.join(F.broadcast(hosts), "_block").where(F.col("_id").between(F.col("_least"), F.col("_most")))
    guests = guests.withColumn("_block", F.col("_host")).select(*rows.columns, F.lit(True).alias("_guest"))
    return rows.withColumn("_guest", F.lit(False)).unionByName(guests)


def local(rows: DataFrame, keys: Key, before: int, after: int, work: Callable[[DataFrame, list[str], str], DataFrame]) -> DataFrame:
    """work(rows, keys, order) of an operator that looks at most so many rows back and ahead, block by block: its keys are the group's and the
    block, its order _id. It must keep _guest."""
    return work(with_halo(rows, before, after), [*names(keys), "_block"], "_id").where(~F.col("_guest")).drop("_guest")


def carried(rows: DataFrame, keys: Key, states: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """rows with, for each state (name -> an aggregate of a block's rows, and how blocks' states are joined), what the group's earlier
    blocks give; null where there are none. Only groups of several blocks have any: at most a row for each block is broadcast."""
    k = names(keys)
    per = rows.groupBy(*k, "_block").agg(*(a.alias(f"_{n}") for n, (a, _) in states.items()))
    earlier = Window.partitionBy(*k).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*k).orderBy("_block"))
    per = per.select(*k, "_block", first.alias("_nth"), *(join(F.col(f"_{n}")).over(earlier).alias(n) for n, (_, join) in states.items()))
    return ranks.same_keys(rows, F.broadcast(per.where("_nth > 1").drop("_nth")), [*k, "_block"], "left")


def with_group(rows: DataFrame, table: DataFrame, keys: Key) -> DataFrame:
    """rows with the columns of table (a row for each group), joined by group and block, so that no group is one key."""
    k = names(keys)
    groups = rows.select(*k, "_block").distinct()
    return ranks.same_keys(rows, ranks.same_keys(groups, table, k), [*k, "_block"])


def positions(rows: DataFrame, keys: Key, name: str = "pos") -> DataFrame:
    """rows with their place in the group, from 0."""
    k = names(keys)
    rows = carried(rows, k, {"_earlier": (F.count(F.lit(1)), F.sum)})
    within = F.row_number().over(over([*k, "_block"], "_id")) - 1
    return rows.withColumn(name, (F.coalesce("_earlier", F.lit(0)) + within).cast("long")).drop("_earlier")


def running(df: DataFrame, keys: Key, order: str, width: int, sums: dict[str, tuple], least: dict[str, str] | None = None) -> DataFrame:
    """df with running aggregates up to and with each row, where `order` counts a group's rows closely enough to cut it into
    blocks of `width`.

    sums: new column -> (aggregate function, column, function of two results), as ("bit_xor", "h", lambda a, b: a.bitwiseXOR(b)); the
    second function joins what the blocks before give with what the block gives, where there are blocks before. least: new column -> column,
    its least value in the whole group.
    """
    k, least = names(keys), least or {}
    rows = df.withColumn("_part", F.floor(F.col(order) / width))
    per = rows.groupBy(*k, "_part").agg(*(getattr(F, f)(c).alias(f"_of_{n}") for n, (f, c, _) in sums.items()), *(F.min(c).alias(f"_least_{n}") for n, c in least.items()))
    earlier = Window.partitionBy(*k).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*k, "_part", *(getattr(F, f)(f"_of_{n}").over(earlier).alias(f"_before_{n}") for n, (f, _, _) in sums.items()), *(F.min(f"_least_{n}").over(Window.partitionBy(*k)).alias(n) for n in least))
    within = Window.partitionBy(*k, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_in_{n}": getattr(F, f)(c).over(within) for n, (f, c, _) in sums.items()})
    out = rows.join(per, [*k, "_part"])
    joined = [F.when(F.col(f"_before_{n}").isNull(), F.col(f"_in_{n}")).otherwise(both(F.col(f"_before_{n}"), F.col(f"_in_{n}"))).alias(n) for n, (_, _, both) in sums.items()]
    return out.select(*df.columns, *joined, *least)
