"""Prefix trie of conversations by collapsing whole sequences.

1. Turns are ordered within conversations in blocks (functions.blocks), so that a conversation of any length is many tasks' work, and
   rebuilt: the first turns of the head of their hundred, then their own. Texts stay where they are: what moves is two 64-bit
   hashes of (role, text) and its length.
2. A prefix's id is the exclusive or, over its turns, of two 64-bit hashes of place and turn: a running aggregate, and the id of the
   parent is one exclusive or away. 128 bits tell prefixes apart.
3. Whole sequences that are equal collapse to one with a weight, the least conv_id, and a list of its ends, which is hashed in pieces.
   From here on the trie is that of distinct sequences; a group of copies, however large, is one row.
4. Sequences that are proper prefixes of others are dropped by an anti-join against the prefixes; the rest are leaves.
5. Weighted prefixes of all distinct sequences, aggregated by id, are the nodes. What concerns a node's subtree is summed in the same
   way, without visiting descendants: a node belongs to the sequence of least conv_id that runs through it, so each sequence owns one
   unbroken stretch of its path. A sum over a subtree is the sum of all owned stretches of the sequences that run through its
   top, less what the top's owner owns above it. Rows grow with turns of distinct sequences, not with their squares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions import blocks
from tideframe.llm.common import discard, partitions, written

HUNDRED, HEADS = 100, 6
#: Depths of one path that one task orders; conv_ids of one end list that are hashed as one piece; the share of all nodes that a parent
#: needs as children to be looked up by broadcast, of which there are at most its inverse.
WIDTH, PIECE, HOT = 4096, 50_000, 1e-4
ID = ["depth", "x", "y"]


def _hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_chars, a, b of every turn with a conv_id; null role and text are empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    return rows.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"), _hash(1, "role", "text").alias("a"), _hash(2, "role", "text").alias("b"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: conv_id of every conversation, and conv_id, depth (from 1), a, b, n_chars of every rebuilt turn.

    Turns that are equal in `turn` are ordered by role, length and hash of the text.
    """
    rows = blocks.dealt(turns(conversations), "conv_id", ["turn", "role", "n_chars", "a", "b"])
    starts = written(blocks.starts(rows, "conv_id"), "starts")
    head = F.col("conv_id") - F.col("conv_id") % HUNDRED
    # heads: a conversation in a hundred, and at most HEADS - 1 of its turns, which all lie in its first blocks
    first = starts.where((F.col("conv_id") % HUNDRED == 0) & (F.col("_before") < HEADS)).select("conv_id", "_block", "_first", "_before")
    first = rows.join(first, ["conv_id", "_block"]).withColumn("place", F.col("_before") + F.col("_id") - F.col("_first")).where(F.col("place") < HEADS - 1)
    heads = first.groupBy(F.col("conv_id").alias("head")).agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "n_chars"))).alias("turns"))
    convs = starts.select("conv_id", "_block", "_first", "_before").withColumns({"head": head, "h": (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")}).join(heads, "head", "left")
    convs = convs.withColumn("taken", F.slice(F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)), F.lit(1), F.col("h")))
    convs = written(convs.select("conv_id", "_block", "_first", "_before", "h", "taken"), "convs")
    own = rows.select("conv_id", "_block", "_id", "a", "b", "n_chars").join(convs.withColumn("n_taken", F.size("taken")).drop("taken"), ["conv_id", "_block"])
    place = F.col("_before") + F.col("_id") - F.col("_first")
    own = own.where(place >= F.col("h")).select("conv_id", (place - F.col("h") + F.col("n_taken") + 1).alias("depth"), "a", "b", "n_chars")
    taken = convs.where("_before = 0").select("conv_id", F.posexplode("taken").alias("k", "t")).select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), "t.a", "t.b", "t.n_chars")
    out = written(own.unionByName(taken), "rebuilt")
    every = written(convs.where("_before = 0").select("conv_id"), "every")
    discard(starts, convs)
    return every, out


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, x, y (the prefix's id), px, py (its parent's), n_chars of every rebuilt turn, written."""
    rows = rows.select("conv_id", "depth", "n_chars", _hash(3, "depth", "a", "b").alias("hx"), _hash(4, "depth", "a", "b").alias("hy"))
    both = lambda a, b: a.bitwiseXOR(b)
    out = blocks.running(rows, "conv_id", "depth", WIDTH, {"x": ("bit_xor", "hx", both), "y": ("bit_xor", "hy", both)})
    return written(out.select("conv_id", "depth", "x", "y", both(F.col("x"), F.col("hx")).alias("px"), both(F.col("y"), F.col("hy")).alias("py"), "n_chars"), "paths")


def end_lists(members: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256: the SHA-256 of each sequence's conv_ids, ascending, comma-joined.

    A long list is joined in pieces of a range of conv_ids each, by as many tasks, and then hashed piece by piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close():
            if held:
                out.append((*now, held[0], ",".join(map(str, held))))
                held.clear()

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((*[pa.int64()] * 4, pa.string()))], names=[*ID, "first", "piece"])
            out.clear()
            return batch

        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now or len(held) >= PIECE:
                    close()
                    now = key
                held.append(conv)
            yield emit()
        close()
        yield emit()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((*[pa.int64()] * 3, pa.string()))], names=[*ID, "ends_sha256"])
            out.clear()
            return batch

        for batch in batches:
            for *key, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == now:
                    state.update(b",")
                else:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(piece.encode())
            yield emit()
        if state:
            out.append((*now, state.hexdigest()))
        yield emit()

    n = partitions(members.sparkSession)
    order = [*ID, "conv_id"]
    joined = members.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pieces, "depth long, x long, y long, first long, piece string")
    return joined.repartition(n, *ID).sortWithinPartitions(*ID, "first").mapInArrow(hashed, "depth long, x long, y long, ends_sha256 string")


def _by_part(sequences: DataFrame, *columns: str) -> DataFrame:
    """rep, part, columns: a row for each WIDTH depths of a sequence's path, so that long paths are many keys."""
    return sequences.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("depth") / WIDTH))).alias("part"), *columns)


def _parents(tops: DataFrame, nodes: DataFrame, kids: DataFrame, n: int) -> DataFrame:
    """depth, x, y, parent_conv_id of tops, whose parents are other sequences' nodes.

    Parents of more than HOT of all n nodes, under 1 / HOT of them, are broadcast; no other parent is more than that share of a join's rows.
    """
    at = ["p_depth", "px", "py"]
    named = nodes.select(*(F.col(c).alias(p) for c, p in zip(ID, at, strict=True)), F.col("conv_id").alias("parent_conv_id"))
    many = kids.where(F.col("n_children") > HOT * n).select(*(F.col(c).alias(p) for c, p in zip(ID, at, strict=True)))
    hot = F.broadcast(named.join(many, at))
    tops = tops.withColumn("p_depth", F.col("depth") - 1)
    rest = tops.join(F.broadcast(many), at, "left_anti").join(named, at)
    return tops.join(hot, at).unionByName(rest).select(*ID, "parent_conv_id")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every prefix of rebuilt conversations.

    Null role and text are empty; a null turn comes first; rows without conv_id belong to no conversation; repeated rows are turns of their
    own. A conversation may be rebuilt to no turns and is then a member of the root only. No conversations give no rows.
    """
    every, rows = rebuilt(conversations)
    steps = paths(rows)
    discard(rows)
    whole = steps.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max(F.struct("depth", "x", "y")).alias("last"))
    zero = F.lit(0).cast("long")
    members = written(every.join(whole, "conv_id", "left").select("conv_id", F.coalesce("depth", zero).alias("depth"), F.coalesce("last.x", zero).alias("x"), F.coalesce("last.y", zero).alias("y")), "members")
    discard(every)
    sequences = written(members.groupBy(*ID).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "sequences")

    part = F.floor(F.col("depth") / WIDTH).alias("part")
    inner = steps.select(F.col("conv_id").alias("rep"), part, *ID, "px", "py", "n_chars").join(_by_part(sequences, "weight", F.col("depth").alias("full")), ["rep", "part"])
    none = F.lit(None).cast("long")
    root = sequences.select("rep", zero.alias("part"), zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("n_chars"), "weight", F.col("depth").alias("full"))
    prefixes = written(inner.unionByName(root), "prefixes")
    discard(steps)

    nodes = prefixes.groupBy(*ID).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("px").alias("px"), F.max("py").alias("py"), F.max("n_chars").alias("n_chars"), F.max(F.col("full") > F.col("depth")).alias("proper"),
    )
    nodes = written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars")).drop("n_chars"), "nodes")
    leaves = sequences.join(nodes.where("proper").select(*ID), ID, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.sum("saved").alias("owned"))
    of_sequence = sequences.select("rep", "depth").join(owned, "rep", "left").join(leaves, "rep", "left").fillna(0, ["owned", "leaf"])
    of_sequence = written(of_sequence, "of-sequence")
    below = prefixes.select("rep", "part", *ID).join(_by_part(of_sequence, "owned", "leaf"), ["rep", "part"])
    below = below.groupBy(*ID).agg(F.sum("leaf").alias("n_leaves"), F.sum("owned").alias("all_owned"))

    kids = written(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children")), "kids")
    # what the owner owns up to the node, and where its stretch begins
    along = written(blocks.running(nodes, "conv_id", "depth", WIDTH, {"up_to": ("sum", "saved", lambda a, b: a + b)}, {"top": "depth"}), "along")
    parents = _parents(along.where("depth > 0 and depth = top").select(*ID, "px", "py"), nodes, kids, nodes.count())
    out = along.join(below, ID).join(kids, ID, "left").join(parents, ID, "left").join(end_lists(members), ID, "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", (F.col("all_owned") - F.col("up_to") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
