"""Near-copies by Order MinHash, completed by an exact join; candidates verified by banded alignment.

1. A text's words give 5-word shingles, each labelled with how often it has occurred before in that text. In
   each of BANDS bands the DEPTH shingles with the least hash under that band's function are taken in
   their text order; together, in that order, they are the band's sketch. Moved and repeated passages
   change it, so texts meet by edit similarity and not by their sets of shingles alone. This joins most copies cheaply.
2. A link is an alignment of the words with a similarity 1 - edits / longer length of SIMILARITY or more, and nothing
   else. Alignment stays in the band of diagonals that this allows, a machine word of diagonals at a time.
3. Texts with equal words are one node. Nodes that share a sketch are a bucket. First each bucket's least node is
   compared with the others, which joins most groups of copies by as many pairs as they have members. Then only
   nodes that are not joined yet are compared: all such pairs in buckets of up to CLIQUE nodes.
4. An exact join finds all other links, whatever the sketches missed. At each place of a text begins a gram: its word if that is rare, else two
   words, else three (GRAM; the end of the text counts as a word). Rare means about RARE times in the whole table, so the larger the table, the
   longer the grams, and the buckets don't grow with it. What is rare depends on the gram alone, so where a run of words is left alone both texts
   have the same grams. Order all grams in one way, the rare ones first. Disjoint grams need an edit each, so a text's grams up to the first k
   disjoint ones more than the edits that a link allows (its prefix) hold k grams of any text that it aligns with, which has them in its prefix
   too; a gram that a text has several times counts as often as both have it. Prefixes are dealt by ranges of grams, packed, and compared a range at a
   time; pairs that meet in k grams are aligned, k growing with their length (SPARE), first those that meet most often (NEAREST), then those that are
   still apart. A gram that both texts have once must also stand at places which the edits allow, and texts with a frequent gram in their prefix
   carry a signature, bits of their words: each bit that the other lacks needs an edit. Any order and any grams give the same links; only how
   many pairs are tried depends on them, so the frequencies may come from a bounded sample of texts (SAMPLE).
5. All links together make classes by connected components (large star, small star), after each task has joined its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import discard, keyed_text, partitions, written
from tideframe.llm.quality_rules import window_hashes, word_hashes

SHINGLE, SIMILARITY, BANDS, DEPTH = 5, 0.8, 16, 2
CLIQUE = 24
#: What the buckets of sketches do before the exact join, which alone finds the same links by more pairs.
LEVELS = ("stars", "cliques")
#: A pair must meet in one more bucket of the exact join for each SPARE words; texts whose words are counted for their order, and bins of the counts;
#: nodes of a bucket that one task compares with as many others.
SPARE, SAMPLE, BINS, BLOCK = 40, 20_000, 1 << 20, 1024
#: Words of all texts for each range of grams, which a task compares at once; 64-bit numbers of a signature; pairs of a node that are aligned before the others.
RANGE, SIGNATURE, NEAREST = 1_000_000, 4, 8
#: Most words of a gram; how often one occurs in the table that isn't made longer; how often grams of several words occur in the sample that are counted as such.
GRAM, RARE, OFTEN = 3, 64, 8
_END = np.uint64(1 << 32)
_NONE = [bytes(k) for k in range(GRAM + 1)]
_MIX, _NTH = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


_SEEDS = _mixed(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of hashed words, in text order; a shorter text has one, of all its words."""
    h = window_hashes(words.astype(np.uint64), min(size, max(len(words), 1)))
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        at = np.arange(len(h))
        nth = np.empty(len(h), np.uint64)
        nth[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        h = _mixed(h + nth * _NTH)
    return h


def sketch(words: np.ndarray, bands: int = BANDS, first: int = 0, depth: int = DEPTH, size: int = SHINGLE) -> list[int]:
    """One number for each of the bands from `first` on; none for a text without words. All bands of a step of shingles are taken at once."""
    h = shingles(words, size)
    if not len(h):
        return []
    seeds = _SEEDS[first : first + bands]
    at = np.empty((bands, min(depth, len(h))), np.int64)
    step = max(1, 200_000 // len(h))
    for b in range(0, bands, step):
        mixed = _mixed(h[None, :] ^ seeds[b : b + step, None])
        for k in range(at.shape[1]):
            at[b : b + step, k] = least = mixed.argmin(1)
            mixed[np.arange(len(mixed)), least] = np.iinfo(np.uint64).max
    at.sort(axis=1)  # text order
    together = seeds.copy()
    for k in range(at.shape[1]):
        together = _mixed(together * _MIX + h[at[:, k]])
    return together.view(np.int64).tolist()


def node_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key: a number that rows have in common only if they have doc_id and text in common (or by a rare chance)."""
    return keyed_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def sketches(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """doc_id, key, node (16 bytes: equal for equal words), n_words, sketch of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                words = [words_of(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(list(map(node_of, words)), pa.binary()), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([sketch(word_hashes(w), bands) for w in words], pa.list_(pa.int64())),
                ], names=["doc_id", "key", "node", "n_words", "sketch"])

    return keyed(docs).select("doc_id", "key", "text").mapInArrow(of, "doc_id long, key long, node binary, n_words long, sketch array<long>")


def edits(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two word sequences, or most + 1 if it is greater.

    The band of 2 * most + 1 diagonals is one whole number, whose bits are the differences of neighbouring cells; a column of the
    table takes a dozen operations on it. The distance is followed along the diagonal of the last cell, on which
    it never falls, so a pair that is too far apart is given up where it passes `most`.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    places: dict[int, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    # frequent words as bit masks of all their places, others place by place
    often = max(16, m // 256)
    masks = {w: sum(1 << i for i in p) for w, p in places.items() if len(p) > often}
    width = 2 * most + 1
    full = (1 << width) - 1
    track, score = m - n + most, max(m - n, 0)
    up, down = full >> most << most, 0
    for first, w in enumerate(b, -most):
        if w in masks:
            same = (masks[w] >> first if first >= 0 else masks[w] << -first) & full
        else:
            same = 0
            for i in places.get(w, ()):
                if first <= i < first + width:
                    same |= 1 << (i - first)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        if not diagonal >> track & 1:
            score += 1
            if score > most:
                return score
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        diagonal >>= 1
        up, down = left | (full & ~(diagonal | right)), diagonal & right
    return score


def _rising(y: np.ndarray) -> np.ndarray:
    """Places of a longest rising part of y, whose values differ."""
    if (y[1:] > y[:-1]).all():
        return np.arange(len(y))
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(y)
    for k, v in enumerate(y.tolist()):
        at = bisect_left(ends, v)
        before[k] = last[at - 1] if at else -1
        ends[at : at + 1] = [v]
        last[at : at + 1] = [k]
    out, k = [], last[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out[::-1])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Numbers of edits that are surely needed and that surely do.

    Needed: words that one has more often than the other. Enough: align the words that both have once, in a longest common
    order; between them equally long gaps are compared word by word, others replaced whole.
    """
    n, m = len(a), len(b)
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = np.bincount(at[:n], minlength=len(values)), np.bincount(at[n:], minlength=len(values))
    needed = int(max(np.maximum(in_a - in_b, 0).sum(), np.maximum(in_b - in_a, 0).sum()))
    place_a, place_b = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    place_a[at[:n]], place_b[at[n:]] = np.arange(n), np.arange(m)
    once = np.flatnonzero((in_a == 1) & (in_b == 1))
    if not len(once):
        return needed, max(n, m)
    once = once[np.argsort(place_a[once])]
    once = once[_rising(place_b[once])]
    x, y = np.concatenate([[-1], place_a[once], [n]]), np.concatenate([[-1], place_b[once], [m]])
    dx, dy = np.diff(x) - 1, np.diff(y) - 1
    even = dx == dy
    enough = int(np.maximum(dx, dy)[~even].sum())
    every = np.arange(n)
    gap = np.searchsorted(x, every, side="right") - 1
    every, gap = every[even[gap]], gap[even[gap]]
    return needed, enough + int((a[every] != b[every + (y - x)[gap]]).sum())


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sequences of hashed words align with this similarity. Bounds settle most pairs without a search."""
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    k = min(len(a), len(b))
    other = np.flatnonzero(a[:k] != b[:k])
    start = int(other[0]) if len(other) else k
    a, b, k = a[start:], b[start:], k - start
    other = np.flatnonzero(a[::-1][:k] != b[::-1][:k])
    end = int(other[0]) if len(other) else k
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= most
    needed, enough = bounds(a, b)
    return needed <= most and (enough <= most or edits(a.tolist(), b.tolist(), most) <= most)


def similar(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """aligned() of words of 4 bytes each."""
    return a == b or aligned(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), least)


def _node_words(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """node, words (4 bytes each) of every node, or of the wanted (node, key)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = [(n, w) for t in batch.column(0).slice(k, 500).to_pylist() if (n := node_of(w := words_of(t)))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([n for n, _ in rows], pa.binary()), pa.array([word_hashes(w).astype(np.uint32).tobytes() for _, w in rows], pa.binary()),
                ], names=["node", "words"])

    texts = keyed(docs).select("key", "text")
    if wanted is not None:
        texts = texts.join(wanted.select("key").distinct(), "key", "left_semi")
    return texts.select("text").mapInArrow(of, "node binary, words binary").groupBy("node").agg(F.first("words").alias("words"))


def _in_company(members: DataFrame) -> DataFrame:
    """Members (bucket, ...) of buckets with more than one, and the bucket's size."""
    return members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket")


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """members that have a root with the root after the links (root_a, root_b) between roots."""
    tops = joined_so_far(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    rows = members.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return rows.withColumn("root", F.coalesce("top", "root")).select(*members.columns)


def _pair(x: str, y: str) -> list:
    return [F.col(f"{s}.{c}").alias(f"{c}_{t}") for s, t in ((x, "a"), (y, "b")) for c in ("node", "n_words", "root")]


def _star_pairs(members: DataFrame) -> DataFrame:
    """The least node of each bucket with every other one."""
    least = members.groupBy("bucket").agg(F.min(F.struct("node", "n_words", "root")).alias("x"))
    return members.select("bucket", F.struct("node", "n_words", "root").alias("y")).join(least, "bucket").select(*_pair("x", "y"))


def _clique_pairs(members: DataFrame) -> DataFrame:
    """All pairs of the members of each bucket, of which none has more than CLIQUE."""
    sets = members.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "n_words", "root"))).alias("m"))
    sets = sets.select("m", F.posexplode("m").alias("i", "x"))
    return sets.select("x", F.explode(F.slice("m", F.col("i") + 2, CLIQUE)).alias("y")).where("x.root != y.root").select(*_pair("x", "y"))


def _alike(least: float):
    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y, least) for x, y in zip(a, b, strict=True)])

    return alike


def _links(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b, root_a, root_b) of different components whose words align, each once."""
    fits = F.least("n_words_a", "n_words_b") >= F.lit(least) * F.greatest("n_words_a", "n_words_b") - 1
    ends = F.array_sort(F.array(*(F.struct(F.col(f"node_{x}").alias("node"), F.col(f"root_{x}").alias("root")) for x in "ab")))
    rows = pairs.where(fits & (F.col("root_a") != F.col("root_b"))).select(ends.alias("e"))
    rows = rows.select(*(F.col("e")[k][c].alias(n) for k, x in enumerate("ab") for c, n in (("node", x), ("root", f"root_{x}")))).distinct()
    rows = rows.join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
    rows = rows.join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")
    return rows.where(_alike(least)("words_a", "words_b")).select("a", "b", "root_a", "root_b")


def _aligned_pairs(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """a, b: the nodes of those pairs (id_a, id_b) whose words align."""
    for x in "ab":
        pairs = pairs.join(words.select(F.col("id").alias(f"id_{x}"), F.col("node").alias(x), F.col("words").alias(f"words_{x}")), f"id_{x}")
    return pairs.where(_alike(least)("words_a", "words_b")).select("a", "b")


def most_edits(n: int, least: float = SIMILARITY) -> int:
    return int((1 - least) * n + 1e-9)


def longest_gram(least: float = SIMILARITY) -> int:
    """The most words, up to GRAM, that some run which the edits of a link leave alone has for sure, the end of the text counted as one."""
    pairs = [(n, most_edits(n, least)) for n in range(1, 1000)]
    return max(1, min([GRAM, *(-(-(n - m + 1) // (m + 1)) for n, m in pairs if m)]))


def _ended(words: np.ndarray) -> np.ndarray:
    return np.append(words.astype(np.uint64), _END)


def _counted(rows: DataFrame, key: str, least: int) -> pd.DataFrame:
    """key, n: sums of n of at least `least`."""
    table = written(rows.groupBy(key).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "counts")
    out = table.toPandas()
    discard(table)
    return out


def word_counts(some: DataFrame, bins: int = BINS) -> np.ndarray:
    """How often hashed words occur in these texts, by bin of their hash: a table of a fixed size that says which words are rare."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            for w in batch.column(0).to_pylist():
                np.add.at(total, window_hashes(_ended(np.frombuffer(w, np.uint32)), 1) % np.uint64(bins), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bin", "n"])

    found = _counted(some.select("words").mapInArrow(of, "bin int, n long"), "bin", 2)
    out = np.ones(bins, np.uint32)
    out[found["bin"].to_numpy()] = found["n"].to_numpy()
    return out


def gram_counts(some: DataFrame, counts: np.ndarray, most: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the grams of 2 to `most` words that occur OFTEN times or more in these texts, and how often: passages that texts share."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                found = [np.zeros(0, np.uint64)]
                for w in batch.column(0).slice(k, 500).to_pylist():
                    w = _ended(np.frombuffer(w, np.uint32))
                    known = counts[window_hashes(w, 1) % np.uint64(len(counts))] >= OFTEN
                    for size in range(2, min(most, len(w)) + 1):
                        known = known[:-1] & known[-len(known) + 1 :]
                        found.append(window_hashes(w, size)[known])
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    rows = _counted(some.select("words").mapInArrow(of, "gram long, n long"), "gram", OFTEN)
    grams, n = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.float64)
    order = np.argsort(grams)
    return grams[order], n[order]


def grams_of(texts: list[np.ndarray], counts: np.ndarray, rare: float, total: float, often: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of words and expected count of the gram that begins at each word of each text, and at its end. total: of the counts; often: gram_counts."""
    ended = np.concatenate([_ended(w) for w in texts])
    last = np.repeat(np.cumsum([len(w) + 1 for w in texts]) - 1, [len(w) + 1 for w in texts])
    grams = window_hashes(ended, 1)
    single = counts[grams % np.uint64(len(counts))].astype(np.float64)
    size, weight = np.ones(len(ended), np.int64), single.copy()
    at = np.flatnonzero((weight > rare) & (ended != _END))
    for length in range(2, most + 1):
        at = at[at + length <= last[at] + 1]
        if not len(at):
            break
        grams[at], size[at] = window_hashes(ended, length)[at], length
        expected = weight[at] * single[at + length - 1] / total
        if len(often[0]):
            may = np.flatnonzero((single[at] >= OFTEN) & (single[at + length - 1] >= OFTEN))
            k = np.minimum(np.searchsorted(often[0], grams[at[may]]), len(often[0]) - 1)
            expected[may] = np.maximum(expected[may], np.where(often[0][k] == grams[at[may]], often[1][k], 0))
        weight[at] = expected
        at = at[expected > rare]
    return grams, size, weight


def prefixes_of(texts: list[np.ndarray], counts: np.ndarray, least: float = SIMILARITY, rare: float = np.inf, total: float = 1, often: tuple = ((), ()), most: int = GRAM) -> list[tuple]:
    """For each text: hashes of the different grams that come first in the order of (count, hash), as many as the exact join needs, in that order; the place
    in the text of each that it has once, else less than 0, the number of its places; how many disjoint places come before each; how many
    places of such grams a text that aligns has in common for sure; and whether a frequent gram is among them."""
    if not texts:
        return []
    grams, size, weight = grams_of(texts, counts, rare, total, often, most)
    out, start = [], 0
    for w in texts:
        n, part = len(w), slice(start, start + len(w))
        start += n + 1
        h, g = grams[part], size[part]
        order = np.lexsort((h, weight[part]))
        h = h[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if n else np.zeros(0, np.int64)
        needed = n // SPARE + 2
        # an edit is in one of several disjoint places; words that a longer text has besides only part grams of several words, of which `long` are counted
        free, count, long, goal = bytearray(b"\1" * (n + GRAM)), 0, 0, most_edits(n, least) + needed
        before: list[int] = []
        places, sizes, ends = order.tolist(), g[order].tolist(), [*new[1:].tolist(), n]
        at = 0
        for end in ends if n else ():
            if count >= goal:
                goal = most_edits(n + long, least) + needed
                if count >= goal:
                    break
            before.append(count)
            k = sizes[at]
            while at < end:
                i = places[at]
                at += 1
                if free[i] and (k == 1 or free[i + 1] and (k == 2 or 0 not in free[i : i + k])):
                    free[i : i + k] = _NONE[k]
                    count += 1
                    long += k > 1
        stop = len(before)
        times = np.diff(np.append(new, n))[:stop]
        first = order[new[:stop]]
        frequent = bool(stop) and bool(weight[part][first[-1]] > rare)
        out.append((h[new[:stop]], np.where(times == 1, first, -times), np.array(before, np.int64), max(1, count - most_edits(n + long, least)), frequent))
    return out


def prefix_of(
    words: np.ndarray, counts: np.ndarray, least: float = SIMILARITY, rare: float = np.inf, total: float = 1, often: tuple = ((), ()), most: int = GRAM
) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """prefixes_of() of one text, with as many hashes for a gram as it has places, which differ: hashes, places (-1 of those the text has several times), in
    how many of them a text that aligns is met for sure, and how many disjoint ones come before each."""
    h, at, before, needed, _ = prefixes_of([words], counts, least, rare, total, often, most)[0]
    times = np.maximum(-at, 1)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    h = np.repeat(h, times)
    h = np.where(nth > 0, _mixed(h + nth.astype(np.uint64) * _NTH), h)
    return h.view(np.int64), np.repeat(np.maximum(at, -1), times), needed, np.repeat(before, times).astype(np.int32)


def prefix(words: np.ndarray, counts: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """prefix_of() of single words, hashes and places."""
    return prefix_of(words, counts, least)[:2]


def _planes(x: np.ndarray) -> bytes:
    """x byte by byte, all first bytes first: what the numbers have in common (most high bytes are 0) compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(x: bytes, kind: type, width: int = 1) -> np.ndarray:
    size = np.dtype(kind).itemsize * width
    out = np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind)
    return out.reshape(-1, width) if width > 1 else out.reshape(-1)


#: Texts of some rows: id, root, number of words, in how many places of grams a link is met for sure, signature (0: none). Rows: gram, text, before, at.
_TEXTS = (("id", np.int64, 1), ("root", np.int64, 1), ("n_words", np.int32, 1), ("quota", np.int32, 1), ("rows", np.int32, 1), ("signature", np.uint64, SIGNATURE))
_ROWS = (("gram", np.uint32, 1), ("before", np.int32, 1), ("at", np.int32, 1))
_PACKED = ", ".join(f"{c} binary" for c, *_ in _TEXTS + _ROWS)


def signature(words: np.ndarray) -> np.ndarray:
    """Bits of the text's different words. A word that another text lacks needs an edit, so as many bits that another text lacks need as many."""
    bits = np.zeros(64 * SIGNATURE, bool)
    bits[(_mixed(words.astype(np.uint64) * _MIX) >> np.uint64(20)) % np.uint64(len(bits))] = True
    return np.packbits(bits).view(np.uint64)


def _packed(texts: dict[str, np.ndarray], rows: dict[str, np.ndarray], part: np.ndarray) -> list[bytes]:
    """The columns of _PACKED for those rows `part` (ascending) of texts whose rows lie one after another; without texts that have none."""
    count = np.bincount(rows["text"][part], minlength=len(texts["id"]))
    some = np.flatnonzero(count)
    out = {c: _planes(texts[c][some]) for c, *_ in _TEXTS if c not in ("root", "rows", "signature")} | {"rows": _planes(count[some].astype(np.int32))}
    # most texts are their own component, and have no signature: zeros take no place
    sig = texts["signature"][some]
    out |= {"root": _planes(texts["root"][some] ^ texts["id"][some]), "signature": _planes(sig) if sig.any() else b""}
    return [(out | {c: _planes(rows[c][part]) for c, *_ in _ROWS})[c] for c, *_ in _TEXTS + _ROWS]


def _unpacked(columns: list[list[bytes]]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """texts and rows of several packed ones together."""
    got = {c: [_unplanes(x, kind, width) for x in column] for (c, kind, width), column in zip(_TEXTS + _ROWS, columns, strict=True)}
    got["signature"] = [x if len(x) else np.zeros((len(i), SIGNATURE), np.uint64) for x, i in zip(got["signature"], got["id"], strict=True)]
    flat = {c: np.concatenate(x) for c, x in got.items()}
    flat["root"] = flat["root"] ^ flat["id"]
    return {c: flat[c] for c, *_ in _TEXTS if c != "rows"}, {c: flat[c] for c, *_ in _ROWS} | {"text": np.repeat(np.arange(len(flat["id"])), flat["rows"])}


def _prefixes(words: DataFrame, least: float) -> DataFrame:
    """The prefixes of all nodes, packed: one row for each range of grams (`bucket`) and each batch of texts. words: node, words, root (null: the node),
    and possibly id (else by the hash of the node; the root's must be given by it)."""
    spark = words.sparkSession
    found = words.agg(F.count(F.lit(1)), F.sum(F.length("words"))).first()
    share, most = min(1.0, SAMPLE / max(found[0], 1)), longest_gram(least)
    ranges = max(partitions(spark), (found[1] or 0) // (4 * RANGE) + 1)
    some = words.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    counts = word_counts(some)
    known = spark.sparkContext.broadcast((counts, gram_counts(some, counts, most)))
    rare, total = RARE * share, float(counts.sum())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, often = known.value
        for batch in batches:
            ids, roots = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            length, needed, sig, got = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32), np.zeros((len(ids), SIGNATURE), np.uint64), []
            for k in range(0, batch.num_rows, 500):
                texts = [np.frombuffer(w, np.uint32) for w in batch.column(2).slice(k, 500).to_pylist()]
                for i, (w, p) in enumerate(zip(texts, prefixes_of(texts, counts, least, rare, total, often, most), strict=True), k):
                    length[i], needed[i] = len(w), p[3]
                    if p[4]:
                        sig[i] = signature(w)
                    got.append(p[:3])
            gram = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.uint64)
            if not len(gram):
                continue
            rows = {"gram": gram.astype(np.uint32), "at": np.concatenate([g[1] for g in got]).astype(np.int32), "before": np.concatenate([g[2] for g in got]).astype(np.int32)}
            rows["text"] = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
            table = {"id": ids, "root": roots, "n_words": length, "quota": needed, "signature": sig}
            bucket = (gram >> np.uint64(32)) % np.uint64(ranges)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(bucket[order].astype(np.int64)) != 0))
            parts = np.split(order, first[1:])
            columns = zip(*(_packed(table, rows, p) for p in parts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first].astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", *(c for c, *_ in _TEXTS + _ROWS)])

    own = F.col("id") if "id" in words.columns else F.xxhash64("node")
    root = F.col("root") if dict(words.dtypes)["root"] == "bigint" else F.when(F.col("root").isNotNull(), F.xxhash64("root"))
    return words.select(own.alias("id"), F.coalesce(root, own).alias("root"), "words").mapInArrow(of, f"bucket int, {_PACKED}")


def _compared(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows i and j, of which j has no fewer words, can be of a link that meets there, as places in i; and how many places of the gram both have."""
    most = ((1 - least) * x["n_words"][j] + 1e-9).astype(np.int64)
    k = np.flatnonzero((x["root"][i] != x["root"][j]) & (np.maximum(x["before"][i], x["before"][j]) < most + np.minimum(x["quota"][i], x["quota"][j])))
    i, j, most = i[k], j[k], most[k]
    a, b = x["at"][i], x["at"][j]
    near = (a < 0) | (b < 0) | (np.abs(a - b) + np.abs(x["n_words"][i] - a - (x["n_words"][j] - b)) <= most)
    k, i, j, most, a, b = k[near], i[near], j[near], most[near], a[near], b[near]
    both = np.flatnonzero(x["signed"][i] & x["signed"][j])
    p, q = (x["signature"][x["text"][y[both]]] for y in (i, j))
    fits = np.ones(len(k), bool)
    fits[both] = np.maximum(np.bitwise_count(p & ~q).sum(1), np.bitwise_count(q & ~p).sum(1)) <= most[both]
    return k[fits], np.minimum(np.maximum(-a[fits], 1), np.maximum(-b[fits], 1))


def _laid_out(texts: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows with what their texts say, ordered by gram and number of words; without the grams of one component."""
    order = np.lexsort((texts["n_words"][rows["text"]], rows["gram"]))
    gram, root = rows["gram"][order], texts["root"][rows["text"][order]]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    kept = np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), np.diff(np.append(first, len(gram))))
    order = order[kept]
    x = {c: v[order] for c, v in rows.items()}
    signed = texts["signature"].any(1)
    return x | {c: texts[c][x["text"]] for c in ("id", "root", "n_words", "quota")} | {"signature": texts["signature"], "signed": signed[x["text"]]}


def _pairs_of(x: dict[str, np.ndarray], least: float, first: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """id_a, id_b, n, needed of the pairs that meet in a gram: each row of x in `first` with those after it up to its `end`, of which the first has no fewer words
    than the others' edits allow. n: in how many places."""
    out: list[tuple[np.ndarray, ...]] = []
    i, d = first, 0
    while len(i):
        d += 1
        more = i + d < end
        i, end = i[more], end[more]
        j = i + d
        longer = x["n_words"][j]
        more = longer - x["n_words"][i] <= ((1 - least) * longer + 1e-9).astype(np.int64)
        i, j, end = i[more], j[more], end[more]
        k, n = _compared(x, i, j, least)
        a, b = x["id"][i[k]], x["id"][j[k]]
        out.append((np.minimum(a, b), np.maximum(a, b), n, np.minimum(x["quota"][i[k]], x["quota"][j[k]])))
    a, b, n, needed = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    if not len(a):
        return {"id_a": a, "id_b": b, "n": n, "needed": needed}
    order = np.lexsort((b, a))
    a, b, n, needed = a[order], b[order], n[order], needed[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return {"id_a": a[new], "id_b": b[new], "n": np.add.reduceat(n, new), "needed": needed[new]}


def _met(left: DataFrame, right: DataFrame, on: list[str], least: float) -> DataFrame:
    """id_a, id_b, n, needed of nodes of different components that meet in grams where a link's would, in n places of each task's grams, of `needed` in all; written.
    left, right: packed rows, which are compared where they agree in `on`; they may be one table. Grams of over BLOCK rows are compared in pairs of blocks, each a task's share."""
    names, numbers = [c for c, *_ in _TEXTS + _ROWS], ("id_a", "id_b", "n", "needed")

    def told(pairs: dict[str, np.ndarray]) -> pa.RecordBatch:
        k = len(pairs["id_a"])
        arrays = [*(pa.array(pairs[c].astype(np.int64)) for c in numbers), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), *(pa.nulls(k, pa.binary()) for _ in names)]
        return pa.RecordBatch.from_arrays(arrays, names=[*numbers, "task", "split", *names])

    def blocks(x: dict[str, np.ndarray], first: int, end: int) -> Iterator[pa.RecordBatch]:
        """The rows from first to end, as pairs of blocks."""
        cuts = [*range(first, end, BLOCK), end]
        spans = [np.arange(p, q) for p, q in zip(cuts, cuts[1:], strict=False)]
        for p, one in enumerate(spans):
            for other in spans[p:]:
                long = x["n_words"][other[0]]
                if long - x["n_words"][one[-1]] > (1 - least) * long + 1e-9:
                    break
                both = one if other is one else np.concatenate([one, other])
                table = {c: x[c][both] for c in ("id", "root", "n_words", "quota")} | {"signature": x["signature"][x["text"][both]]}
                rows = {c: x[c][both] for c, *_ in _ROWS} | {"text": np.arange(len(both))}
                packed = _packed(table, rows, np.arange(len(both)))
                key = int(_mixed(np.array([int(x["gram"][first]) << 32 | int(one[0]) << 12 ^ int(other[0])], np.uint64)).view(np.int64)[0])
                arrays = [*(pa.nulls(1, pa.int64()) for _ in numbers), pa.array([key]), pa.array([0 if other is one else len(one)], pa.int32()), *(pa.array([c], pa.binary()) for c in packed)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*numbers, "task", "split", *names])

    def met_in(columns: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        x = _laid_out(*_unpacked(columns))
        gram = x["gram"]
        if not len(gram):
            return
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(first, len(gram)))
        end = np.where(size <= BLOCK, first + size, 0)
        yield told(_pairs_of(x, least, np.arange(len(gram)), np.repeat(end, size)))
        for k in np.flatnonzero(size > BLOCK):
            yield from blocks(x, int(first[k]), int(first[k] + size[k]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in names]
        for batch in batches:
            keys, columns = list(zip(*(batch.column(c).to_pylist() for c in on), strict=True)), [batch.column(c).to_pylist() for c in names]
            for k, now in enumerate(keys):
                if now != key and key is not None:
                    yield from met_in(held)
                    held = [[] for _ in names]
                key = now
                for to, column in zip(held, columns, strict=True):
                    to.append(column[k])
        if key is not None:
            yield from met_in(held)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, rows = _unpacked([[row[c]] for c in names])
                x = rows | {c: texts[c] for c in ("id", "root", "n_words", "quota", "signature")} | {"signed": texts["signature"].any(1)}
                k, split = len(x["id"]), row["split"]
                out = []
                for i in range(split or k):
                    j = np.arange(split or i + 1, k)
                    one = np.full(len(j), i)
                    at, n = _compared(x, one, j, least)
                    a, b = x["id"][one[at]], x["id"][j[at]]
                    out.append((np.minimum(a, b), np.maximum(a, b), n, np.minimum(x["quota"][i], x["quota"][j[at]])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=numbers)

    rows = left if right is left else left.unionByName(right)
    kinds = "id_a long, id_b long, n long, needed long"
    dealt = rows.repartition(*on).sortWithinPartitions(*on).mapInArrow(of, f"{kinds}, task long, split int, {_PACKED}")
    table = written(dealt, "met")
    pairs = table.where("task is null").select(*numbers)
    return pairs.unionByName(table.where("task is not null").select("task", "split", *names).repartition("task").drop("task").mapInArrow(across, kinds))


def _all_met(members: DataFrame, least: float) -> DataFrame:
    """id_a, id_b, n: all pairs that meet as often as they must, and how often."""
    rows = _met(members, members, ["bucket"], least)
    return rows.groupBy("id_a", "id_b").agg(F.sum("n").alias("n"), F.min("needed").alias("needed")).where("n >= needed").select("id_a", "id_b", "n")


def _nearest(pairs: DataFrame, most: int = NEAREST) -> DataFrame:
    """id_a, id_b of those pairs that are among the `most` of one of their nodes which meet most often."""
    ends = pairs.select(F.col("id_a").alias("id"), "id_a", "id_b", "n").unionByName(pairs.select(F.col("id_b").alias("id"), "id_a", "id_b", "n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "id_a", "id_b"))
    return ends.withColumn("place", place).where(F.col("place") <= most).select("id_a", "id_b").distinct()


def forest(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """node, root: for each task's edges (a, b), up to `most` nodes at a time, what they join, each node with the least one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (y := top.setdefault(x, x)) != x:
                top[x] = x = top[y]
            return x

        def found() -> pa.RecordBatch:
            rows = [(x, find(x)) for x in list(top)]
            rows = [r for r in rows if r[0] != r[1]]
            top.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k in (0, 1)], names=["node", "root"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    top[max(x, y)] = min(x, y)
            if len(top) > most:
                yield found()
        yield found()

    kind = pa.binary() if edges.schema["a"].dataType.simpleString() == "binary" else pa.int64()
    return edges.select("a", "b").mapInArrow(of, "node binary, root binary" if kind == pa.binary() else "node long, root long")


def joined_so_far(links: DataFrame) -> DataFrame:
    """node, root: part of what the links (a, b) join, in two steps; enough to leave out most pairs that are joined already."""
    once = forest(links).groupBy("node").agg(F.min("root").alias("root"))
    again = once.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return once.join(again, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node in edges (a, b) but the roots themselves, written."""
    edges = written(forest(edges).where("node != root").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = large.where("node != root").distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node != root").unionByName(least.select("node", F.col("m").alias("root")))
        before, old = now, edges
        edges = written(small.distinct(), "edges")
        discard(old)


def groups(docs: DataFrame, rows: DataFrame, least: float = SIMILARITY, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """node, root of every node that is linked with another and isn't the least of its component, written. rows: sketches(docs), written."""
    words = written(_node_words(docs), "words")
    tables: list[DataFrame] = []

    def linked(pairs: DataFrame, some: DataFrame) -> DataFrame:
        tables.append(written(_links(pairs, some, least), "links"))
        return tables[-1]

    def joined() -> DataFrame:
        return components(reduce(DataFrame.unionByName, (t.select("a", "b") for t in tables)))

    roots = None
    if "stars" in levels:
        nodes = rows.groupBy("node").agg(F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"))
        members = written(_in_company(nodes.select("node", "n_words", F.explode("sketch").alias("bucket"))), "members")
        some = written(words.join(members.select("node").distinct(), "node", "left_semi"), "some")
        bare, members = members, members.withColumn("root", F.col("node"))
        known = written(_rooted(members, linked(_star_pairs(members), some)), "known")
        discard(bare)
        if "cliques" in levels:
            linked(_clique_pairs(known.where(F.col("size") <= CLIQUE)), some)
        discard(known, some)
        roots = joined()
    # its exchange goes before that of the prefixes comes; a root is its own component's too, and others have null
    tops = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).select("node", F.xxhash64("root").alias("root")) if roots else None
    bare, words = words, words.join(tops, "node", "left") if roots else words.withColumn("root", F.lit(None).cast("long"))
    words = written(words.withColumn("id", F.monotonically_increasing_id()), "words")
    discard(bare, *([roots] if roots else []))
    found = written(_all_met(_prefixes(words, least), least), "pairs")
    bare, words = words, written(words.select("id", "node", "words").join(found.select(F.col("id_a").alias("id")).union(found.select("id_b")).distinct(), "id", "left_semi"), "some")
    discard(bare)
    # what the pairs that meet most often join needn't be aligned any more
    first = written(_nearest(found), "nearest")
    tables.append(written(_aligned_pairs(first, words, least), "links"))
    roots = joined()
    rest = found.select("id_a", "id_b").join(first, ["id_a", "id_b"], "left_anti")
    known = written(words.select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root")), "known")
    for x in "ab":
        rest = rest.join(known.select(F.col("id").alias(f"id_{x}"), F.col("root").alias(f"root_{x}")), f"id_{x}")
    tables.append(written(_aligned_pairs(rest.where("root_a != root_b").select("id_a", "id_b"), words, least), "links"))
    discard(found, first, roots, known, words)
    out = joined()
    discard(*tables)
    return out


def _known(docs: DataFrame, least: float, bands: int) -> DataFrame:
    """doc_id, key, root of every row, written."""
    rows = written(sketches(docs, bands), "sketches")
    roots = groups(docs, rows, least)
    known = written(rows.select("doc_id", "key", "node").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root")), "known")
    discard(rows, roots)
    return known


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), class_size of every row.

    Null and empty texts have no words and are one class of equal texts. Copies of a text are in one class without being
    compared. Rows of one doc_id with different texts may be in different classes; where a class has no
    doc_id at all its class_id is null. An empty table gives no rows.
    """
    known = _known(docs, least, bands)
    sizes = known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return known.join(sizes, "root").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """docs without all but one row of each class: the one with the least doc_id, and of several texts of that doc_id one by hash.

    Rows without doc_id come after all others, so they stay only where their class has none. Of rows that repeat doc_id and text one stays.
    """
    known = _known(docs, least, bands)
    kept = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    rows = known.join(kept, "root").groupBy("key").agg(F.max(F.col("key") == F.col("x.key")).alias("stays"), F.count(F.lit(1)).alias("n"))
    rows = written(rows.where("not stays or n > 1"), "gone")
    discard(known)
    own, key = "__near_copies_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    out = docs.withColumn(own, key).join(rows.where("not stays").select(F.col("key").alias(own)), own, "left_anti")
    repeated = rows.where("stays").select(F.col("key").alias(own))
    if not repeated.isEmpty():
        out = out.join(repeated, own, "left_anti").unionByName(out.join(repeated, own, "left_semi").dropDuplicates([own]))
    return out.select(*docs.columns)
