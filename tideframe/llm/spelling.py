"""Spelling variants by a variable-length gram index.

1. Words are counted over whole texts; those of LEAST characters that occur often enough are the vocabulary.
2. Gram dictionary: at every place of a word a gram begins with QMIN characters and grows while it is too frequent, that is while
   more than SHARE of the vocabulary's words' number have it, up to QMAX characters. The too frequent grams are all that
   is sent to tasks: of each length there are at most (characters in the vocabulary) / (SHARE * words), whatever its size.
3. A word's grams are those that begin at its places. An edit at place i affects the grams that read character i and no
   others: a gram reads its own characters and, at the end of a word, the one that isn't there yet. QMIN + QMAX <= LEAST, so an
   edit never affects all of them: `affected` is the bound of each place, and the rest must be shared.
4. List merging: a near word lies on the lists of all grams that the edit doesn't affect, those before it at the same place from the
   start, those after it at the same place from the end. Merging these lists is an equality of one key, which says what
   the unaffected grams spell on both sides. A word has a key for each of its characters (replaced, or deleted by the
   partner) and one for each gap (where a longer partner has a character more); keys of characters meet keys of both kinds.
5. What meets is verified by edit distance. Lists are so short that no group's pairs grow with the corpus but by real variants:
   a key leaves open the edit and at most the few characters of the grams that it affects.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import discard, keyed_text, written

LEAST, LEAST_N, FACTOR = 7, 2, 10
QMIN, QMAX, SHARE = 2, 5, 0.02
#: A word's character is dropped where this divides the crc32 of doc_id and word.
SLIP = 31
RUN = "[A-Za-zÀ-ÿ]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def slipped(run: Column, doc_id: Column) -> Column:
    """The run without one character where SLIP divides the crc32 of `<doc_id>:<run>`; a null doc_id is written as `null`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least: int = LEAST, least_n: int = LEAST_N) -> DataFrame:
    """word, n: the words of `least` characters or more that occur `least_n` times or more.

    Words are maximal runs of letters, with A-Z in lower case and one character dropped as slipped() says. Dropping never
    lengthens a run, so shorter runs are not even taken out of the text.
    """
    runs = keyed_text(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least},}}"), 0)).alias("run"))
    words = runs.select(slipped(F.translate("run", _CAPITALS, _CAPITALS.lower()), F.col("doc_id")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, n: how often each gram of QMIN to QMAX - 1 characters, those that may grow, stands in the words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for w in batch.column(0).to_pylist():
                for q in range(QMIN, QMAX):
                    counts.update(w[p : p + q] for p in range(len(w) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["gram", "n"])

    return words.select("word").mapInArrow(of, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def too_frequent(words: DataFrame, share: float = SHARE) -> frozenset[str]:
    """The grams that grow: those that stand in the words more than share * (number of words) times."""
    most = max(1.0, share * words.count())
    return frozenset(r["gram"] for r in gram_counts(words).where(F.col("n") > most).collect())


def grams(word: str, grow: frozenset[str]) -> list[tuple[int, int]]:
    """(end, seen) of the gram at each place: it covers the characters up to `end` and depends on those up to `seen`, both exclusive."""
    n, out = len(word), []
    for p in range(n - QMIN + 1):
        end = p + QMIN
        while end - p < QMAX and end < n and word[p:end] in grow:
            end += 1
        out.append((end, end + (end == n and end - p < QMAX and word[p:end] in grow)))
    return out


def affected(word: str, grow: frozenset[str]) -> list[int]:
    """For each place i (n characters and the end) how many of the word's grams an edit there affects, at most."""
    found = grams(word, grow)
    return [sum(p <= i < seen for p, (_, seen) in enumerate(found)) for i in range(len(word) + 1)]


def merged_lists(word: str, grow: frozenset[str]) -> tuple[list[int], list[int]]:
    """Keys of the merged lists on which words within one edit are: for each character replaced or deleted, and for each gap filled.

    The grams before place i that don't depend on it spell the word's beginning up to the last of their ends; those that begin after
    the edit spell the rest of the word, or nothing where it is shorter than a gram. The place and the length of the rest are part
    of the key.
    """
    n = len(word)
    # the end up to which the grams that have seen less than each place spell the word
    spelt = [0] * (n + 2)
    for end, seen in grams(word, grow):
        spelt[seen] = max(spelt[seen], end)
    for i in range(1, n + 2):
        spelt[i] = max(spelt[i], spelt[i - 1])
    data = word.encode("utf-32-le", "surrogatepass")

    def key(i: int, rest: int) -> int:
        left = n - rest
        return xxhash.xxh3_64_intdigest(b"%d %d %b %b" % (i, left, data[: 4 * spelt[i]], data[4 * rest :] if left >= QMIN else b"")) - (1 << 63)

    return [key(i, i + 1) for i in range(n)], [key(i, i) for i in range(n + 1)]


def near_pairs(words: DataFrame, share: float = SHARE) -> DataFrame:
    """word, n, near, near_n: every two of the words (word, n; one row each) that are one edit apart, each pair once."""
    grow = too_frequent(words, share)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                lists = [merged_lists(w, grow) for w in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[k] for x in lists], pa.list_(pa.int64())) for k in (0, 1))], names=["word", "n", "edits", "gaps"])

    rows = written(words.select("word", "n").mapInArrow(of, "word string, n long, edits array<long>, gaps array<long>"), "grams")
    a = rows.select(F.explode("edits").alias("key"), "word", "n")
    b = rows.select(F.explode(F.concat("edits", "gaps")).alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    longer = F.length("word") - F.length("near")
    met = a.join(b, "key").where((longer == 1) | ((longer == 0) & (F.col("word") < F.col("near"))))
    out = written(met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct(), "near")
    discard(rows)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of forms (word, form): forms followed to the last, which has none. Each round follows twice as many steps.

    A form is at least FACTOR times as frequent as its word, so there are under 20 steps and no circles.
    """
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if known.join(step, "root", "left_semi").isEmpty():
            return known
        before, known = known, written(known.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        discard(before)


def variants(docs: DataFrame, least: int = LEAST, least_n: int = LEAST_N, factor: int = FACTOR, share: float = SHARE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    Near words differ by exactly one inserted, deleted or replaced character. A word's form is its near word of largest n, of equals the
    least in code-point order, if it is `factor` times as frequent; its root is where forms lead, the word itself without one.

    Null and empty texts have no words. A null doc_id counts as the text `null`. Repeated rows count as often as they stand there. A
    text of any length is read whole. An empty table gives no rows.
    """
    if least < QMIN + QMAX:
        raise ValueError(f"words need {QMIN + QMAX} characters at least, or an edit could affect all their grams")
    words = written(vocabulary(docs, least, least_n), "words")
    pairs = near_pairs(words, share)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    best = written(best.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "best")
    discard(pairs)
    ends = roots(best.where("form is not null").select("word", "form"))
    out = words.join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
