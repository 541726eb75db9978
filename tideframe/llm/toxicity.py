"""Toxicity by maximum-scoring segments.

1. Token log-odds: word counts of toxic and other labelled texts, with an informative Dirichlet prior
   that is proportional to the words' total counts (a word seen rarely stays near zero; z-scores say
   how sure its log-odds are). Words with a z-score of Z or more make the lexicon; it is as large as the bounded sample makes it.
2. Every other word scores a small negative number, so that the expected score of ordinary text is
   negative. A linear-time scan (the stack method for all maximal segments) finds every segment that
   cannot be made better by lengthening or shortening it.
3. Segments are compared with chance by extreme-value statistics: in n words of ordinary text, the number
   of segments scoring S or more is about K n exp(-lambda S). lambda is the positive root of
   E[exp(lambda s)] = 1 over the words of the sample's texts that aren't toxic, K follows from how many segments
   those texts have above the median of their scores. A document's score comes from its best segment, and all
   significant ones together, on that scale, by logistic calibration.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions import ranks
from tideframe.llm.common import FIT_ROWS, discard, fold, keyed_text, labelled_sample, written

#: Weight of the Dirichlet prior as a share of the sample's words; z-score for the lexicon; score of every other word.
PRIOR, Z, OTHER = 0.03, 4.0, -0.25
#: Runs of letters with their combining marks.
WORD = regex.compile(r"[\p{L}\p{M}]+")
#: Segments expected by chance less often than this in their text are significant.
SIGNIFICANT = 0.05


def words_of(text: str | None) -> list[str]:
    """The words of a text, for fitting and for scoring."""
    return WORD.findall((text or "").lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal-scoring segments, end exclusive, in linear time.

    Neighbouring scores of one sign are one run; runs of positive score are merged leftwards on a stack as long
    as an earlier segment begins lower and ends lower on the running total.
    """
    if not (scores > 0).any():
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    up = np.concatenate([[False], scores > 0, [False]])
    starts, ends = np.flatnonzero(~up[:-1] & up[1:]), np.flatnonzero(up[:-1] & ~up[1:])
    stack: list[list[float]] = []  # start, end, total before, total after, place of the last one that begins lower
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        left, right = total[a], total[b]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = int(stack[j][4])
            if j < 0 or stack[j][3] >= right:
                stack.append([a, b, left, right, j])
                break
            a, left = int(stack[j][0]), stack[j][2]
            del stack[j:]
    return [(int(a), int(b), float(r - l)) for a, b, l, r, _ in stack]


class Detector:
    def __init__(self, lexicon: dict[str, float], decay: float, rate: float, weights: np.ndarray):
        self.lexicon, self.decay, self.rate, self.weights = lexicon, decay, rate, weights  # decay: lambda, rate: K

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of words, and (start, end, score, expected number by chance) of each maximal segment, in words."""
        words = words_of(text)
        get, other = self.lexicon.get, OTHER
        scores = np.fromiter((get(w, other) for w in words), float, len(words))
        return len(words), [(a, b, s, self.rate * max(len(words), 1) * float(np.exp(-self.decay * s))) for a, b, s in segments(scores)]

    def summary(self, text: str | None) -> list[float]:
        """Significant segments; then the inputs of the calibration: 1, evidence of the best segment, of all significant ones, their number in relation to length."""
        n, found = self.passages(text)
        evidence = [-np.log10(max(e, 1e-300)) for _, _, _, e in found]
        real = [x for x, (*_, e) in zip(evidence, found, strict=True) if e <= SIGNIFICANT]
        return [float(len(real)), 1.0, min(max(evidence, default=-3.0), 30.0) / 3, np.log1p(sum(real)), len(real) * 50 / max(n, 50)]

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and numbers of significant segments."""
        x = np.array([self.summary(t) for t in texts], float).reshape(-1, 5)
        return 1 / (1 + np.exp(-np.clip(x[:, 1:] @ self.weights, -30, 30))), x[:, 0].astype(np.int32)


def root(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum of share * exp(lambda * value) = 1; the mean must be negative and some value positive."""
    low, high = 0.0, 1.0
    at = lambda x: float((shares * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while at(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        low, high = ((low + high) / 2, high) if at((low + high) / 2) < 0 else (low, (low + high) / 2)
    return max(high, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return w


def held_out() -> Column:
    return fold(5) == 0


def log_odds(sample: DataFrame, prior: float = PRIOR) -> DataFrame:
    """word, toxic, other (documents with the word), ordinary (its occurrences in other texts), log_odds, z.

    A text's repeats of a word count once for the odds: it is texts that are labelled.
    """

    @F.pandas_udf("map<string,long>")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: dict(Counter(words_of(t))))

    words = sample.select("y", F.explode(counted("text")).alias("word", "n"))
    counts = words.groupBy("word").agg(F.sum(F.col("y")).alias("toxic"), F.sum(1 - F.col("y")).alias("other"), F.sum((1 - F.col("y")) * F.col("n")).alias("ordinary"))
    total = counts.agg(F.sum("toxic"), F.sum("other")).first()
    n1, n0 = float(total[0] or 0), float(total[1] or 0)
    alpha = F.lit(prior) * (F.col("toxic") + F.col("other"))  # the prior's words, dealt by frequency
    whole = prior * (n1 + n0)
    odds = lambda c, n: F.log((F.col(c) + alpha) / (F.lit(n + whole) - F.col(c) - alpha))
    out = counts.withColumn("log_odds", odds("toxic", n1) - odds("other", n0))
    spread = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("other") + alpha))
    return out.withColumn("z", F.col("log_odds") / spread)


def segment_rate(scores: DataFrame, decay: float, words: int) -> float:
    """K: segments at or above the median of their scores (s) in ordinary text, a word, over what exp(-lambda S) says; one segment without any.

    The median and the count are all that comes to the driver.
    """
    found = ranks.percentiles(scores, "s", [0.5]).first()
    if found is None or not found["percentiles"]:
        return 1.0 / max(words, 1)
    middle = found["percentiles"][0]
    return scores.where(F.col("s") >= middle).count() / max(words, 1) * math.exp(decay * middle)


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Detector | None:
    """A detector from at most about `bound` labelled rows outside the held-out fold; None where both labels do not occur.

    To the driver come the sample's lexicon and, for each of its rows, four numbers.
    """
    # copies of a text are one text here, or the words of one much copied toxic text would pass for toxic
    sample = written(labelled_sample(docs, labels, "toxic", ~held_out(), bound).groupBy("text").agg(F.max("y").alias("y")), "toxic-sample")
    if sample.select("y").distinct().count() < 2:
        return None
    words = written(log_odds(sample), "toxic-words")
    top = words.where((F.col("z") >= Z) & (F.col("toxic") >= 3)).select("word", "log_odds", "ordinary").orderBy("word").collect()
    lexicon = {r["word"]: float(r["log_odds"]) for r in top}
    total = int(words.agg(F.sum("ordinary")).first()[0] or 0)
    # ordinary text: the lexicon's words as often as in the other texts, all else OTHER
    shares = np.array([r["ordinary"] for r in top], float) / max(total, 1)
    shares = np.append(shares, max(1 - shares.sum(), 0.0))
    values = np.append(np.array([r["log_odds"] for r in top], float), OTHER)
    decay = root(values, shares) if shares[:-1].sum() else 1.0
    spark = docs.sparkSession
    bare = spark.sparkContext.broadcast(Detector(lexicon, decay, 1.0, np.zeros(4)))

    @F.pandas_udf("array<double>")
    def _scores(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s for *_, s, _ in bare.value.passages(t)[1]])

    ordinary = written(sample.where("y = 0").select(F.explode(_scores("text")).alias("s")), "toxic-segments")
    rate = segment_rate(ordinary, decay, total)
    model = spark.sparkContext.broadcast(Detector(lexicon, decay, rate, np.zeros(4)))

    @F.pandas_udf("array<double>")
    def _summary(texts: pd.Series) -> pd.Series:
        return texts.map(model.value.summary)

    got = sample.select("y", _summary("text").alias("x")).collect()
    discard(sample, words, ordinary)
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    return Detector(lexicon, decay, rate, logistic(x[:, 1:], y))


def classify(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages (significant toxic segments) of every row.

    Null and empty texts have no segments and get the score of a text without any. Without labels to learn
    from every score is 0. Rows never meet: repeated rows get equal scores, an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))

    @F.pandas_udf("score double, n_passages int")
    def of(texts: pd.Series) -> pd.DataFrame:
        none = np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        return pd.DataFrame(dict(zip(("score", "n_passages"), model.value.score(texts) if model.value else none, strict=True)))

    rows = keyed_text(docs).select("doc_id", held_out().alias("held_out"), of("text").alias("s"))
    return rows.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.n_passages")
