"""Quality rules: gradient-boosted trees over document statistics, with monotone constraints.

Statistics come from whole texts, in vectorised passes over each text's words. The trees are grown in
numpy on a bounded sample of labelled rows (features only reach the driver), on binned values; a split
is refused where it would let the score rise with a statistic that must not raise it, and the bound
of a split holds in all that grows below. Fitted trees are flattened into node arrays (feature, threshold, left,
right, value) in which every row of a batch walks down all trees at once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import FIT_ROWS, keyed_text, labelled_sample

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "sign_share", "sentence_share", "top_word_share", "bar_share"]
#: -1: the chance of good quality must not rise with the statistic; 1: must not fall.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "top_word_share": -1, "upper_share": -1, "bar_share": -1}
#: A document is rejected by the trees where the chance of good quality is under this.
KEEP = 0.35
_SPACES, _SYMBOLS, _BLANK = " \t\n\x0b\x0c\r", "#*$%&|<>", " \t\n\x0b\x0c\r"
_UPPER, _DIGIT, _SIGN = re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[0-9]+"), re.compile(r"[!-/:-@\[-`{-~]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _count(pattern: re.Pattern, text: str) -> int:
    return len("".join(pattern.findall(text)))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each window of `size` words, from the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ words[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """BASE and FEATURES of a text. Words are runs of anything but the six ASCII white-space characters."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    dup = len(lines) - len(set(lines))
    hashes = word_hashes(words)
    windows = window_hashes(hashes, 5)
    repeated = 0
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            again = np.zeros(n + 1, np.int64)
            at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            np.add.at(again, at, 1)
            np.add.at(again, at + 5, -1)
            repeated = int((np.cumsum(again)[:n] > 0).sum())
    counts = np.unique(hashes, return_counts=True)[1] if n else np.ones(1)
    m, c = max(n, 1), max(chars, 1)
    ends = text.count(".") + text.count("!") + text.count("?")
    features = [
        np.log1p(n), chars / m, symbols / c, dup / max(len(lines), 1), repeated / m, len(counts) / m if n else 0.0,
        _count(_UPPER, text) / c, _count(_DIGIT, text) / c, _count(_SIGN, text) / c, min(ends / m, 1.0), counts.max() / m if n else 0.0, text.count("|") / m,
    ]
    return [n, chars, symbols, dup, repeated], features


class Trees:
    """Boosted trees for a probability, as flat node arrays; leaves point to themselves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.depth = base, feature, threshold, left, right, value, roots, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, bins: int = 64, least: int = 8) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins, level by level."""
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    base = float(np.log(mean / (1 - mean)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots, margin = [], np.full(len(y), base)

    def add(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        weight = lambda i: -g[i].sum() / (h[i].sum() + ridge)  # noqa: B023, E731
        root = add(0.0)
        roots.append(root)
        level = [(root, np.arange(len(y)), -np.inf, np.inf)]
        for deep in range(depth + 1):
            following = []
            for k, rows, lo, hi in level:
                value = float(np.clip(weight(rows), lo, hi))
                nodes["value"][k] = rate * value
                best = (1e-6, None)
                if deep < depth and len(rows) >= 2 * least:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j in range(d):
                        b, m = binned[rows, j], len(edges[j]) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g[rows], h[rows], None))
                        if not len(gl):
                            continue
                        wl, wr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(gs - gl) / (hs - hl + ridge), lo, hi)
                        gain = -(gl * wl + (hl + ridge) * wl * wl / 2) - ((gs - gl) * wr + (hs - hl + ridge) * wr * wr / 2) + gs * value + (hs + ridge) * value * value / 2
                        gain[(nl < least) | (len(rows) - nl < least) | (monotone[j] * (wr - wl) < 0)] = -np.inf
                        c = int(np.argmax(gain))
                        if gain[c] > best[0]:
                            best = (gain[c], (j, c, wl[c], wr[c]))
                if best[1] is None:
                    margin[rows] += rate * value
                    continue
                j, c, wl, wr = best[1]
                mid = (wl + wr) / 2
                goes = binned[rows, j] <= c
                left, right = add(0.0), add(0.0)
                nodes["feature"][k], nodes["threshold"][k], nodes["left"][k], nodes["right"][k] = j, float(edges[j][c]), left, right
                below, above = ((lo, mid), (mid, hi)) if monotone[j] > 0 else ((mid, hi), (lo, mid)) if monotone[j] < 0 else ((lo, hi), (lo, hi))
                following += [(left, rows[goes], *below), (right, rows[~goes], *above)]
            level = following
    arrays = {k: np.array(v, np.float64 if k in ("threshold", "value") else np.int32) for k, v in nodes.items()}
    # inner nodes carry the value they would have as leaves; only leaves are ever read
    return Trees(base, **arrays, roots=np.array(roots, np.int32), depth=depth)


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, bound: int = FIT_ROWS) -> Trees | None:
    """Trees from at most about `bound` rows with a quality label; None where both labels do not occur."""

    @F.pandas_udf("array<double>")
    def _features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(v) for v in statistics(t)[1]])

    rows = labelled_sample(docs, labels, "quality", F.lit(True) if trainable is None else trainable, bound)
    got = rows.select("y", _features("text").alias("x")).collect()  # `bound` rows of numbers
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        return None
    return grow(np.array([r["x"] for r in got]), y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def verdict(spark, trees: Trees | None, keep: float = KEEP):
    """A Pandas UDF: text -> BASE, base_failed, score, kept. Without trees the base rules alone decide."""
    model = spark.sparkContext.broadcast(trees)

    @F.pandas_udf(", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        base, features = zip(*map(statistics, texts), strict=True) if len(texts) else ((), ())
        out = pd.DataFrame(np.array(base, np.int64).reshape(-1, len(BASE)), columns=BASE)
        out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
        x = np.array(features, float).reshape(-1, len(FEATURES))
        out["score"] = model.value.score(x) if model.value is not None else np.where(out["base_failed"], 0.0, 1.0)
        out["kept"] = ~out["base_failed"] & (out["score"] >= keep)
        return out

    return of


def judge(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, BASE, base_failed, score, kept of every row.

    Null or empty text has no words and fails the base rules. Repeated rows are judged each on their
    own; an empty table gives no rows.
    """
    of = verdict(docs.sparkSession, fit(docs, labels, bound=bound))
    return keyed_text(docs).select("doc_id", of("text").alias("v")).select("doc_id", "v.*")


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    of = verdict(docs.sparkSession, fit(docs, labels, bound=bound))
    return docs.where(of("text")["kept"])
