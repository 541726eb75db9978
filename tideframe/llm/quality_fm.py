"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a document: the share of each hashed word (BITS bits), structure statistics and metadata of
the text itself (its length, letters outside ASCII). All pairs of inputs interact through vectors of
RANK numbers, scored in linear time: sum over the ranks of ((sum v x)^2 - sum (v x)^2) / 2. It is fitted by
Adam on a bounded sample of labelled rows whose inputs (not texts) reach the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import discard, drawn, fold, keyed_text, labelled_sample, written

BITS, RANK, EPOCHS = 14, 4, 60
#: Upper bounds on the labelled rows of a fit, and on their words' inputs in all (12 bytes each), which meet in the driver.
ROWS, INPUTS = 6_000, 6_000_000
STRUCTURE = ["bias_words", "mean_word", "distinct", "top_word", "upper", "digit", "sign", "symbol", "dup_lines", "repeat_next", "line_words", "beyond_ascii"]
_UPPER, _DIGIT, _SIGN, _BEYOND = re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[0-9]+"), re.compile(r"[!-/:-@\[-`{-~]+"), re.compile("[^\x00-\x7f]+")


def _share(pattern: re.Pattern, text: str) -> float:
    return len("".join(pattern.findall(text))) / max(len(text), 1)


def inputs(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words that occur, their shares times 10 (so that word and structure inputs are of one size), structure statistics."""
    text = text or ""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words)
    slot, count = np.unique((hashes & np.uint64((1 << BITS) - 1)).astype(np.int32), return_counts=True)
    most = np.unique(hashes, return_counts=True)[1] if n else np.zeros(0)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(n, 1)
    structure = [
        np.log1p(n) / 5, min(len(text) / m, 40) / 8, len(most) / m, most.max() / m if n else 0.0,
        _share(_UPPER, text) * 3, _share(_DIGIT, text) * 10, _share(_SIGN, text) * 5, sum(map(text.count, "#*$%&|<>")) / max(len(text), 1) * 10,
        1 - len(set(lines)) / max(len(lines), 1), float((hashes[1:] == hashes[:-1]).sum()) / m, min(m / max(len(lines), 1), 100) / 40, _share(_BEYOND, text) * 5,
    ]
    return slot, (10 * count / m).astype(np.float32), structure


class FactorisationMachine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale

    def rows(self, got: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the inputs; structure statistics are standardised and follow the words."""
        sizes = [len(s) for s, _, _ in got]
        k = len(self.mean)
        x = np.clip((np.array([s for _, _, s in got], np.float64).reshape(-1, k) - self.mean) / self.scale, -4, 4)
        row = np.concatenate([np.repeat(np.arange(len(got)), sizes), np.repeat(np.arange(len(got)), k)])
        column = np.concatenate([*(s for s, _, _ in got), np.tile((1 << BITS) + np.arange(k), len(got))]).astype(np.int64)
        value = np.concatenate([*(v for _, v, _ in got), x.ravel()])
        return row, column, value

    def margin(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row the margin and, for gradients, the sums of v x by rank."""
        out, sums = self.w0 + np.bincount(row, self.w[column] * value, n), np.empty((self.v.shape[1], n))
        for r in range(self.v.shape[1]):
            vx = self.v[column, r] * value
            sums[r] = np.bincount(row, vx, n)
            out += (sums[r] ** 2 - np.bincount(row, vx * vx, n)) / 2
        return out, sums

    def score(self, texts) -> np.ndarray:
        got = [inputs(t) for t in texts]
        if not got:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.rows(got), len(got))[0], -30, 30)))


def fit_machine(got: list[tuple], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, ridge: float = 2e-4, seed: int = 1) -> FactorisationMachine:
    rng, k = np.random.default_rng(seed), len(STRUCTURE)
    x = np.array([s for _, _, s in got], np.float64)
    width = (1 << BITS) + k
    fm = FactorisationMachine(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(width), rng.normal(0, 0.02, (width, RANK)), x.mean(0), x.std(0) + 1e-3)
    row, column, value = fm.rows(got)
    n = len(got)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5  # towards balance, not all the way
    weight /= weight.sum()
    params = [np.array([fm.w0]), fm.w, fm.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        fm.w0 = float(params[0][0])
        margin, sums = fm.margin(row, column, value, n)
        e = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight
        ev = e[row] * value
        grads = [np.array([e.sum()]), np.bincount(column, ev, width) + ridge * fm.w, np.empty_like(fm.v)]
        square = np.bincount(column, ev * value, width)
        for r in range(RANK):
            grads[2][:, r] = np.bincount(column, ev * sums[r][row], width) - fm.v[:, r] * square + ridge * fm.v[:, r]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    fm.w0 = float(params[0][0])
    return fm


def held_out() -> Column:
    return fold(3) == 1


def fit(docs: DataFrame, labels: DataFrame, bound: int = ROWS) -> FactorisationMachine | None:
    """A machine from at most about `bound` labelled rows outside the held-out fold; None where both labels do not occur.

    Where these rows have more than INPUTS inputs of words, as very long texts may, as many rows as have about so many are taken.
    """

    @F.pandas_udf("slots array<int>, shares array<float>, structure array<double>")
    def _inputs(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([inputs(t) for t in texts], columns=["slots", "shares", "structure"])

    sample = written(labelled_sample(docs, labels, "quality", ~held_out(), bound).select("doc_id", "y", _inputs("text").alias("x")), "machine-inputs")
    n, inputs_ = sample.agg(F.count(F.lit(1)), F.sum(F.size("x.slots"))).first()
    if (inputs_ or 0) > INPUTS:
        sample = drawn(sample, int(n * INPUTS / inputs_), 19)
    rows = sample.select("y", "x").toArrow()
    discard(sample)
    y = rows.column("y").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    x = rows.column("x").combine_chunks()
    slots, shares, structure = (x.field(f).to_pylist() for f in ("slots", "shares", "structure"))
    got = [(np.array(a, np.int32), np.array(b, np.float32), c) for a, b, c in zip(slots, shares, structure, strict=True)]
    return fit_machine(got, y)


def classify(docs: DataFrame, labels: DataFrame, bound: int = ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts are scored as texts without words. Without labels to learn from every score is
    0.5. Rows never meet: repeated rows get equal scores, an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model.value is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(np.concatenate([np.zeros(0), *(model.value.score(texts[k : k + 256]) for k in range(0, len(texts), 256))]))

    rows = keyed_text(docs).select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
