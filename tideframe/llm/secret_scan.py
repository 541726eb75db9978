"""Secrets in texts: fixed patterns, and values in a credential context by what guessing them would cost.

A value that follows a credential word (also ones the patterns lack) is split into the cheapest
sequence of parts by dynamic programming, as password strength meters do: a part is a known word
(cost: its rank, and capitals or look-alike digits), a date, a repeat of a shorter part, a walk over
neighbouring keys, a sequence of characters, or brute force. Values whose cheapest sequence takes 10^GUESSES
guesses or more are spans of kind `guess`. Known words are a few frequent passwords and, ranked behind them, the pieces of
a public tokenizer file in its order, which is that of their frequency in a large corpus.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import keyed_text
from tideframe.llm.tokens import path_of

#: Values whose cheapest guess costs 10 to this power or more are secrets.
GUESSES = 10.0
#: A part that repeats has at most so many characters, so that a value's cost is found in time linear in its length.
REPEATED = 64
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: The context of a guessed value: a credential word and a separator (`Bearer` of a header needs none). The value runs to its closing quote on
#: the same line (a backslash takes the next character along), or else to the next white space, whatever its characters.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer)"""
    r"""(?:["'`]?\x20*(?:=>|:=|[:=]|\x20is\x20)\x20*|(?<=bearer)\x20+)(?:(["'`])((?:\\.|(?!\1)[^\\\r\n])+)\1|(\S+))""",
    re.I,
)
#: What an unquoted value doesn't end with.
_AFTER = ".,;:!?)]}\"'`"
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
# Frequent words in passwords, most frequent first.
WORDS = (
    "password 123456 qwerty admin welcome login monkey dragon letmein master football baseball shadow michael superman batman "
    "trustno sunshine iloveyou princess starwars hello freedom whatever secret test user root guest default changeme example "
    "pass token key api abc access server database summer winter spring autumn love money computer internet jordan hunter harley "
    "ranger buster soccer hockey george charlie andrew thomas robert daniel jessica pepper ginger cookie cheese coffee orange "
    "banana purple silver golden black white green blue red system service account private public temp demo sample none null "
    "true false value your here string placeholder redacted hidden the and for with that this from have not you are was"
).split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@310$57!", "aaeiosst" + "i")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d")

_PLACE = {c: (x, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}


@functools.cache
def _ranks() -> dict[str, int]:
    """WORDS, then the pieces of ASCII letters of a tokenizer file in its order, frequent ones first: words and their beginnings and endings."""
    with open(path_of("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = (w.removeprefix("\u0120").lower() for w in sorted(vocab, key=vocab.get))
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *(w for w in pieces if len(w) >= 3 and w.isascii() and w.isalpha())]))}


@functools.cache
def _longest() -> int:
    return max(map(len, _ranks()))


def _character_guesses(text: str) -> float:
    """log10 of the guesses for one character by brute force: the size of the classes that the value uses; beyond ASCII a class is 128 code points."""
    size = 26 * bool(re.search("[a-z]", text)) + 26 * bool(re.search("[A-Z]", text)) + 10 * bool(re.search("[0-9]", text)) + 33 * bool(re.search("[\x00-\x7f](?<![a-zA-Z0-9])", text))
    beyond = {ord(c) >> 7 for c in set(text) if c > "\x7f"}
    return math.log10(max(size + 128 * len(beyond), 10))


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _parts(text: str) -> Iterable[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every part other than brute force."""
    n, low = len(text), text.lower()
    plain = low.translate(LEET)
    ranks, longest = _ranks(), _longest()
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                twists = 2 * (low[i:j] != text[i:j]) + 4 * (low[i:j] not in ranks)
                yield i, j, math.log10(rank * max(1, twists) + 1)
    for m in DATE.finditer(text):
        yield m.start(), m.end(), math.log10(365 * 120) if m.end() - m.start() > 4 else math.log10(120)
    for name, follows in (("walk", lambda a, b: _near(a, b)), ("up", lambda a, b: ord(b) - ord(a) == 1), ("down", lambda a, b: ord(a) - ord(b) == 1), ("same", lambda a, b: a == b)):
        i = 0
        while i < n - 1:
            j = i
            while j < n - 1 and follows(low[j], low[j + 1]):
                j += 1
            if j - i >= 2:
                yield i, j + 1, math.log10((47 if name == "walk" else 26) * (j - i + 1)) + (0.35 * (j - i) if name == "walk" else 0)
            i = max(j, i + 1)
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for size in range(2, min(n // 2, REPEATED) + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], letters[size:] == letters[:-size], [False]]).astype(np.int8)))
        done = 0
        for start, end in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1)[:, 0] >= size].tolist():
            i = max(start, done)
            if end - i >= size:
                done = i + size * (1 + (end - i) // size)
                yield i, done, size * _character_guesses(text[i : i + size]) + math.log10((done - i) / size)


def guess_cost(text: str) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for an empty value."""
    each, n = _character_guesses(text), len(text)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in _parts(text):
        ending[j].append((i, cost))
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        best[j] = min([best[j - 1] + each, *(best[i] + cost for i, cost in ending[j])])
    return best[n]


def spans(text: str, guesses: float = GUESSES) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    found, low = [], text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in _CONTEXT_WORDS):
        for m in CONTEXT.finditer(text):
            value = m[2] or m[3].rstrip(_AFTER).lstrip("\"'`")
            start = m.start(2) if m[2] else text.index(value, m.start(3))
            if len(value) >= 6 and guess_cost(value) >= guesses:
                found.append((start, 3, start + len(value)))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def scan(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans for every row; null text counts as empty.

    Texts are scanned whole, one at a time, whatever their length; rows never meet, so repeated rows
    give repeated results and an empty table none.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_guess long, base string, spans string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            got = spans(text, guesses)
            say = lambda some: ",".join(f"{k}:{a}:{b}" for a, k, b in some)
            rows.append((*(sum(k == kind for _, k, _ in got) for kind in KINDS), say([x for x in got if x[1] != "guess"]), say(got)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess", "base", "spans"])

    rows = keyed_text(docs).select("doc_id", of("text").alias("s"))
    return rows.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.n_guess", F.sha2(F.col("s.base"), 256).alias("base_sha256"), "s.spans")


def redact(docs: DataFrame, guesses: float = GUESSES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by `mask` (overlapping ones by one) and n_chars, if there, counted anew; null stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        def clean(text):
            if text is None:
                return None
            out, at = [], 0
            for a, _, b in spans(text, guesses):
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join(out) + text[at:]

        return texts.map(clean)

    out = docs.withColumn("text", of("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
