"""Mixing domains to target weights with soft membership, in DataFrame and SQL functions only.

1. A labelled table says the domain of some documents. A naive Bayes classifier is fitted on a bounded
   sample of it: words hashed into SLOTS slots, counted by domain and slot, smoothed; domains x slots
   numbers come to the driver.
2. Every document gets posteriors over the domains, by a fold over its words (log-odds looked up by
   slot, divided by a temperature, as words of a text are not independent), and its number of words as tokens.
3. Nonnegative rates, one a document, are fitted so that expected domain totals, the sum of
   rate x tokens x posterior, match the targets: projected gradient on the squared misses, which are
   divided by each domain's own total. An iteration is one aggregation over the compact table of
   (tokens, posteriors): the rates themselves are never stored, as a document's rate follows from its
   posteriors and the misses of the iterations before, a few numbers each that go into the next plan.
   A step moves a rate by the posterior-weighted misses whatever the document's length, which is the
   gradient in the inner product weighted by tokens; projection (rate >= 0) is the same there.
4. A document is taken floor(rate) times, and once more if a hash of its doc_id lies below the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import FIT_ROWS, discard, drawn, written

#: Columns that are added to the documents' own, whatever those are called.
TOKENS, P, _WORK = "__mixing_tokens", "__mixing_p", "__mixing_work"
SLOTS, TEMPERATURE, STEPS, CLOSE = 4096, 10.0, 40, 1e-3


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _slot(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(SLOTS))


def classifier(labelled: DataFrame, bound: int = FIT_ROWS, slots: int = SLOTS) -> tuple[list[str], list[list[float]], list[float]]:
    """Domains, log shares by slot and domain, log priors, from at most about `bound` rows of labelled (doc_id, text, domain).

    Rows without a domain label nothing. The rows are those with the lowest hash of their doc_id.
    """
    known = drawn(labelled.where(F.col("domain").isNotNull()), bound, 23)
    priors = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    counts = known.select("domain", F.explode(_words(F.col("text"))).alias("w")).groupBy("domain", _slot(F.col("w")).alias("slot")).count().collect()
    domains = sorted(priors)
    place = {d: k for k, d in enumerate(domains)}
    table = [[0.5] * len(domains) for _ in range(slots)]
    for r in counts:
        table[r["slot"]][place[r["domain"]]] += r["count"]
    totals = [sum(row[k] for row in table) for k in range(len(domains))]
    logs = [[math.log(c / t) for c, t in zip(row, totals, strict=True)] for row in table]
    return domains, logs, [math.log(priors[d] / sum(priors.values())) for d in domains]


def posteriors(docs: DataFrame, model: tuple[list[str], list[list[float]], list[float]], temperature: float = TEMPERATURE) -> DataFrame:
    """docs with TOKENS (words of the whole text) and P (posteriors in the order of the domains) of every row.

    A text without words has 0 tokens and the priors. Only differences between domains matter, so the first
    domain's column is the zero of the others.
    """
    domains, logs, priors = model
    rest = range(1, len(domains))
    # one array of slots for each further domain; SLOTS x domains numbers in the plan, whatever the data
    odds = {k: F.array(*(F.lit(row[k] - row[0]) for row in logs)) for k in rest}
    rows = docs.withColumn(_WORK, F.transform(_words(F.col("text")), _slot)).withColumn(TOKENS, F.size(_WORK).cast("long"))
    add = lambda k: F.aggregate(_WORK, F.lit(0.0), lambda acc, s: acc + F.get(odds[k], s)) / temperature + F.lit(priors[k] - priors[0])
    rows = rows.withColumn(_WORK, F.array(F.lit(0.0), *(add(k) for k in rest)))
    rows = rows.withColumn(_WORK, F.transform(_WORK, lambda x: F.exp(F.greatest(x - F.array_max(_WORK), F.lit(-60.0)))))
    return rows.withColumn(P, F.transform(_WORK, lambda x: x / F.aggregate(_WORK, F.lit(0.0), lambda a, b: a + b))).drop(_WORK)


def _rate(steps: list[list[float]], k: int) -> Column:
    """The rate after the steps (a row of moves by domain for each iteration), from p."""
    rate: Column = F.lit(1.0)
    if not steps:
        return rate
    history = F.array(*(F.array(*(F.lit(x) for x in s)) for s in steps))
    move = lambda s: sum((F.get(s, i) * F.get(P, i) for i in range(1, k)), F.get(s, 0) * F.get(P, 0))
    return F.aggregate(history, rate, lambda r, s: F.greatest(F.lit(0.0), r + move(s)))


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS, close: float = CLOSE) -> list[list[float]]:
    """Moves by domain for each iteration. targets: wanted expected tokens of each domain; members: TOKENS, P, written.

    A domain without a single expected token cannot be reached and is left out of the misses.
    """
    k = len(targets)
    totals = lambda rate: members.select(rate.alias(_WORK), TOKENS, P).agg(*(F.sum(F.col(_WORK) * F.col(TOKENS) * F.get(P, i)).alias(f"t{i}") for i in range(k))).first()
    own = [x or 0.0 for x in totals(F.lit(1.0))]
    moves: list[list[float]] = []
    got = own
    while len(moves) < steps:
        miss = [(t - g) / o if o > 0 else 0.0 for t, g, o in zip(targets, got, own, strict=True)]
        if max(abs(m) * o / max(t, 1.0) if o > 0 else 0.0 for m, o, t in zip(miss, own, targets, strict=True)) < close:
            break
        # a step of 1: the matrix of the misses, own totals divided out, has no eigenvalue over 1
        moves.append(miss)
        got = [x or 0.0 for x in totals(_rate(moves, k))]
    return moves


def _fitted(docs: DataFrame, model: tuple, weights: dict[str, float] | None, tokens: float | None) -> tuple[DataFrame, list[list[float]]]:
    """doc_id, TOKENS, P of every row, written, and the moves."""
    domains = model[0]
    weights = {d: w for d, w in (weights or {}).items() if d in domains and w > 0} or dict.fromkeys(domains, 1.0)
    shares = [weights.get(d, 0.0) / sum(weights.values()) for d in domains]
    members = written(posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text"), "members")
    own = members.agg(*(F.sum(F.col(TOKENS) * F.get(P, i)).alias(str(i)) for i in range(len(domains)))).first()
    tokens = tokens or max((o or 0.0) / w for o, w in zip(own, shares, strict=True) if w)
    return members, fit_rates(members, [tokens * w for w in shares])


def _copies(rate: Column) -> Column:
    hashed = F.pmod(F.xxhash64(F.lit(29), F.col("doc_id").cast("long")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (hashed < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, tokens: float | None = None, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, domain (likeliest), tokens, p, rate, copies (times to take the document) of every row.

    labelled: doc_id, text, domain. weights: share wanted of each domain, brought to a sum of 1 over the domains that
    are labelled (equal without); tokens: expected tokens wanted in all. Without it: as many as the
    scarcest domain allows if nothing is to be thinned out, so that targets are met by repeating. Null text has no tokens and takes a rate all the same. Rows that
    repeat a doc_id get equal copies of equal rates. Without labelled rows every rate is 1, domain and p are null. An empty table gives no rows.
    """
    model = classifier(labelled.select("doc_id", "text", F.col("domain").cast("string").alias("domain")), bound)
    domains = model[0]
    if not domains:
        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("domain"), F.size(_words(F.col("text"))).cast("long").alias("tokens"), F.lit(None).cast("array<double>").alias("p"), F.lit(1.0).alias("rate"))
        return one.select("*", _copies(F.col("rate")).alias("copies"))
    members, moves = _fitted(docs, model, weights, tokens)
    likeliest = F.get(F.array(*(F.lit(d) for d in domains)), (F.array_position(P, F.array_max(P)) - 1).cast("int"))
    rows = members.select("doc_id", likeliest.alias("domain"), F.col(TOKENS).alias("tokens"), F.col(P).alias("p"), _rate(moves, len(domains)).alias("rate"))
    return rows.select("*", _copies(F.col("rate")).alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, tokens: float | None = None, bound: int = FIT_ROWS) -> DataFrame:
    """docs with each row as often as `copies` of mix() says, with all their columns. Rows without doc_id are taken once.

    A row's copies follow from its own text and the fitted moves, so texts are neither shuffled nor joined. A row whose
    rate is under 1 may be left out. Without labelled rows docs stay as they are; an empty table gives no rows.
    """
    model = classifier(labelled.select("doc_id", "text", F.col("domain").cast("string").alias("domain")), bound)
    if not model[0]:
        return docs
    members, moves = _fitted(docs, model, weights, tokens)
    discard(members)
    rows = posteriors(docs, model).withColumn(_WORK, _rate(moves, len(model[0])))
    times = F.when(F.col("doc_id").isNull(), 1).otherwise(_copies(F.col(_WORK)))
    # an element for each copy; none for a row without copies, which explode leaves out
    rows = rows.withColumn(_WORK, F.explode(F.array_repeat(F.lit(0), times)))
    return rows.select(*docs.columns)
