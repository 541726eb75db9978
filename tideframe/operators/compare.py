"""Configurations against each other: rankings, agreement between corpora, significance over folds, report tables.

What is grouped here is results: rows of (configuration, fold), not frames. Exact p-values of small samples come from counting
in Python on one such group at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.expr import Key, names


def window_name(size: Column, stride: Column) -> Column:
    return F.when(size.isNull(), F.lit("frames")).otherwise(F.format_string("w%d/s%d", size, stride))


def config_diff(config: Column, base: Column) -> Column:
    """Names and values in which a map differs from the base, sorted and joined; 'baseline' where none does."""
    differing = F.map_filter(config, lambda k, v: ~v.eqNullSafe(F.element_at(base, k)))
    parts = F.array_sort(F.transform(F.map_entries(differing), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.when(F.size(parts) == 0, F.lit("baseline")).otherwise(F.array_join(parts, ", "))


def ranked(df: DataFrame, score: str = "f1", keys: Key = "dataset") -> DataFrame:
    """df with place (1: best; missing scores count as 0) and best, the first of the highest."""
    w = Window.partitionBy(*names(keys)).orderBy(F.coalesce(score, F.lit(0.0)).desc(), *(c for c in df.columns if c not in (score, *names(keys))))
    return df.withColumn("place", F.row_number().over(w)).withColumn("best", F.col("place") == 1)


def margins(df: DataFrame, rules: Iterable[str], score: str = "f1", keys: Key = "dataset", model: str = "model") -> DataFrame:
    """Per key: the best learned and the best rule score and their difference in points."""
    rule = F.col(model).isin(*rules)
    out = df.groupBy(*names(keys)).agg(F.max(F.when(~rule, F.col(score))).alias("learned"), F.max(F.when(rule, F.col(score))).alias("rule"))
    return out.withColumn("margin_points", 100 * (F.col("learned") - F.col("rule")))


def matrix(df: DataFrame, row: Key, column: str, values: list[str], score: str) -> DataFrame:
    """One row a configuration, one column for each of `values` (named, so that no job has to find them)."""
    return df.groupBy(*names(row)).pivot(column, values).agg(F.first(score))


def common_folds(df: DataFrame, config: str = "config", fold: str = "fold", score: str = "score", keys: Key = ()) -> DataFrame:
    """Rows of the folds in which every configuration (of the keys) has a score."""
    k = names(keys)
    some = df.where(F.col(score).isNotNull())
    n = some.groupBy(*k).agg(F.count_distinct(config).alias("_n"))
    per = some.groupBy(*k, fold).agg(F.count_distinct(config).alias("_m"))
    whole = per.join(n, k) if k else per.withColumn("_o", F.lit(1)).join(n.withColumn("_o", F.lit(1)), "_o").drop("_o")
    return some.join(whole.where("_n = _m").select(*k, fold), [*k, fold], "left_semi")


def kendall(df: DataFrame, config: str = "config", corpus: str = "dataset", score: str = "f1") -> DataFrame:
    """corpus_a, corpus_b, n, tau (b, ties corrected), p and verdict, of corpora that share 3 configurations or more.

    p: exact for up to 33 untied pairs of scores or for almost ordered ones, else normal.
    """
    rows = df.where(F.col(score).isNotNull()).select(F.col(corpus).cast("string").alias("d"), F.col(config).alias("c"), F.col(score).cast("double").alias("s"))
    a, b = (rows.select(F.col("d").alias(f"corpus_{x}"), "c", F.col("s").alias(f"s_{x}")) for x in "ab")
    k = ["corpus_a", "corpus_b"]
    shared = a.join(b, "c").where("corpus_a < corpus_b").select(*k, "s_a", "s_b")
    counts = rank_counts(shared, "s_a", "s_b", k)

    @F.pandas_udf("double")
    def p_of(n: pd.Series, s: pd.Series, discordant: pd.Series, a1: pd.Series, a2: pd.Series, av: pd.Series, b1: pd.Series, b2: pd.Series, bv: pd.Series) -> pd.Series:
        columns = (c.tolist() for c in (n, s, discordant, a1, a2, av, b1, b2, bv))
        return pd.Series([kendall_p(n, s, d, (a1, b1), (a2, b2), (av, bv)) for n, s, d, a1, a2, av, b1, b2, bv in zip(*columns, strict=True)], dtype="float64")

    root = F.sqrt((F.col("pairs") - F.col("a1") / 2) * (F.col("pairs") - F.col("b1") / 2))
    out = counts.where("n >= 3").withColumns({"tau": F.when(root > 0, F.col("s") / root), "p": p_of("n", "s", "discordant", "a1", "a2", "av", "b1", "b2", "bv")})
    out = out.select(*k, "n", "tau", F.when(F.col("tau").isNotNull() & ~F.isnan("p"), F.col("p")).alias("p"))
    return out.withColumn("verdict", F.when(F.col("tau") > 0.4, "agree").when(F.abs("tau") <= 0.4, "unrelated").otherwise("inverted"))


def rank_counts(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """keys, n, pairs, discordant, s (concordant less discordant pairs), and of the ties of x (a) and y (b), with t rows each, the sums
    a1 of t (t - 1), a2 of t (t - 1) (t - 2), av of t (t - 1) (2 t + 5).

    Two rows are ordered differently by y at exactly one bit of its ranks, the first where these differ: so discordant pairs are counted bit by bit
    among the rows whose higher bits are equal, in the order of x. That is a row for each bit, never for each pair.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_x": F.dense_rank().over(w.orderBy(x)), "_y": F.dense_rank().over(w.orderBy(y)) - 1})
    rows = rows.withColumn("_bits", F.greatest(F.ceil(F.log2(F.max("_y").over(w) + F.lit(1.5))).cast("int"), F.lit(1)))
    by_bit = rows.select(*keys, "_x", "_y", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)).alias("_bit"))
    one = F.expr("getbit(_y, _bit)").cast("long")
    by_bit = by_bit.select(*keys, "_x", "_bit", F.expr("shiftright(_y, _bit + 1)").alias("_high"), one.alias("_one"))
    per = by_bit.groupBy(*keys, "_bit", "_high", "_x").agg(F.sum("_one").alias("ones"), F.sum(1 - F.col("_one")).alias("zeros"))
    before = Window.partitionBy(*keys, "_bit", "_high").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    discordant = per.withColumn("_d", F.col("zeros") * F.coalesce(F.sum("ones").over(before), F.lit(0))).groupBy(*keys).agg(F.sum("_d").alias("discordant"))

    def ties(by: list[str], name: str) -> DataFrame:
        t = F.col("t")
        per = rows.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("t"))
        return per.groupBy(*keys).agg(F.sum(t * (t - 1)).alias(f"{name}1"), F.sum(t * (t - 1) * (t - 2)).alias(f"{name}2"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{name}v"), F.sum("t").alias(f"n_{name}"))

    out = discordant.join(ties(["_x"], "a"), keys).join(ties(["_y"], "b"), keys).join(ties(["_x", "_y"], "c"), keys)
    n = F.col("n_a")
    pairs = (n * (n - 1) / 2).cast("long")
    s = (pairs - (F.col("a1") / 2) - (F.col("b1") / 2) + (F.col("c1") / 2)).cast("long") - 2 * F.col("discordant")
    return out.select(*keys, n.alias("n"), pairs.alias("pairs"), "discordant", s.alias("s"), "a1", "a2", "av", "b1", "b2", "bv")


def kendall_p(n: int, s: int, discordant: int, ties1: tuple, ties2: tuple, ties_v: tuple) -> float:
    """Two-sided p of the difference s of concordant and discordant pairs: exact without ties for n up to 33 or for almost ordered rows, else normal.

    The exact count of permutations by inversions goes as far as it is needed.
    """
    pairs = n * (n - 1) // 2
    c = min(discordant, pairs - discordant)
    if not any(ties1) and (n <= 33 or c <= 1):
        if 2 * c == pairs:
            return 1.0
        ways = [1]
        for i in range(2, n + 1):
            ways = [sum(ways[max(0, k - i + 1) : k + 1]) for k in range(min(c, i * (i - 1) // 2) + 1)]
        return min(1.0, 2 * float(Fraction(sum(ways), math.factorial(n))))
    (a1, b1), (a2, b2), (vt, vu) = ties1, ties2, ties_v
    var = (n * (n - 1) * (2 * n + 5) - vt - vu) / 18 + a1 * b1 / (2 * n * (n - 1)) + (a2 * b2 / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
    return math.erfc(abs(s) / math.sqrt(2 * var)) if var > 0 else math.nan


def average_ranks(df: DataFrame, by: Key, value: Column, name: str) -> DataFrame:
    """Ranks from the lowest, equal values sharing their mean, and ties: how many share it."""
    w = Window.partitionBy(*names(by))
    df = df.withColumn("_v", value)
    same = F.count(F.lit(1)).over(Window.partitionBy(*names(by), "_v"))
    return df.withColumns({name: F.rank().over(w.orderBy("_v")) + (same - 1) / 2, f"{name}_ties": same}).drop("_v")


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom > x), by the series or the continued fraction of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def friedman(df: DataFrame, config: str = "config", fold: str = "fold", score: str = "score", keys: Key = ()) -> DataFrame:
    """keys, n_folds, n_configs, chi2 (corrected for ties), p, over the folds that all configurations have."""
    k = names(keys)
    rows = average_ranks(common_folds(df, config, fold, score, k), [*k, fold], F.col(score), "r")
    per = rows.groupBy(*k, config).agg(F.sum("r").alias("R"), F.count(F.lit(1)).alias("n"))
    # each row of a tie of t adds (t^2 - 1), so a tie adds t^3 - t
    ties = rows.groupBy(*k).agg(F.sum(F.col("r_ties") * F.col("r_ties") - 1).alias("t"))
    sums = per.groupBy(*k).agg(F.sum(F.col("R") * F.col("R")).alias("ss"), F.count(F.lit(1)).alias("n_configs"), F.max("n").alias("n_folds"))
    both = sums.join(ties, k) if k else sums.withColumn("_o", F.lit(1)).join(ties.withColumn("_o", F.lit(1)), "_o").drop("_o")
    n, m = F.col("n_folds"), F.col("n_configs")
    chi2 = (12.0 / (n * m * (m + 1)) * F.col("ss") - 3 * n * (m + 1)) / (1 - F.col("t") / (n * m * (m * m - 1)))
    out = both.select(*k, "n_folds", "n_configs", chi2.alias("chi2"))

    @F.pandas_udf("double")
    def tail(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else chi2_tail(a, int(b) - 1) for a, b in zip(x, d, strict=True)], dtype="float64")

    return out.withColumn("p", tail("chi2", F.col("n_configs").cast("double")))


def signed_rank(d: list[float]) -> tuple[float, float]:
    """Wilcoxon's statistic and two-sided p of differences, zeros dropped: exact up to 50 untied ones, else normal with ties corrected."""
    n_all = len(d)
    d = [x for x in d if x]
    n = len(d)
    order = sorted(range(n), key=lambda i: abs(d[i]))
    ranks, ties, i = [0.0] * n, 0, 0
    while i < n:
        j = i
        while j + 1 < n and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for t in range(i, j + 1):
            ranks[order[t]] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    w = min(plus, n * (n + 1) / 2 - plus)
    if not n:
        return 0.0, 1.0
    if n <= 50 and not ties and n == n_all:
        ways = [1]
        for r in range(1, n + 1):
            ways = [(ways[k] if k < len(ways) else 0) + (ways[k - r] if k >= r else 0) for k in range(len(ways) + r)]
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return w, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var))


def wilcoxon_holm(df: DataFrame, config: str = "config", fold: str = "fold", score: str = "score", keys: Key = ()) -> DataFrame:
    """keys, best, other, mean_diff, p, p_holm: the configuration with the best mean against each other one, over common folds.

    Pairs that differ nowhere (by 1e-8 or more) are left out; p-values are stepped down after Holm.
    """
    k = names(keys)
    rows = common_folds(df, config, fold, score, k)
    means = rows.groupBy(*k, config).agg(F.avg(score).alias("mean"))
    w = Window.partitionBy(*k).orderBy(F.desc("mean"), config)
    best = means.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*k, F.col(config).alias("best"))
    on = lambda a, b: a.join(b, k) if k else a.withColumn("_o", F.lit(1)).join(b.withColumn("_o", F.lit(1)), "_o").drop("_o")
    top = on(rows, best).where(F.col(config) == F.col("best")).select(*k, fold, "best", F.col(score).alias("_b"))
    others = rows.join(top, [*k, fold]).where(F.col(config) != F.col("best"))
    lists = others.groupBy(*k, "best", F.col(config).alias("other")).agg(F.collect_list(F.col("_b") - F.col(score)).alias("d"), F.avg(F.col("_b") - F.col(score)).alias("mean_diff"))
    lists = lists.where(F.exists("d", lambda x: F.abs(x) > 1e-8))

    @F.pandas_udf("double")
    def p(d: pd.Series) -> pd.Series:
        return d.map(lambda x: signed_rank(list(x))[1]).astype("float64")

    tested = lists.withColumn("p", p("d")).drop("d")
    step = Window.partitionBy(*k).orderBy("p", "other")
    m = F.count(F.lit(1)).over(Window.partitionBy(*k))
    stepped = F.least(F.lit(1.0), (m - F.row_number().over(step) + 1) * F.col("p"))
    return tested.withColumn("_s", stepped).withColumn("p_holm", F.max("_s").over(step.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def shared_pairs(df: DataFrame, config: Key = ("model", "window"), corpus: str = "dataset", score: str = "f1") -> DataFrame:
    """corpus_a, corpus_b, config, both scores: configurations that two corpora share."""
    c = names(config)
    a, b = (df.select(*c, F.col(corpus).alias(f"corpus_{x}"), F.col(score).alias(f"{score}_{x}")) for x in "ab")
    cond = [a[x].eqNullSafe(b[x]) for x in c]
    both = cond[0]
    for x in cond[1:]:
        both = both & x
    return a.join(b, both & (F.col("corpus_a") < F.col("corpus_b"))).select("corpus_a", "corpus_b", *(a[x] for x in c), f"{score}_a", f"{score}_b")


def raw_and_smoothed(df: DataFrame, metrics: list[str], keys: Key = ("dataset", "model", "window"), variant: str = "variant") -> DataFrame:
    """One row a configuration with each metric raw, smoothed and the difference."""
    values = [c for m in metrics for v in ("raw", "smoothed") for c in [F.max(F.when(F.col(variant) == v, F.col(m))).alias(f"{m}_{v}")]]
    out = df.groupBy(*names(keys)).agg(*values)
    return out.withColumns({f"{m}_gain": F.col(f"{m}_smoothed") - F.col(f"{m}_raw") for m in metrics})


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(position).alias(position)).orderBy(position)
