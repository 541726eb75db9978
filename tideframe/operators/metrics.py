"""Binary scores per group in single passes: confusion, curves, thresholds, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions import ranks
from tideframe.functions.expr import Key, f_beta, f_beta_of, names, ratio
from tideframe.functions.staging import staged

COUNTS = ("tp", "fp", "fn", "tn")


def _count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def confusion(df: DataFrame, true: str, pred: Column | str, group: Key = ()) -> DataFrame:
    """tp, fp, fn, tn per group. pred: a 0/1 column, or a boolean Column such as score >= threshold."""
    p = (F.col(pred) == 1) if isinstance(pred, str) else pred
    p, t = F.coalesce(p, F.lit(False)), F.col(true) == 1
    return df.groupBy(*names(group)).agg(_count_if(t & p).alias("tp"), _count_if(~t & p).alias("fp"), _count_if(t & ~p).alias("fn"), _count_if(~t & ~p).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """n, accuracy, precision, recall, f1, f2, f1_macro, positive_rate and predicted_positive_rate beside tp, fp, fn, tn.

    Without rows all are null; a zero denominator gives 0. The macro mean is over the classes that truth or prediction have.
    """
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    n = tp + fp + fn + tn
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f_pos, f_neg = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    has_pos, has_neg = ((tp + fp + fn) > 0).cast("int"), ((tn + fp + fn) > 0).cast("int")
    some = lambda c: F.when(n > 0, c)
    return counts.select(
        "*", n.alias("n"), some((tp + tn) / n).alias("accuracy"), some(p).alias("precision"), some(r).alias("recall"), some(f_beta(p, r, 1)).alias("f1"), some(f_beta(p, r, 2)).alias("f2"),
        some((f_pos * has_pos + f_neg * has_neg) / (has_pos + has_neg)).alias("f1_macro"), some((tp + fn) / n).alias("positive_rate"), some((tp + fp) / n).alias("predicted_positive_rate"),
    )


def evaluate(df: DataFrame, true: str, score: str, threshold: float | Column = 0.5, group: Key = ()) -> DataFrame:
    return rates(confusion(df, true, F.nanvl(F.col(score).cast("double"), F.lit(None)) >= threshold, group))


def class_report(counts: DataFrame, keys: Key = ()) -> DataFrame:
    """keys, class (0, 1, macro, weighted), precision, recall, f1, support."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.cast("long").alias("support"))
    one = (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    zero = (ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fp + fn), tn + fp)
    n = one[3] + zero[3]
    macro = [(a + b) / 2 for a, b in zip(one[:3], zero[:3], strict=True)]
    weighted = [ratio(a * one[3] + b * zero[3], n) for a, b in zip(one[:3], zero[:3], strict=True)]
    return counts.select(*names(keys), F.inline(F.array(row("0", *zero), row("1", *one), row("macro", *macro, n), row("weighted", *weighted, n))))


def _curve(df: DataFrame, true: str, score: str, group: Key) -> DataFrame:
    """Per group and distinct score, from the highest down: positives and negatives so far and before, and in all."""
    g = names(group)
    rows = df.where(F.nanvl(F.col(score).cast("double"), F.lit(None)).isNotNull())
    by = rows.groupBy(*g, F.col(score).alias("s")).agg(F.count_if(F.col(true) == 1).alias("p"), F.count_if(F.col(true) != 1).alias("q"))
    rows = ranks.running(by, "s", ["p", "q"], g)
    return rows.select(*g, "s", "p", "q", (F.col("all_p") - F.col("before_p")).alias("tp"), (F.col("all_q") - F.col("before_q")).alias("fp"), F.col("all_p").alias("pos"), F.col("all_q").alias("neg"))


def roc_auc(df: DataFrame, true: str, score: str, group: Key = ()) -> DataFrame:
    """Area under the curve, ties counted half; null where a class is missing."""
    area = (F.col("tp") - F.col("p") / 2) * F.col("q")
    out = _curve(df, true, score, group).groupBy(*names(group)).agg(F.sum(area).alias("a"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    return out.select(*names(group), F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("a") / F.col("pos") / F.col("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, true: str, score: str, group: Key = ()) -> DataFrame:
    """Precision at each distinct score weighted by the recall that it adds; 0 without positives."""
    step = F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    out = _curve(df, true, score, group).groupBy(*names(group)).agg(F.sum(step).alias("a"), F.max("pos").alias("pos"))
    return out.select(*names(group), F.when(F.col("pos") > 0, F.col("a") / F.col("pos")).otherwise(0.0).alias("average_precision"))


def fit_threshold(df: DataFrame, true: str, score: str, group: Key = (), beta: float = 1.0, steps: int = 199, single: str = "half") -> DataFrame:
    """Per group the threshold, of `steps` quantiles between 1 % and 99 %, with the best F-beta; the lowest of equals.

    Where only one class occurs: 0.5 (single='half'), or the median of the scores (single='median'). All
    candidates are tried at once: each row is counted at the last candidate that it reaches, and counts are summed from above.
    """
    g = names(group)
    rows = df.select(*g, F.col(true).alias("_y"), F.nanvl(F.col(score).cast("double"), F.lit(None)).alias("_s")).where("_s is not null")
    # counted by value once: what follows reads these counts four times
    rows = staged(rows.groupBy(*g, "_s").agg(F.count_if(F.col("_y") == 1).alias("_p"), F.count(F.lit(1)).alias("_n"), F.min("_y").alias("y0"), F.max("_y").alias("y1")), "counted")
    at = [0.01 + 0.98 * i / (steps - 1) for i in range(steps)] if steps > 1 else [0.5]
    known = rows.groupBy(*g).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("_p").alias("pos"))
    candidates = ranks.same_keys(known, ranks.percentiles(rows, "_s", [*at, 0.5], g, "cs", "_n"), g)
    candidates = candidates.select(*g, "y0", "y1", "pos", F.array_distinct(F.slice("cs", 1, len(at))).alias("cs"), F.try_element_at("cs", F.lit(-1)).alias("mid"))
    both = rows.join(candidates.select(*g, "cs"), g) if g else rows.withColumn("_one", F.lit(1)).join(F.broadcast(candidates.select("cs", F.lit(1).alias("_one"))), "_one").drop("_one")
    reached = both.withColumn("c", F.size(F.filter("cs", lambda c: c <= F.col("_s"))))
    counts = reached.groupBy(*g, "c").agg(F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    tried = candidates.select(*g, "pos", F.posexplode("cs").alias("k", "threshold"))
    tried = tried.withColumn("c", F.col("k") + 1).join(counts, [*g, "c"], "left")
    above = Window.partitionBy(*g).orderBy(F.desc("c"))
    tried = tried.withColumns({"tp": F.coalesce(F.sum("p").over(above), F.lit(0)), "pp": F.coalesce(F.sum("n").over(above), F.lit(0))})
    tried = tried.withColumn("f", f_beta_of(F.col("tp"), F.col("pp"), F.col("pos"), beta))
    best = tried.groupBy(*g).agg(F.max(F.struct("f", (-F.col("threshold")).alias("low"))).alias("b"))
    out = best.join(candidates, g) if g else best.withColumn("_one", F.lit(1)).join(candidates.withColumn("_one", F.lit(1)), "_one").drop("_one")
    one = F.col("y0") == F.col("y1")
    other = F.lit(0.5) if single == "half" else F.col("mid")
    return out.select(*g, F.when(one, other).otherwise(-F.col("b.low")).alias("threshold"), F.when(one, F.lit(None)).otherwise(F.col("b.f")).alias("score"))


def operating_point(fits: dict[str, DataFrame], group: Key, fallback: float = 0.5) -> DataFrame:
    """The first of the named fits (in order) that saw both classes, else the fallback; source says which."""
    g = names(group)
    out = None
    for name, fit in fits.items():
        f = fit.select(*g, F.when(F.col("score").isNotNull(), F.col("threshold")).alias(f"_{name}"))
        out = f if out is None else out.join(f, g, "full")
    source = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in fits), F.lit("fallback"))
    return out.select(*g, F.coalesce(*(F.col(f"_{n}") for n in fits), F.lit(fallback)).alias("threshold"), source.alias("threshold_source"))


def slices(df: DataFrame, true: str, pred: Column | str, group: Key, by: Key) -> DataFrame:
    """rates() for each group in all and for each value of each `by` column, in one pass; a `by` with one value in a group is left out.

    slice: the column (or 'all'), value: its value as text.
    """
    g, b = names(group), names(by)
    p = (F.col(pred) == 1) if isinstance(pred, str) else pred
    rows = df.select(*g, *b, F.col(true).alias("_t"), F.coalesce(p, F.lit(False)).cast("int").alias("_p"))
    sets = [g, *([*g, c] for c in b)]
    t, q = F.col("_t") == 1, F.col("_p") == 1
    n = rows.groupingSets(sets, *g, *b).agg(_count_if(t & q).alias("tp"), _count_if(~t & q).alias("fp"), _count_if(t & ~q).alias("fn"), _count_if(~t & ~q).alias("tn"), *(F.grouping(c).alias(f"_g_{c}") for c in b))
    label = F.coalesce(*(F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in b), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")) for c in b), F.lit("all"))
    n = n.select(*g, label.alias("slice"), value.alias("value"), *COUNTS)
    n = n.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*g, "slice"))).where("slice = 'all' or _k > 1").drop("_k")
    return rates(n)
