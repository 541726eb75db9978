"""Column expressions that several operators share. NaN becomes null on entry: Spark orders NaN above every number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Key = str | Sequence[str]


def names(keys: Key) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def over(keys: Key, order: str = "frame_index", *more: str) -> WindowSpec:
    """The one window of all ordered operators, so that Spark plans one exchange and one sort for them."""
    return Window.partitionBy(*names(keys)).orderBy(order, *more)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def number(name: str) -> Column:
    """Text or number as double; what isn't a number becomes null."""
    return finite(F.col(name).try_cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * precision * recall, b2 * precision + recall)


def f_beta_of(tp: Column, predicted: Column, positive: Column, beta: float) -> Column:
    """F-beta of counts by one division of whole numbers, so that equal values are equal doubles and ties are seen."""
    b2 = beta * beta
    return ratio((1 + b2) * tp, predicted + b2 * positive)


def prf(matched: Column, n_true: Column, n_pred: Column, prefix: str = "") -> list[Column]:
    """precision, recall, f1 and f2 to four places; 0 where there is nothing to divide by."""
    p, r = ratio(matched, n_pred), ratio(matched, n_true)
    return [F.bround(c, 4).alias(prefix + n) for n, c in (("precision", p), ("recall", r), ("f1", f_beta(p, r, 1)), ("f2", f_beta(p, r, 2)))]


def truthy(name: str) -> Column:
    """1 for true/1 in text, number or boolean, else 0."""
    return F.coalesce(F.lower(F.col(name).cast("string")).isin("1", "true", "1.0"), F.lit(False)).cast("int")


def is_label(name: str, value: str) -> Column:
    return F.coalesce(F.col(name) == value, F.lit(False)).cast("int")


def scored(label: str = "label", unscored: Sequence[str] = ("unsure",)) -> Column:
    """False only for labels that say so; a null label counts as scored."""
    return ~F.coalesce(F.col(label).isin(*unscored), F.lit(False))
