"""Column builders for rates and dispersion; undefined is null everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def defined(x: str | Column) -> Column:
    """NaN and infinities as null."""
    c = F.col(x) if isinstance(x, str) else x
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null if b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b)


def cv(x: str | Column) -> Column:
    """Population deviation over mean; null for under two values or mean 0."""
    return F.when((F.count(x) >= 2) & (F.avg(x) != 0), F.stddev_pop(x) / F.avg(x))


def iqr(x: str | Column) -> Column:
    return F.when(F.count(x) >= 2, F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25)))


def sample_std(x: str | Column) -> Column:
    return F.when(F.count(x) >= 2, F.stddev_samp(x))


def duplicate_rate(x: str | Column) -> Column:
    return F.when(F.count(x) > 0, 1 - F.count_distinct(x) / F.count(x))


def moment_skewness(x: str) -> Column:
    """Population skewness; 0 if there is no spread."""
    return F.when(F.coalesce(F.stddev_samp(x), F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce(defined(F.skewness(x)), F.lit(0.0)))


def rates(tp: str, fp: str, tn: str, fn: str) -> dict[str, Column]:
    """The rates of a confusion matrix; inside F1 a zero denominator counts as 0."""
    tp, fp, tn, fn = map(F.col, (tp, fp, tn, fn))
    nb, na = fp + tn, tp + fn
    tpr, tnr = ratio(tp, na), ratio(tn, nb)
    p0, p1 = (F.when(a + b > 0, a / (a + b)).otherwise(0.0) for a, b in ((tn, fn), (tp, fp)))
    f0, f1 = (F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0) for p, r in ((p0, tnr), (p1, tpr)))
    both = (nb > 0) & (na > 0)
    return {
        "fpr": ratio(fp, nb),
        "tpr": tpr,
        "tnr": tnr,
        "fnr": ratio(fn, na),
        "balanced_accuracy": F.when(both, (tpr + tnr) / 2),
        "precision": F.when(both, p1),
        "recall": tpr,
        "macro_f1": F.when(both, (f0 + f1) / 2),
    }
