"""Exact tests and resampling on small groups of per-seed values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binomial_upper_tail(k: str | Column, n: str | Column) -> Column:
    """P(X >= k) of n fair coins, as one expression: a running product of binomial coefficients."""
    k, n = (F.col(x) if isinstance(x, str) else x for x in (k, n))
    step = lambda acc, i: F.struct(
        (acc["c"] * (n - i + 1) / i).alias("c"), (acc["s"] + F.when(i >= k, acc["c"] * (n - i + 1) / i).otherwise(0.0)).alias("s")
    )
    start = F.struct(F.lit(1.0).alias("c"), F.when(k <= 0, 1.0).otherwise(0.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))), start, step)["s"]
    return F.when(n > 0, F.least(F.lit(1.0), total / F.pow(F.lit(2.0), n)))


def sign_flip_column(values: str) -> Column:
    """Two-sided sign-flip p of a short array (12 values at most) by enumerating all signs."""
    v = F.col(values)
    n = F.size(v)
    observed = F.abs(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)) / n
    masks = F.sequence(F.lit(0), F.shiftleft(F.lit(1), 12) - 1)
    signed = lambda m: F.abs(
        F.aggregate(F.zip_with(v, F.sequence(F.lit(0), n - 1), lambda x, i: x * F.when(F.getbit(m, i) == 1, 1.0).otherwise(-1.0)), F.lit(0.0), lambda a, x: a + x)
    )
    used = F.filter(masks, lambda m: m < F.pow(F.lit(2.0), n))
    extreme = F.size(F.filter(used, lambda m: signed(m) >= n * (observed - 1e-15)))
    return F.when(n == 0, None).when(observed <= 1e-15, 1.0).otherwise(extreme / F.pow(F.lit(2.0), n))


def sign_flip_p(values: np.ndarray) -> float | None:
    """The same for up to 20 values, from the sums of two halves."""
    v = np.asarray(values, float)
    v = v[np.isfinite(v)]
    if not len(v):
        return None
    if len(v) > 20:
        raise ValueError("at most 20 values")
    observed = abs(v.mean())
    if observed <= 1e-15:
        return 1.0

    def sums(part: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for x in part:
            out = np.concatenate([out - x, out + x])
        return out

    half = len(v) // 2
    left, right = sums(v[:half]), np.sort(sums(v[half:]))
    limit = len(v) * (observed - 1e-15)
    outside = np.searchsorted(right, -limit - left, "right") + len(right) - np.searchsorted(right, limit - left, "left")
    return float(outside.sum() / 2 ** len(v))


def bootstrap_interval(values: np.ndarray, resamples: int, level: float, seed: int) -> tuple[float | None, float | None, float | None]:
    """(mean, low, high): percentile interval of resampled means; no interval for under two values."""
    v = np.asarray(values, float)
    v = v[np.isfinite(v)]
    if len(v) < 2:
        return (float(v.mean()) if len(v) else None), None, None
    rng = np.random.default_rng(seed)
    means = np.array([rng.choice(v, size=len(v), replace=True).mean() for _ in range(resamples)])
    tail = (1 - level) / 2 * 100
    low, high = np.percentile(means, [tail, 100 - tail])
    return float(v.mean()), float(low), float(high)


def with_resampling(df: DataFrame, keys: list[str], values: str, resamples: int, level: float, seed: int) -> DataFrame:
    """df (keys, values array) plus mean, ci_low, ci_high and permutation_p; one bootstrap per distinct array."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, values).schema]) + ", mean double, ci_low double, ci_high double, permutation_p double"

    def run(batches):
        memo: dict[tuple, tuple] = {}
        for pdf in batches:
            out = []
            for v in pdf[values]:
                key = tuple(v)
                if key not in memo:
                    memo[key] = (*bootstrap_interval(np.array(key), resamples, level, seed), sign_flip_p(np.array(key)))
                out.append(memo[key])
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["mean", "ci_low", "ci_high", "permutation_p"], dtype=float)], axis=1)

    return df.select(*keys, values).mapInPandas(run, schema)


def holm(df: DataFrame, keys: list[str], p: str, name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within keys."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_rank", F.row_number().over(w.orderBy(p))).withColumn("_m", F.count("*").over(w))
    adjusted = F.max(F.col(p) * (F.col("_m") - F.col("_rank") + 1)).over(w.orderBy(p, "_rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(name, F.least(F.lit(1.0), adjusted)).drop("_rank", "_m")
