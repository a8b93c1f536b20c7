"""Aggregates with the array language's results for empty and single values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .math import NAN, _c, _d


def total(x) -> Column:
    """Sum: of integers exactly, or as a float where that overflows; 0 of nothing."""
    return F.coalesce(F.try_sum(_c(x)).cast("double"), F.sum(_d(x)), F.lit(0.0))


def total_integer(x) -> Column:
    """Sum of integers; overflow raises; 0 of nothing."""
    return F.coalesce(F.sum(_c(x).cast("bigint")), F.lit(0).cast("bigint"))


@F.pandas_udf(T.DoubleType())
def total_exact(x: pd.Series) -> float:
    """Correctly rounded float sum."""
    return math.fsum(x.dropna())


def product(x) -> Column:
    return F.coalesce(F.product(_d(x)), F.lit(1.0))


def mean(x) -> Column:
    return F.coalesce(F.avg(_d(x)), F.lit(NAN))


def variance(x) -> Column:
    """Sample variance; NaN of fewer than two values."""
    return F.when(F.count(_c(x)) > 1, F.var_samp(_d(x))).otherwise(NAN)


def sd(x) -> Column:
    return F.when(F.count(_c(x)) > 1, F.stddev_samp(_d(x))).otherwise(NAN)


def covariance(x, y) -> Column:
    return F.when(F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), 1)) > 1, F.covar_samp(_d(x), _d(y))).otherwise(NAN)


def correlation(x, y) -> Column:
    return F.when(F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), 1)) > 1, F.corr(_d(x), _d(y))).otherwise(NAN)


def maximum(x) -> Column:
    """NaN if any value is, as NaN is the largest for Spark; null of nothing."""
    return F.max(_c(x))


def minimum(x) -> Column:
    """NaN if any value is; null of nothing."""
    return F.when(F.coalesce(F.bool_or(F.isnan(_d(x))), F.lit(False)), F.lit(NAN)).otherwise(F.min(_c(x)))


def value_range(x) -> Column:
    return F.array(minimum(x), maximum(x))


def quantile(x, probabilities: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> Column:
    """Linear interpolation between order statistics (type 7), exact; NaN or no value at all raises."""
    bad = (F.count(_c(x)) == 0) | F.coalesce(F.bool_or(F.isnan(_d(x))), F.lit(False))
    return F.when(bad, F.raise_error(F.lit("quantile() needs at least one value and no NaN")).cast("array<double>")).otherwise(F.percentile(_d(x), F.array(*map(F.lit, probabilities))))


def all_true(x) -> Column:
    return F.coalesce(F.bool_and(_c(x)), F.lit(True))


def any_true(x) -> Column:
    return F.coalesce(F.bool_or(_c(x)), F.lit(False))


def which_max(x, idx) -> Column:
    """Index of the first maximum."""
    return F.max_by(_c(idx), F.struct(_c(x).alias("v"), (-_c(idx)).alias("i")))


def which_min(x, idx) -> Column:
    return F.min_by(_c(idx), F.struct(_c(x).alias("v"), _c(idx).alias("i")))


def paste(x, idx, sep: str = " ") -> Column:
    """All values as text in the order of idx: for small groups, as the result is one string."""
    rows = F.array_sort(F.collect_list(F.struct(_c(idx).alias("i"), _c(x).cast("string").alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(incomplete_beta(df / 2, np.full(len(df), 0.5), df / (df + t * t)))


def ttest_two(n1, mean1, var1, n2, mean2, var2) -> Column:
    """p-value of Welch's test from the two groups' counts, means and sample variances; too few values raise."""
    a, b = _d(var1) / _d(n1), _d(var2) / _d(n2)
    t = (_d(mean1) - _d(mean2)) / F.sqrt(a + b)
    df = (a + b) * (a + b) / (a * a / (_d(n1) - 1) + b * b / (_d(n2) - 1))
    return F.when((_c(n1) < 2) | (_c(n2) < 2), F.raise_error(F.lit("ttest() needs two values or more")).cast("double")).otherwise(_t_two_sided(t, df))


def ttest_one(n, mean_, var, mu) -> Column:
    """p-value of the one-sample test against mu."""
    t = (_d(mean_) - _d(mu)) / F.sqrt(_d(var) / _d(n))
    return F.when(_c(n) < 2, F.raise_error(F.lit("ttest() needs two values or more")).cast("double")).otherwise(_t_two_sided(t, _d(n) - 1))
