"""Closed-form tail probabilities and small statistics as column expressions."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


WIDE_COLUMNS = 60


class Moments(dict):
    """Moments per column, with the number of rows of the frame in `rows`."""
    rows: int = 0


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Count, mean, spread and range per column, one pass, read to the driver.

    Tables of many columns are unpivoted first: hundreds of aggregates side by side would outgrow generated code.
    """
    if len(columns) > WIDE_COLUMNS:
        return _moments_long(df, columns)
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        f.alias(f"{n}_{c}") for c in columns for n, f in (
            ("n", F.count(F.col(c))), ("mean", F.avg(F.col(c).cast("double"))),
            ("std_pop", F.stddev_pop(F.col(c).cast("double"))), ("std", F.stddev_samp(F.col(c).cast("double"))),
            ("min", F.min(F.col(c).cast("double"))), ("max", F.max(F.col(c).cast("double"))))
    ]).collect()[0]
    found = Moments({c: {n: row[f"{n}_{c}"] for n in ("n", "mean", "std_pop", "std", "min", "max")} for c in columns})
    found.rows = row["_rows"]
    return found


def _moments_long(df: DataFrame, columns: list[str]) -> Moments:
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = df.select(F.explode(pairs).alias("_p")).groupBy("_p.c").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_p.v").alias("n"), F.avg("_p.v").alias("mean"), F.stddev_pop("_p.v").alias("std_pop"),
        F.stddev_samp("_p.v").alias("std"), F.min("_p.v").alias("min"), F.max("_p.v").alias("max")).collect()
    empty = {"n": 0, "mean": None, "std_pop": None, "std": None, "min": None, "max": None}
    found = Moments({c: dict(empty) for c in columns})
    for r in rows:
        found[r["c"]] = {n: r[n] for n in empty}
        found.rows = r["rows"]
    return found


def chi2_tail_even(x: Column, df: int) -> Column:
    """P(X > x) for a chi-square with an even number of degrees of freedom: a finite sum."""
    half = x / 2
    total = F.lit(0.0)
    for k in range(df // 2):
        total = total + F.pow(half, F.lit(float(k))) / math.factorial(k)
    return F.exp(-half) * total


def bias_corrected_skew(value: Column) -> Column:
    n = F.count(value)
    return F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)


def bias_corrected_kurtosis(value: Column) -> Column:
    n = F.count(value)
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            result *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return result


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student p-value; meant for report rows, one per test."""
    return pd.Series([
        None if pd.isna(a) or pd.isna(b) else student_two_sided(float(a), float(b)) for a, b in zip(t, df)
    ], dtype="float64")


def student_quantile(level: float, df: float) -> float:
    """The t with a two-sided tail of 1 - level, by bisection."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_two_sided(mid, df) > 1 - level else (low, mid)
    return (low + high) / 2


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution: series below the mean, continued fraction above."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for n in range(1, 1000):
        step = -n * (n - a)
        b += 2.0
        d = 1.0 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def kolmogorov_tail(d: Column, n: Column, m: Column, terms: int = 40) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov distance."""
    root = F.sqrt(n * m / (n + m))
    lam = (root + 0.12 + 0.11 / root) * d
    # A fold keeps the expression small; written out, the terms would outgrow one generated method.
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, j: acc + F.when(
        j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))
