"""Column expressions and small numeric functions that the operators share.

Logarithms keep their base in their name: log10 for normalised counts, log2 before reductions, ln in
marker tests and group means.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def r6(c: Column | str) -> Column:
    """Six decimals, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def half_even(c: Column) -> Column:
    """Round to integers, halves to even."""
    return F.bround(c, 0)


def entropy_term(p: Column) -> Column:
    """-p log2 p, 0 at 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def min_max_100(value: Column, *by: str, n: Column | None = None) -> Column:
    """0 to 100 within `by`. With n, as many values belong to each: those that have no row are 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    if n is not None:
        some = F.count(value).over(w) < n
        low, high = F.when(some, F.least(low, F.lit(0.0))).otherwise(low), F.when(some, F.greatest(high, F.lit(0.0))).otherwise(high)
    return F.coalesce(F.try_divide(100 * (value - low), high - low), F.when(value.isNotNull(), 0.0))


def p_adjust(df: DataFrame, p: str, out: str, by: tuple[str, ...] = (), method: str = "holm", n: Column | None = None) -> DataFrame:
    """df with p adjusted within `by`; null p stay null and don't count.

    The number of p values comes from an aggregate joined back; ranks and running extremes are
    window functions. Without `by`, all p values of the table are one family, as many as its rows.
    """
    if method == "bonferroni":
        total = n if n is not None else F.count(p).over(Window.partitionBy(*by))
        return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * total)))
    w = Window.partitionBy(*by)
    live = F.col(p).isNotNull()
    up = w.orderBy(F.col(p).asc_nulls_last())
    df = df.withColumn("__m", F.count(p).over(w)).withColumn("__i", F.row_number().over(up))
    if method == "holm":
        step = F.max((F.col("__m") - F.col("__i") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bh":
        step = F.min(F.col("__m") / F.col("__i") * F.col(p)).over(w.orderBy(F.col(p).desc_nulls_first(), F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumn(out, F.when(live, F.least(F.lit(1.0), step))).drop("__m", "__i")


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - lead * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * h


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi squared; NaN for a NaN statistic."""
    return x if x != x else 1.0 if df <= 0 else gamma_q(df / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * h


def t_two_sided(t: float, df: float) -> float:
    return t if t != t else beta_inc(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def normal_sf_udf(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal (Spark has no error function)."""
    return z.map(lambda x: normal_sf(x) if x == x and x is not None else None)


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) for a, b in zip(x, df)])
