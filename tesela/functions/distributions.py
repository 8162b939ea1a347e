"""Tail probabilities as Arrow functions, and the special functions behind them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: chi-square value with one degree of freedom that 5 % exceed.
CHI2_95 = 3.841458820694124


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    log_scale = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(2000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * math.exp(log_scale))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        c = b + an / c
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        step = d * (c if abs(c) > 1e-300 else 1e-300)
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, h * math.exp(log_scale))


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + k * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + k / c
        c = c if abs(c) > 1e-300 else 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1) / a


def chi2_tail(x: float, df: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2)) if df == 1 else _gamma_q(df / 2, x / 2)


def f_tail(f: float, d1: float, d2: float) -> float:
    return _beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """One-sided Fisher test: P(cell >= a) with the margins fixed."""
    row, col, n = a + b, a + c, a + b + c + d

    def log_p(k: int) -> float:
        return (
            math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1) + math.lgamma(n - row + 1)
            - math.lgamma(col - k + 1) - math.lgamma(n - row - col + k + 1)
            - (math.lgamma(n + 1) - math.lgamma(col + 1) - math.lgamma(n - col + 1))
        )

    return min(1.0, sum(math.exp(log_p(k)) for k in range(a, min(row, col) + 1)))


def _mapped(function, kinds=float):
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*(c.to_numpy() for c in columns))
        return pd.Series([None if any(v is None or v != v for v in r) else function(*map(kinds, r)) for r in rows], dtype="float64")

    return run


def chi2_sf(x: Column, df: Column | None = None) -> Column:
    """P(chi-square >= x). One degree of freedom unless given."""
    def one(x: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(v) if v == v else np.nan for v in np.sqrt(np.maximum(x.to_numpy(float), 0) / 2)])

    def many(x: pd.Series, df: pd.Series) -> pd.Series:
        return _mapped(chi2_tail)(x, df)

    return F.pandas_udf(one, "double")(x) if df is None else F.pandas_udf(many, "double")(x, df)


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    def run(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return _mapped(f_tail)(f, d1, d2)

    return F.pandas_udf(run, "double")(f, d1.cast("double"), d2.cast("double"))


def fisher_sf(a: Column, b: Column, c: Column, d: Column) -> Column:
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return _mapped(fisher_greater, int)(a, b, c, d)

    return F.pandas_udf(run, "double")(a, b, c, d)
