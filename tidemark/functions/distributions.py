"""Tail probabilities without SciPy: normal, Student t and F, for arrays and columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def normal_cdf(x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) if v == v else np.nan for v in x.ravel()]).reshape(x.shape)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    shape = x.shape
    return np.array([_beta_inc(*v) for v in zip(a.ravel(), b.ravel(), x.ravel(), strict=True)]).reshape(shape)


def _beta_inc(a: float, b: float, x: float) -> float:
    if not (x == x and a > 0 and b > 0):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + num * d or tiny)
        c = 1.0 + num / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_tail(f, d1, d2) -> np.ndarray:
    f, d1, d2 = np.asarray(f, float), np.asarray(d1, float), np.asarray(d2, float)
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _numbers(x: pa.Array) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in x.to_pylist()], float)


def _column(values: np.ndarray) -> pa.Array:
    return pa.array([None if v != v else float(v) for v in values], pa.float64())


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a normal statistic; null of null."""

    @F.arrow_udf("double")
    def p(x: pa.Array) -> pa.Array:
        return _column(2 * normal_cdf(-np.abs(_numbers(x))))

    return p(z.cast("double"))


def t_p(t: Column, df: Column) -> Column:
    @F.arrow_udf("double")
    def p(x: pa.Array, n: pa.Array) -> pa.Array:
        return _column(t_two_sided(_numbers(x), _numbers(n)))

    return p(t.cast("double"), df.cast("double"))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    @F.arrow_udf("double")
    def p(x: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        return _column(f_tail(_numbers(x), _numbers(n), _numbers(m)))

    return p(f.cast("double"), d1.cast("double"), d2.cast("double"))
