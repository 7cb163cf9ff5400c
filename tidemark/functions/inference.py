"""Regression with autocorrelation-robust covariance, as JVM-side expressions.

A group's observations are one array in time order (a group is one forecaster's
series at one horizon, so its length is the number of vintages). Scores and their
lagged products are higher-order functions over that array: no Python worker, one
shuffle for all groups, and partial sorting only within groups.

Covariances are the Newey-West sandwich without small-sample correction; lags
beyond the sample contribute nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(order: list[str], **values: str | Column) -> Column:
    """The group's values as an array of structs in the given order."""
    row = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[(F.col(v) if isinstance(v, str) else v).cast("double").alias(k) for k, v in values.items()])
    return F.array_sort(F.collect_list(row))


def field(rows: str | Column, name: str) -> Column:
    """One field of each struct of an array."""
    return F.transform(rows, lambda r: r[name])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def lagged(a: Column, b: Column, lag: Column) -> Column:
    """Sum of a[t] * b[t - lag]."""
    n = F.size(a)
    return F.when(lag >= n, 0.0).otherwise(dot(F.slice(a, lag + 1, F.greatest(n - lag, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n - lag, F.lit(0)))))


def long_run(a: Column, b: Column, lags: Column, bartlett: bool = True) -> Column:
    """Sum of products at all lags up to ``lags``, both directions."""
    most = F.least(lags, F.size(a) - 1)

    def step(acc: Column, lag: Column) -> Column:
        weight = 1.0 - lag / (lags + 1.0) if bartlett else F.lit(1.0)
        return acc + weight * (lagged(a, b, lag) + lagged(b, a, lag))

    more = F.when(most >= 1, F.aggregate(F.sequence(F.lit(1), most), F.lit(0.0), step)).otherwise(0.0)
    return dot(a, b) + more


def mean_hac(df: DataFrame, series: str, lags: str) -> DataFrame:
    """``estimate, std_error`` of the mean of an array column."""
    x = F.col(series)
    df = df.withColumn("estimate", total(x) / F.size(x))
    df = df.withColumn("_u", F.transform(x, lambda v: v - F.col("estimate")))
    return df.withColumn("std_error", F.sqrt(F.greatest(long_run(F.col("_u"), F.col("_u"), F.col(lags)), F.lit(0.0))) / F.size(x)).drop("_u")


def line_hac(df: DataFrame, y: str, x: str, lags: str) -> DataFrame:
    """OLS of y on a constant and x: ``b0, b1, v00, v01, v11, rsquared``; null where x is constant."""
    n = F.size(y)
    df = df.withColumns({"_mx": total(F.col(x)) / n, "_my": total(F.col(y)) / n})
    df = df.withColumn("_dx", F.transform(x, lambda v: v - F.col("_mx"))).withColumn("_dy", F.transform(y, lambda v: v - F.col("_my")))
    df = df.withColumns({"_sxx": dot(F.col("_dx"), F.col("_dx")), "_sxy": dot(F.col("_dx"), F.col("_dy")), "_syy": dot(F.col("_dy"), F.col("_dy"))})
    flat = F.col("_sxx") <= 1e-18 * F.greatest(F.abs("_mx"), F.lit(1.0)) * n
    df = df.withColumn("b1", F.when(~flat, F.try_divide("_sxy", "_sxx")))
    df = df.withColumn("b0", F.col("_my") - F.col("b1") * F.col("_mx"))
    # Scores against the centred regressor keep the sums well conditioned.
    df = df.withColumn("_u", F.zip_with("_dy", "_dx", lambda a, b: a - F.col("b1") * b))
    df = df.withColumn("_s", F.zip_with("_u", "_dx", lambda a, b: a * b))
    c00, c01, c11 = (long_run(F.col(a), F.col(b), F.col(lags)) for a, b in (("_u", "_u"), ("_u", "_s"), ("_s", "_s")))
    df = df.withColumns({"_c00": c00 / (n * n), "_c01": F.try_divide(c01, n * F.col("_sxx")), "v11": F.try_divide(c11, F.col("_sxx") * F.col("_sxx"))})
    df = df.withColumns({
        "v00": F.col("_c00") - 2 * F.col("_mx") * F.col("_c01") + F.col("_mx") * F.col("_mx") * F.col("v11"),
        "v01": F.col("_c01") - F.col("_mx") * F.col("v11"),
        "rsquared": 1.0 - F.try_divide(dot(F.col("_u"), F.col("_u")), F.col("_syy")),
    })
    return df.drop("_mx", "_my", "_dx", "_dy", "_sxx", "_sxy", "_syy", "_u", "_s", "_c00", "_c01")


def joint_f(d0: Column, d1: Column, v00: Column, v01: Column, v11: Column) -> Column:
    """Wald statistic over two restrictions: d' V^-1 d / 2."""
    return F.try_divide(d0 * d0 * v11 - 2 * d0 * d1 * v01 + d1 * d1 * v00, 2.0 * (v00 * v11 - v01 * v01))
