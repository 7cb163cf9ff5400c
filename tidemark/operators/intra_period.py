"""Errors of nowcasts as the target period's end, or its publication, comes near."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maturity import filter_k

AXES = {"period_end": ("days_to_period_end", "date"), "publication": ("days_to_publication", "vintage_date_outturn")}


def prepare(main: DataFrame, variable: str, metric: str, frequency: str, horizon: int | None = None, k: int = 0, axis: str = "period_end") -> tuple[DataFrame, str]:
    """Rows of one series with days to the axis' end, in whole weeks (half to even),
    and a flag where another maturity stood in for the one asked."""
    if axis not in AXES:
        raise ValueError(f"unknown axis {axis!r}; use 'period_end' or 'publication'")
    column, end = AXES[axis]
    df = filter_k(main, k).where((F.col("variable") == variable) & (F.col("metric") == metric) & (F.col("frequency") == frequency))
    if horizon is not None:
        df = df.where(F.col("target_minus_vintage") == horizon)
    weeks = F.bround(F.datediff(end, "vintage_date_forecast") / 7.0).cast("int")
    return df.withColumns({column: weeks * 7, "k_fallback_used": F.col("latest_vintage").isNotNull() & (F.col("k") != k)}), column


def accuracy(main: DataFrame, variable: str, metric: str, frequency: str, horizon: int | None = None, statistic: str = "rmse", k: int = 0, axis: str = "period_end") -> DataFrame:
    """rmse or mae by forecaster and bucket, with a standard error (null for one row)."""
    if statistic not in ("rmse", "mae"):
        raise ValueError("statistic is 'rmse' or 'mae'")
    df, column = prepare(main, variable, metric, frequency, horizon, k, axis)
    e, n = F.col("forecast_error"), F.count("forecast_error")
    if statistic == "rmse":
        value = F.sqrt(F.avg(e * e))
        se = F.try_divide(F.stddev_samp(e * e), 2 * F.sqrt(n) * value)
    else:
        value = F.avg(F.abs(e))
        se = F.stddev_samp(F.abs(e)) / F.sqrt(n)
    out = df.groupBy("unique_id", column).agg(value.alias(statistic), F.when(n > 1, se).alias("std_error"), n.alias("n_observations"), F.max("k_fallback_used").alias("k_fallback_used"))
    return out.orderBy("unique_id", F.desc(column))


def bias(main: DataFrame, variable: str, metric: str, frequency: str, horizon: int | None = None, k: int = 0, axis: str = "period_end") -> DataFrame:
    df, column = prepare(main, variable, metric, frequency, horizon, k, axis)
    e, n = F.col("forecast_error"), F.count("forecast_error")
    out = df.groupBy("unique_id", column).agg(F.avg(e).alias("bias"), F.when(n > 1, F.stddev_samp(e) / F.sqrt(n)).alias("std_error"), n.alias("n_observations"), F.max("k_fallback_used").alias("k_fallback_used"))
    return out.orderBy("unique_id", F.desc(column))
