"""Bias of forecasts: mean errors with autocorrelation-robust standard errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import Z95, normal_p
from ..functions.inference import field, mean_hac, ordered
from .filters import filter_sources, listed
from .maturity import GROUP, common_sample, filter_k, with_horizon

ORDER = ["date", "vintage_date_forecast"]


def series(df: DataFrame, columns: dict[str, str], order: list[str] = ORDER, extra: list[str] | None = None, keys: list[str] = GROUP) -> DataFrame:
    """One row per group: ordered arrays of the columns, n and the lag that the
    longest information horizon asks for. A group is one forecaster's series at one
    horizon, so an array is as long as there are vintages."""
    rows = df.groupBy(*(extra or []), *keys).agg(ordered(order, **columns).alias("_rows"), F.greatest(F.max("forecast_horizon"), F.lit(0)).cast("int").alias("hac_maxlags"))
    arrays = {c: field("_rows", c) for c in columns}
    return rows.withColumns(arrays).withColumn("n_observations", F.size("_rows").cast("long")).drop("_rows")


def bias_statistics(main: DataFrame, k: int = 12, source=None, variable=None, same_date_range: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Estimate, robust standard error, t, lag and interval of each group, JVM-side.
    Forecasters are chosen by label before the maturity, unlike in other tests."""
    df = main
    if variable is not None:
        df = df.where(F.col("variable").isin(listed(variable)))
    if source is not None:
        whole = [s for s in listed(source) if "+" in s]
        labels = [s for s in listed(source) if "+" not in s]
        exact = F.col("unique_id").isin(whole) if whole else None
        df = filter_sources(df, labels, exact) if labels else df.where(exact)
    df = with_horizon(filter_k(df, k, extra=extra))
    if same_date_range:
        df = common_sample(df, extra)
    out = mean_hac(series(df, {"e": "forecast_error"}, extra=extra), "e", "hac_maxlags")
    half = F.lit(Z95) * F.col("std_error")
    return out.withColumnsRenamed({"estimate": "bias_estimate"}).withColumns({"t_statistic": F.try_divide(F.col("bias_estimate"), F.col("std_error")), "ci_lower": F.col("bias_estimate") - half, "ci_upper": F.col("bias_estimate") + half}).drop("e")


def bias_table(main: DataFrame, **args) -> DataFrame:
    """With p-values (normal, as under any robust covariance) and a verdict at 5 %."""
    out = bias_statistics(main, **args).withColumn("p_value", normal_p(F.col("t_statistic")))
    return out.withColumn("bias_conclusion", F.when(F.col("p_value") < 0.05, "Biased").otherwise("Unbiased"))
