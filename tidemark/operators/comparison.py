"""Forecasters against each other: equal predictive accuracy and correlated errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_p
from ..functions.inference import long_run, ordered, total
from .maturity import GROUP, analysis_sample, common_sample, filter_k, with_horizon

ID_PAIR = ["variable", "metric", "frequency", "horizon", "date", "vintage_date_forecast", "vintage_date_outturn", "latest_vintage", "k", "target_minus_vintage"]


def dm_series(df: DataFrame, series: str = "d", lags: str = "hac_maxlags") -> DataFrame:
    """Adds ``dm_statistic`` of an ordered array of loss differences.

    Autocovariances up to the lag, unweighted; with Bartlett weights where that
    variance is negative; nothing is inflated where mean and variance are all but
    zero; Harvey's small-sample factor. Null with fewer than two observations or
    fewer than the lag needs.
    """
    n, big = F.size(series).cast("double"), F.col(lags) + 1
    df = df.withColumn("_m", total(F.col(series)) / n).withColumn("_u", F.transform(series, lambda v: v - F.col("_m")))
    plain, weighted = long_run(F.col("_u"), F.col("_u"), F.col(lags), bartlett=False), long_run(F.col("_u"), F.col("_u"), F.col(lags))
    df = df.withColumn("_v", F.when(plain < 0, weighted).otherwise(plain) / (n * n))
    same = (F.abs("_m") < 1e-6) & (F.sqrt(F.greatest("_v", F.lit(0.0))) < 1e-6)
    harvey = F.sqrt(F.greatest((n + 1 - 2 * big + (big / n) * (big - 1)) / n, F.lit(0.0)))
    stat = F.when(same, 0.0).otherwise(F.try_divide(F.col("_m"), F.sqrt(F.when(F.col("_v") >= 0, F.col("_v"))))) * harvey
    return df.withColumn("dm_statistic", F.when((n >= 2) & (F.col(lags) < n), stat)).drop("_m", "_u", "_v")


def dm_statistics(main: DataFrame, benchmark: str, k: int = 12, loss: str = "mse", horizons=None, extra: list[str] | None = None) -> DataFrame:
    """Every forecaster against the benchmark; pairs share target, vintage and release,
    missing release dates included."""
    if loss not in ("mse", "mae"):
        raise ValueError("loss is 'mse' or 'mae'")
    df = with_horizon(main)
    if horizons is not None:
        df = df.where(F.col("horizon").isin([int(h) for h in horizons]))
    df = common_sample(filter_k(df, k, extra=extra), extra)
    keys = [*(extra or []), *[c for c in ID_PAIR if c in df.columns]]
    bench = df.where(F.col("unique_id") == benchmark).select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("forecast_error").alias("_e"), F.col("forecast_horizon").alias("_fh"))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(bench[f"_{c}"]) for c in keys])
    pairs = df.where(F.col("unique_id") != benchmark).join(bench, same)
    size = (lambda c: F.col(c) * F.col(c)) if loss == "mse" else F.abs
    e, b = F.col("forecast_error"), F.col("_e")
    pairs = pairs.withColumn("_d", size("forecast_error") - size("_e")).withColumn("_lag", F.greatest("forecast_horizon", "_fh"))
    out = pairs.groupBy(*(extra or []), *GROUP).agg(
        ordered(["date", "vintage_date_forecast"], d="_d").alias("_rows"),
        F.greatest(F.max("_lag"), F.lit(0)).cast("int").alias("hac_maxlags"),
        F.count("*").alias("n_observations"),
        F.try_divide(F.sqrt(F.avg(e * e)), F.sqrt(F.avg(b * b))).alias("rmse_ratio"),
    )
    out = dm_series(out.withColumn("d", F.transform("_rows", lambda r: r["d"])).drop("_rows"))
    return out.drop("d").withColumn("benchmark_source", F.lit(benchmark))


def dm_table(main: DataFrame, benchmark: str, **args) -> DataFrame:
    out = dm_statistics(main, benchmark, **args)
    return out.withColumn("p_value", t_p(F.col("dm_statistic"), F.col("n_observations") - 1))


def error_correlation(main: DataFrame, k: int = 12, source=None, variable=None, same_date_range: bool = True, min_observations: int = 5, extra: list[str] | None = None) -> DataFrame:
    """Correlation of the errors of all ordered pairs of forecasters, with themselves
    too, over targets and vintages that both have. The self-join is on the target
    and vintage, where each forecaster has one (mean) error."""
    df = analysis_sample(main, k, source, variable, same_date_range, extra)
    keys = [*(extra or []), "variable", "metric", "frequency", "horizon"]
    at = ["date", "vintage_date_forecast"]
    mean = df.groupBy(*keys, *at, "unique_id").agg(F.avg("forecast_error").alias("e")).where("e is not null")
    several = mean.groupBy(*keys).agg(F.min("unique_id").alias("lo"), F.max("unique_id").alias("hi")).where("lo <> hi").select(*keys)
    mean = mean.join(several, keys, "left_semi")
    other = mean.select(*keys, *at, F.col("unique_id").alias("unique_id_b"), F.col("e").alias("e_b"))
    out = mean.join(other, [*keys, *at]).groupBy(*keys, "unique_id", "unique_id_b")
    return out.agg(F.corr("e", "e_b").alias("correlation"), F.count("*").alias("n_observations"), F.min("date").alias("start_date"), F.max("date").alias("end_date")).where(F.col("n_observations") >= min_observations)


def correlation_matrix(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Forecasters by forecasters, mean correlation over what else varies."""
    return pairs.groupBy("unique_id").pivot("unique_id_b", names).agg(F.avg("correlation")).orderBy("unique_id")
