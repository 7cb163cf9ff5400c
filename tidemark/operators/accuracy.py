"""Accuracy statistics by forecaster and horizon, and their ratios to a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maturity import GROUP, analysis_sample

STATISTICS = ("mse", "rmse", "rmedse", "mean_abs_error")


def accuracy(main: DataFrame, k: int = 12, source=None, variable=None, same_date_range: bool = True, extra: list[str] | None = None) -> DataFrame:
    """One row per group: mse, rmse, rmedse, mean_abs_error, n_observations and the
    first and last forecast vintage. One shuffle for the group after the sample's."""
    e = F.col("forecast_error")
    return (
        analysis_sample(main, k, source, variable, same_date_range, extra)
        .groupBy(*(extra or []), *GROUP)
        .agg(
            F.avg(e * e).alias("mse"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.sqrt(F.median(e * e)).alias("rmedse"),
            F.avg(F.abs(e)).alias("mean_abs_error"),
            F.count(e).alias("n_observations"),
            F.min("vintage_date_forecast").alias("start_date"),
            F.max("vintage_date_forecast").alias("end_date"),
        )
    )


def compare_to_benchmark(stats: DataFrame, benchmark: str, statistic: str = "rmse") -> DataFrame:
    """Adds ``{statistic}_to_benchmark``; null where the group has no benchmark."""
    if statistic not in stats.columns:
        raise ValueError(f"unknown statistic {statistic!r}")
    if stats.where(F.col("unique_id") == benchmark).isEmpty():
        raise ValueError(f"benchmark {benchmark!r} not found")
    return ratio_to(stats, benchmark, statistic)


def ratio_to(stats: DataFrame, benchmark: str, statistic: str) -> DataFrame:
    keys = [c for c in ("variable", "metric", "frequency", "horizon", "window_start", "window_end") if c in stats.columns]
    bench = stats.where(F.col("unique_id") == benchmark).select(*keys, F.col(statistic).alias("_bench"))
    return stats.join(bench, keys, "left").withColumn(f"{statistic}_to_benchmark", F.try_divide(statistic, "_bench")).drop("_bench")


def comparison_table(stats: DataFrame, variable: str, metric: str, benchmark: str, frequency: str = "Q", statistic: str = "rmse", horizons=(0, 1, 2, 4, 8, 12)) -> DataFrame:
    """Forecasters by horizon, ratios in the cells; the benchmark has no row."""
    own = stats.where((F.col("variable") == variable) & (F.col("metric") == metric) & (F.col("frequency") == frequency))
    ratio = ratio_to(own, benchmark, statistic).where(F.col("unique_id") != benchmark)
    wide = ratio.groupBy("unique_id").pivot("horizon", list(horizons)).agg(F.first(f"{statistic}_to_benchmark"))
    return wide.orderBy("unique_id")


def profile_by_horizon(df: DataFrame) -> DataFrame:
    """Mean, standard deviation and number of errors at each horizon."""
    e = F.col("forecast_error")
    return df.groupBy("variable", "metric", "frequency", "unique_id", "horizon").agg(F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error"), F.count(e).alias("n_observations"))


def summary_by_horizon(stats: DataFrame) -> DataFrame:
    """Sample of each horizon: first start, last end and observations."""
    return stats.groupBy("horizon").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.min_by("n_observations", F.struct("variable", "unique_id")).alias("n_observations"))
