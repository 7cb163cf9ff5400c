"""Analyses over a container, each a lazy result with its metadata.

Every function also takes a main-table DataFrame instead of a container.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accuracy as acc
from ..operators import bias as bias_ops
from ..operators import comparison, efficiency, intra_period, maturity, revisions, rolling
from ..operators.filters import strict_date
from .compat import accept_forecast_horizon
from .container import ForecastData
from .result import TestResult


def _main(data) -> DataFrame:
    return data if isinstance(data, DataFrame) else data.df


def _k(data, k: int | None) -> int:
    return k if k is not None else getattr(data, "default_k", 12)


def _result(data, df: DataFrame, name: str, parameters: dict, filters: dict | None = None) -> TestResult:
    labels = data.id_columns if isinstance(data, ForecastData) else []
    return TestResult(df, labels, {"test_name": name, "parameters": parameters, "filters": filters or {}, "horizon_measure": "target_minus_vintage"})


def _no_nowcasts(data, what: str) -> None:
    if isinstance(data, ForecastData) and data.uses_intra_period_vintages:
        raise ValueError(f"{what} needs one vintage per period; these are nowcasts")


def compute_accuracy_statistics(data, source=None, variable=None, k: int | None = None, same_date_range: bool = True) -> TestResult:
    k = _k(data, k)
    return _result(data, acc.accuracy(_main(data), k, source, variable, same_date_range), "compute_accuracy_statistics", {"k": k, "same_date_range": same_date_range}, {"unique_id": source, "variable": variable})


def compare_to_benchmark(result, benchmark_model: str, statistic: str = "rmse") -> TestResult:
    df = result.to_df() if isinstance(result, TestResult) else result
    return TestResult(acc.compare_to_benchmark(df, benchmark_model, statistic), getattr(result, "id_columns", []), {"test_name": "compare_to_benchmark", "parameters": {"benchmark_model": benchmark_model, "statistic": statistic}})


def create_comparison_table(result, variable: str, metric: str, benchmark_model: str, frequency: str = "Q", statistic: str = "rmse", horizons=(0, 1, 2, 4, 8, 12)) -> DataFrame:
    df = result.to_df() if isinstance(result, TestResult) else result
    return acc.comparison_table(df, variable, metric, benchmark_model, frequency, statistic, horizons)


def bias_analysis(data, source=None, variable=None, k: int | None = None, same_date_range: bool = True, verbose: bool = False) -> TestResult:
    k = _k(data, k)
    out = _result(data, bias_ops.bias_table(_main(data), k=k, source=source, variable=variable, same_date_range=same_date_range), "bias_analysis", {"k": k, "same_date_range": same_date_range, "verbose": verbose}, {"unique_id": source, "variable": variable})
    if verbose:
        out.show()
    return out


@accept_forecast_horizon
def evaluate_bias(df: DataFrame, variable: str, source: str, metric: str, horizon: int) -> TestResult:
    own = df.where((F.col("variable") == variable) & (F.col("unique_id") == source) & (F.col("metric") == metric) & (F.col("target_minus_vintage") == horizon))
    return _result(df, bias_ops.bias_table(own, k=12, same_date_range=False), "evaluate_bias", {"horizon": horizon})


def weak_efficiency_analysis(data, source=None, variable=None, k: int | None = None, same_date_range: bool = True, on_error: str = "status") -> TestResult:
    """``on_error='raise'``: groups that can't be fitted are an error; else they have a status."""
    _no_nowcasts(data, "the efficiency regression")
    k = _k(data, k)
    df = efficiency.weak_efficiency(_main(data), k=k, source=source, variable=variable, same_date_range=same_date_range)
    if on_error == "raise":
        bad = df.where("status <> 'ok'").select("variable", "unique_id", "horizon", "status").first()
        if bad:
            raise ValueError(f"can't be fitted: {bad.asDict()}")
    return _result(data, df, "weak_efficiency_analysis", {"k": k, "same_date_range": same_date_range}, {"unique_id": source, "variable": variable})


def strong_efficiency_analysis(data, source: str, outcome_variable: str, outcome_metric: str, instrument_variable: str, instrument_metric: str, horizons=range(13), j: int = 2, k: int | None = None, alpha: float = 0.05) -> TestResult:
    _no_nowcasts(data, "the efficiency regression")
    args = dict(outcome_variable=outcome_variable, outcome_metric=outcome_metric, instrument_variable=instrument_variable, instrument_metric=instrument_metric, j=j, alpha=alpha)
    return _result(data, efficiency.strong_efficiency(_main(data), source, horizons=horizons, k=_k(data, k), **args), "strong_efficiency_analysis", args, {"unique_id": source})


def blanchard_leigh_horizon_analysis(data, source: str, outcome_variable: str, outcome_metric: str, instrument_variable: str, instrument_metric: str, horizons=range(13), j: int = 2, k: int | None = None, alpha: float = 0.05) -> TestResult:
    _no_nowcasts(data, "the response ratio")
    args = dict(outcome_variable=outcome_variable, outcome_metric=outcome_metric, instrument_variable=instrument_variable, instrument_metric=instrument_metric, j=j, alpha=alpha)
    return _result(data, efficiency.response_ratio(_main(data), source, horizons=horizons, k=_k(data, k), **args), "blanchard_leigh_horizon_analysis", args, {"unique_id": source})


def diebold_mariano_table(data, benchmark_model: str, k: int | None = None, loss_function: str = "mse", horizons=None) -> TestResult:
    k = _k(data, k)
    return _result(data, comparison.dm_table(_main(data), benchmark_model, k=k, loss=loss_function, horizons=horizons), "diebold_mariano_table", {"benchmark_model": benchmark_model, "k": k, "loss_function": loss_function, "horizons": horizons})


def forecast_errors_correlation_analysis(data, source=None, variable=None, k: int | None = None, same_date_range: bool = True, min_observations: int = 5) -> TestResult:
    k = _k(data, k)
    return _result(data, comparison.error_correlation(_main(data), k, source, variable, same_date_range, min_observations), "forecast_errors_correlation_analysis", {"k": k, "same_date_range": same_date_range, "min_observations": min_observations}, {"unique_id": source, "variable": variable})


def create_outturn_revisions(data) -> DataFrame:
    if isinstance(data, ForecastData) and not (data.outturn_vintages and data.supports_outturn_revision_analysis):
        raise ValueError("outturns without vintages have no revisions")
    return revisions.outturn_revisions(data.outturns if isinstance(data, ForecastData) else data)


def create_revision_dataframe(data: ForecastData, k: int | None = None) -> DataFrame:
    return revisions.errors_and_revisions(data.df, data.forecasts, _k(data, k))


def revisions_errors_correlation_analysis(data: ForecastData, source=None, variable=None, k: int | None = None, same_date_range: bool = True) -> TestResult:
    _no_nowcasts(data, "the revision regression")
    df = revisions.revision_error_table(data.df, data.forecasts, k=_k(data, k), source=source, variable=variable, same_date_range=same_date_range)
    return _result(data, df, "revisions_errors_correlation_analysis", {"same_date_range": same_date_range}, {"unique_id": source, "variable": variable})


def revision_predictability_analysis(data: ForecastData, variable=None, source=None, frequency=None, n_revisions: int = 5, same_date_range: bool = True) -> TestResult:
    _no_nowcasts(data, "the revision regression")
    df = revisions.revision_predictability(data.forecasts, n_revisions, source, variable, frequency, same_date_range)
    return _result(data, df, "revision_predictability_analysis", {"n_revisions": n_revisions, "same_date_range": same_date_range}, {"unique_id": source, "variable": variable})


@accept_forecast_horizon
def compute_intra_period_accuracy(data, variable: str, metric: str, frequency: str, horizon: int | None = None, statistic: str = "rmse", k: int | None = None, axis: str = "period_end") -> TestResult:
    if isinstance(data, ForecastData) and not data.uses_intra_period_vintages:
        raise ValueError("intra-period analyses need nowcasts")
    k = k if k is not None else getattr(data, "default_k", 0)
    return _result(data, intra_period.accuracy(_main(data), variable, metric, frequency, horizon, statistic, k, axis), "compute_intra_period_accuracy", {"k": k, "axis": axis, "statistic": statistic}, {"variable": variable})


@accept_forecast_horizon
def compute_intra_period_bias(data, variable: str, metric: str, frequency: str, horizon: int | None = None, k: int | None = None, axis: str = "period_end") -> TestResult:
    if isinstance(data, ForecastData) and not data.uses_intra_period_vintages:
        raise ValueError("intra-period analyses need nowcasts")
    k = k if k is not None else getattr(data, "default_k", 0)
    return _result(data, intra_period.bias(_main(data), variable, metric, frequency, horizon, k, axis), "compute_intra_period_bias", {"k": k, "axis": axis}, {"variable": variable})


#: Analyses that run in all windows as one job, and the statistic a fluctuation test reads.
WINDOWED = {
    "compute_accuracy_statistics": (acc.accuracy, None),
    "bias_analysis": (bias_ops.bias_table, "t_statistic"),
    "weak_efficiency_analysis": (efficiency.weak_efficiency, "joint_test_fstat"),
    "diebold_mariano_table": (comparison.dm_table, "dm_statistic"),
    "forecast_errors_correlation_analysis": (comparison.error_correlation, None),
    "strong_efficiency_analysis": (efficiency.strong_efficiency, None),
    "blanchard_leigh_horizon_analysis": (efficiency.response_ratio, None),
}
_NAMES = {"benchmark_model": "benchmark", "loss_function": "loss"}


def rolling_analysis(data, window_size: int, analysis_func, analysis_args: dict | None = None, start_vintage=None, end_vintage=None) -> TestResult:
    """Known analyses run in all windows as one job; any other callable runs once for
    each window, on a filtered container."""
    args = dict(analysis_args or {})
    name = getattr(analysis_func, "__name__", str(analysis_func))
    meta = {"window_size": window_size, "analysis_func": name, "analysis_args": args, "start_vintage": start_vintage, "end_vintage": end_vintage}
    if name in WINDOWED:
        run, statistic = WINDOWED[name]
        own = {_NAMES.get(k, k): v for k, v in args.items()}
        own.setdefault("k", _k(data, None))
        df = rolling.rolling(_main(data), window_size, run, start_vintage, end_vintage, **own)
        if statistic:
            df = df.withColumnRenamed(statistic, "test_statistic")
        return _result(data, df, "rolling_analysis", meta)
    table = rolling.windows(_main(data), window_size, start_vintage, end_vintage).orderBy("window_start").collect()  # a row per window
    out = None
    for r in table:
        part = data.copy()
        part.filter(start_vintage=r["window_start"], end_vintage=r["window_end"])
        found = analysis_func(data=part, **args)
        df = (found.to_df() if isinstance(found, TestResult) else found).withColumns({"window_start": F.lit(r["window_start"]), "window_end": F.lit(r["window_end"])})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("window too large for the vintages")
    return _result(data, out, "rolling_analysis", meta)


def fluctuation_tests(data, window_size: int, test_func, test_args: dict | None = None, start_vintage=None, end_vintage=None) -> TestResult:
    name = getattr(test_func, "__name__", str(test_func))
    if WINDOWED.get(name, (None, None))[1] is None:
        raise ValueError("fluctuation tests know bias, weak efficiency and predictive accuracy tests")
    rolled = rolling_analysis(data, window_size, test_func, test_args, start_vintage, end_vintage).to_df()
    table = rolling.windows(_main(data), window_size, strict_date(start_vintage), strict_date(end_vintage))
    df, mu = rolling.fluctuation(rolled, "test_statistic", window_size, table)
    return _result(data, df, "fluctuation_tests", {"window_size": window_size, "test_func": name, "test_args": test_args or {}, "mu": mu})


def filter_k(df: DataFrame, k: int = 12, fill_k: bool = True) -> DataFrame:
    return maturity.filter_k(df, k, fill_k)


def add_random_walk_forecasts(data: ForecastData, variable=None, metric: str = "levels", frequency=None, forecast_periods: int = 13) -> None:
    data.add_benchmarks("random_walk", variable, metric, frequency, forecast_periods)


def add_ar_p_forecasts(data: ForecastData, variable=None, metric: str = "levels", frequency=None, forecast_periods: int = 13, max_lag: int = 2, *, estimation_start_date="1997-07-01") -> None:
    data.add_benchmarks("AR", variable, metric, frequency, forecast_periods, max_lag=max_lag, estimation_start_date=estimation_start_date)
