"""Tests of one group, as plain values: each runs the same operators as the tables do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import t_p
from ..operators import comparison, efficiency
from .compat import accept_forecast_horizon


def _one(df: DataFrame, what: str) -> dict:
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"no data for {what}" if not rows else f"several groups for {what}; name the frequency")
    return rows[0].asDict()


def _told(found: dict, verbose: bool) -> dict:
    if verbose:
        print("\n".join(f"{k}: {v}" for k, v in found.items()))
    return found


@accept_forecast_horizon
def weak_efficiency_test(df: DataFrame, variable: str, source: str, metric: str, horizon: int, frequency: str | None = None, verbose: bool = True, k: int = 12) -> dict:
    """Outturn on a constant and the forecast, of one forecaster, variable and horizon."""
    own = df.where((F.col("variable") == variable) & (F.col("unique_id") == source) & (F.col("metric") == metric) & (F.col("target_minus_vintage") == int(horizon)))
    if frequency is not None:
        own = own.where(F.col("frequency") == frequency)
    found = _one(efficiency.weak_efficiency(own, k=k, same_date_range=False), f"{variable}, {source}, {metric}, horizon {horizon}")
    if found["status"] != "ok":
        raise ValueError(f"the regression can't be fitted: {found['status']}, {found['n_observations']} observations")
    return _told(found, verbose)


def strong_efficiency_test(df: DataFrame, source: str, outcome_variable: str, h: int, instrument_variable: str, j: int = 2, alpha: float = 0.05, verbose: bool = True, outcome_metric: str = "levels", instrument_metric: str = "levels", k: int = 12) -> dict:
    """Errors of one variable at horizon ``h`` on forecasts of another at horizon ``j``."""
    out = efficiency.strong_efficiency(df, source, outcome_variable, outcome_metric, instrument_variable, instrument_metric, [h], j, k, alpha)
    return _told(_one(out, f"{outcome_variable} at horizon {h}"), verbose)


def blanchard_leigh_efficiency_test(df: DataFrame, source: str, outcome_variable: str, h: int, instrument_variable: str, j: int = 2, alpha: float = 0.05, verbose: bool = True, outcome_metric: str = "levels", instrument_metric: str = "levels", k: int = 12) -> dict:
    """The same errors' response relative to the instrument's own outturn's."""
    out = efficiency.response_ratio(df, source, outcome_variable, outcome_metric, instrument_variable, instrument_metric, [h], j, k, alpha)
    return _told(_one(out, f"{outcome_variable} at horizon {h}"), verbose)


def diebold_mariano_test(error_difference: Sequence[float], horizon: int) -> dict:
    """Equal accuracy from loss differences in time order (a list, array or pandas series)."""
    d = [float(x) for x in error_difference]
    if len(d) < 2:
        raise ValueError("two observations at least are needed")
    row = SparkSession.active().createDataFrame([(d, int(horizon), len(d))], "d array<double>, hac_maxlags int, n_observations long")
    found = comparison.dm_series(row).withColumn("p_value", t_p(F.col("dm_statistic"), F.col("n_observations") - 1)).first()
    verdict = "no difference at 5 %" if found["p_value"] is None or found["p_value"] >= 0.05 else "more accurate" if sum(d) < 0 else "less accurate"
    return {"dm_statistic": found["dm_statistic"], "p_value": found["p_value"], "mean_loss_diff": sum(d) / len(d), "interpretation": verdict}
