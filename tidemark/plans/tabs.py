"""What each tab of an interactive view computes, without the view.

Every tab is the same sequence: a copy of the container, filters, the pandemic left
out if asked, an analysis. ``run`` does it for one tab and ``download`` gives its
table as CSV text; a front end only has to show them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import accuracy as acc
from ..operators.filters import covid_filter
from . import analysis, plot_data
from .container import ForecastData


def _summary(data, **args) -> DataFrame:
    return acc.summary_by_horizon(analysis.compute_accuracy_statistics(data, **args).to_df())


def _relative(data, benchmark_model: str, statistic: str = "rmse", **args):
    return analysis.compare_to_benchmark(analysis.compute_accuracy_statistics(data, **args), benchmark_model, statistic)


def _rolling(test: Callable) -> Callable:
    return lambda data, window_size=8, **args: analysis.rolling_analysis(data, window_size, test, args)


def _radar(data, horizon: int = 0, **args) -> DataFrame:
    return plot_data.radar_data(analysis.compute_accuracy_statistics(data, **args), horizon=horizon)


#: Tab, and what it computes from the narrowed container.
TABS: dict[str, Callable] = {
    "average_accuracy": analysis.compute_accuracy_statistics,
    "accuracy_summary": _summary,
    "relative_accuracy": _relative,
    "rolling_accuracy": _rolling(analysis.compute_accuracy_statistics),
    "rolling_relative_accuracy": _rolling(analysis.diebold_mariano_table),
    "predictive_accuracy": analysis.diebold_mariano_table,
    "error_distribution": plot_data.forecast_error_density_data,
    "bias": analysis.bias_analysis,
    "rolling_bias": _rolling(analysis.bias_analysis),
    "weak_efficiency": analysis.weak_efficiency_analysis,
    "strong_efficiency": analysis.strong_efficiency_analysis,
    "correlation": analysis.forecast_errors_correlation_analysis,
    "radar": _radar,
    "hedgehog": plot_data.hedgehog_data,
    "time_machine": plot_data.vintage_data,
    "quantile_time_machine": plot_data.density_vintage_data,
    "intra_period_accuracy": analysis.compute_intra_period_accuracy,
    "intra_period_bias": analysis.compute_intra_period_bias,
    "outturns": plot_data.outturns_data,
    "outturn_revisions": plot_data.outturn_revisions_data,
}
#: Tabs that need one vintage a period.
NOT_FOR_NOWCASTS = {"weak_efficiency", "strong_efficiency", "correlation", "radar"}


def names(data: ForecastData) -> list[str]:
    """Tabs that suit the container."""
    hidden = NOT_FOR_NOWCASTS if data.uses_intra_period_vintages else set()
    if not hasattr(data, "_density"):
        hidden = hidden | {"quantile_time_machine"}
    if not data.uses_intra_period_vintages:
        hidden = hidden | {"intra_period_accuracy", "intra_period_bias"}
    return [t for t in TABS if t not in hidden]


def run(data: ForecastData, tab: str, *, filters: dict | None = None, without_covid: bool = False, **args):
    """The tab's result or chart data; the container itself stays as it is."""
    if tab not in names(data):
        raise ValueError(f"no tab {tab!r} for these data; there are {', '.join(names(data))}")
    own = data.copy()
    if filters:
        own.filter(**filters)
    if without_covid:
        own._views["main"] = covid_filter(own.df)  # of a copy
    return TABS[tab](own, **args)


def download(data: ForecastData, tab: str, **args) -> str:
    """The tab's table as CSV text."""
    found = run(data, tab, **args)
    df = found if isinstance(found, DataFrame) else found.to_df()
    return df.toPandas().to_csv(index=False)  # what a tab shows
