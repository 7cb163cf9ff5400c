"""Vintage-aware forecast diagnostics and corpus preparation on Apache Spark."""

from .operators.filters import covid_filter, filter_report_variables
from .operators.maturity import filter_k
from .plans.analysis import (
    add_ar_p_forecasts,
    add_random_walk_forecasts,
    bias_analysis,
    blanchard_leigh_horizon_analysis,
    compare_to_benchmark,
    compute_accuracy_statistics,
    compute_intra_period_accuracy,
    compute_intra_period_bias,
    create_comparison_table,
    create_outturn_revisions,
    diebold_mariano_table,
    evaluate_bias,
    fluctuation_tests,
    forecast_errors_correlation_analysis,
    revision_predictability_analysis,
    revisions_errors_correlation_analysis,
    rolling_analysis,
    strong_efficiency_analysis,
    weak_efficiency_analysis,
)
from .plans.container import DensityForecastData, ForecastData, NowcastData
from .plans import drawing as _drawing
from .plans.result import TestResult
from .plans.single import blanchard_leigh_efficiency_test, diebold_mariano_test, strong_efficiency_test, weak_efficiency_test
from .functions.ids import split_id as reconstruct_id_cols_from_unique_id
from .sources.samples import create_sample_density_forecasts, create_sample_forecasts, create_sample_nowcast_forecasts, create_sample_nowcast_outturns, create_sample_outturns

globals().update(_drawing.functions())  # plot_accuracy and the other charts
__all__ = [n for n in dir() if not n.startswith("_")]
