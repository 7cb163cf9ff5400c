"""Charts on a stand-in for matplotlib that records what is drawn; single-group tests."""

import contextlib
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.operators import bias, comparison, efficiency
from tidemark.plans import drawing, plot_data
from tidemark.queries import main_levels

SF = "/root/testdata/sf0.001"


class Axes:
    def __init__(self):
        self.calls, self.lines, self.inverted = [], [], False

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            if name == "plot":
                self.lines.append(args)

        return call

    def xaxis_inverted(self):
        return self.inverted

    def named(self, name):
        return [c for c in self.calls if c[0] == name]


@pytest.fixture
def plots(monkeypatch):
    pyplot = types.ModuleType("matplotlib.pyplot")
    pyplot.subplots = lambda subplot_kw=None: ("figure", Axes())
    pyplot.rc_context = lambda theme: contextlib.nullcontext()
    package = types.ModuleType("matplotlib")
    package.pyplot = pyplot
    monkeypatch.setitem(sys.modules, "matplotlib", package)
    monkeypatch.setitem(sys.modules, "matplotlib.pyplot", pyplot)


@pytest.fixture(scope="module")
def main(spark):
    return main_levels(spark, SF).where("variable in ('1-URGENT', '2-HIGH')").cache()


def test_every_chart_has_data_and_a_function():
    for name in drawing.CHARTS:
        assert callable(getattr(plot_data, f"{name}_data")) and getattr(tm, f"plot_{name}").__name__ == f"plot_{name}"
    assert set(plot_data.CHART.values()) <= set(drawing.CHARTS)


def test_without_matplotlib_the_data_come_back(spark, main):
    out = tm.plot_forecast_errors_by_horizon(main, variable="1-URGENT")
    assert out.columns[:4] == ["variable", "unique_id", "metric", "frequency"] or "mean_error" in out.columns


def test_lines_bands_labels_and_an_existing_plot(plots, main):
    stats = tm.bias_analysis(main, variable="1-URGENT")
    fig, ax = stats.plot(source="last", custom_labels={"last": "Naive", "title": "T", "x": "ahead"})
    assert len(ax.named("plot")) == 1 and ax.named("plot")[0][2]["label"] == "Naive" and len(ax.named("fill_between")) == 1
    assert ax.named("set_title")[0][1] == ("T",) and ax.named("set_xlabel")[0][1] == ("ahead",) and ax.named("axhline")[0][1] == (0.0,)
    again, same = stats.plot(source="mean4", existing_plot=(fig, ax))
    assert same is ax and len(ax.named("plot")) == 2 and len(ax.named("axhline")) == 1
    colours = [c[2]["color"] for c in ax.named("plot")]
    assert colours[0] != colours[1]


def test_other_kinds(plots, main):
    acc = tm.compute_accuracy_statistics(main)
    _, ax = acc.plot(variable="1-URGENT")
    assert len(ax.named("plot")) == 3
    _, ax = tm.plot_radar(acc, horizon=1)
    assert {len(c[1][0]) for c in ax.named("plot")} == {4} and len(ax.named("fill")) == 3
    _, ax = tm.plot_errors_across_time(main, variable="1-URGENT", source="last")
    assert len(ax.named("plot")) == 2 and len(ax.named("fill_between")) == 1
    _, ax = tm.plot_forecast_errors(main, "1999-03-31", variable="1-URGENT")
    assert len(ax.named("bar")) == 3
    _, ax = tm.plot_correlation_heatmap(tm.forecast_errors_correlation_analysis(main), ["last", "mean4"], variable="1-URGENT")
    assert ax.named("imshow")[0][1][0].shape[1] == 2 and not ax.named("legend")
    _, ax = tm.plot_forecast_error_density(main, 1, variable="1-URGENT")
    assert len(ax.named("plot")) == 3


def test_hedgehog_and_methods(plots, spark):
    d = tm.ForecastData(tm.create_sample_outturns(spark), tm.create_sample_forecasts(spark), data_check=False)
    _, ax = d.plot_hedgehog("gdpkp", "levels")
    labels = [c[2].get("label") for c in ax.named("plot")]
    assert labels.count("mpr2") == 1 and "outturn" in labels
    with pytest.raises(AttributeError):
        d.plot_nothing()
    d.release()
    assert d.df.count() > 0


def test_intra_period_points(plots, spark):
    n = tm.NowcastData(tm.create_sample_nowcast_outturns(spark), tm.create_sample_nowcast_forecasts(spark), data_check=False)
    first = n.df.where("metric = 'levels'").first()
    _, ax = tm.plot_intra_period_bias(n, first["variable"], "levels", first["frequency"])
    assert len(ax.named("errorbar")) >= 1 and len(ax.named("invert_xaxis")) == 1


# -- one group -------------------------------------------------------------------------
def test_single_groups_agree_with_tables(main):
    table = efficiency.weak_efficiency(main, same_date_range=False).where("variable = '1-URGENT' and unique_id = 'last' and horizon = 1").first()
    one = tm.weak_efficiency_test(main, "1-URGENT", "last", "levels", 1, verbose=False)
    assert one["joint_test_fstat"] == pytest.approx(table["joint_test_fstat"]) and one["n_observations"] == table["n_observations"]
    with pytest.raises(ValueError, match="no data"):
        tm.weak_efficiency_test(main, "nothing", "last", "levels", 1, verbose=False)
    args = dict(outcome_variable="1-URGENT", instrument_variable="2-HIGH")
    table = efficiency.strong_efficiency(main, "mean4", outcome_metric="levels", instrument_metric="levels", horizons=[0, 1], **args).where("horizon = 1").first()
    assert tm.strong_efficiency_test(main, "mean4", h=1, verbose=False, **args)["ols_se"] == pytest.approx(table["ols_se"])
    table = efficiency.response_ratio(main, "mean4", outcome_metric="levels", instrument_metric="levels", horizons=[0, 1], **args).where("horizon = 1").first()
    assert tm.blanchard_leigh_efficiency_test(main, "mean4", h=1, verbose=False, **args)["ratio_se"] == pytest.approx(table["ratio_se"])
    table = bias.bias_table(main, same_date_range=False).where("variable = '1-URGENT' and unique_id = 'last' and horizon = 1").first()
    assert tm.evaluate_bias(main, "1-URGENT", "last", "levels", 1).to_df().first()["p_value"] == pytest.approx(table["p_value"])


def test_diebold_mariano_of_a_list(spark):
    d = np.random.default_rng(4).normal(0.4, 1, 40)
    got = tm.diebold_mariano_test(d, 2)
    u = d - d.mean()
    gamma = [float(u[i:] @ u[: 40 - i]) for i in range(3)]
    var = (gamma[0] + 2 * sum(gamma[1:])) / 40**2
    want = d.mean() / var**0.5 * ((40 + 1 - 2 * 3 + 3 / 40 * 2) / 40) ** 0.5
    assert got["dm_statistic"] == pytest.approx(want) and 0 < got["p_value"] < 1 and got["mean_loss_diff"] == pytest.approx(d.mean())
    with pytest.raises(ValueError):
        tm.diebold_mariano_test([1.0], 0)
    row = spark.createDataFrame([([float(x) for x in d], 2)], "d array<double>, hac_maxlags int")
    assert comparison.dm_series(row).select(F.col("dm_statistic")).first()[0] == pytest.approx(got["dm_statistic"])


# -- tabs --------------------------------------------------------------------------------
def test_tabs_are_the_analyses_of_a_copy(spark):
    from tidemark.plans import tabs

    d = tm.ForecastData(tm.create_sample_outturns(spark), tm.create_sample_forecasts(spark), data_check=False)
    assert "radar" in tabs.names(d) and not {"quantile_time_machine", "intra_period_bias"} & set(tabs.names(d))
    found = tabs.run(d, "average_accuracy", filters={"metrics": ["levels"], "start_date": "2024-01-01"}, without_covid=True)
    assert found.to_df().select("metric").distinct().collect() == [("levels",)]
    text = tabs.download(d, "accuracy_summary", filters={"metrics": ["levels"]})
    assert text.splitlines()[0] == "horizon,start_date,end_date,n_observations" and d.df.where("metric = 'pop'").count() > 0
    with pytest.raises(ValueError, match="no tab"):
        tabs.run(d, "intra_period_bias")
