"""Hand-calculated and independently recomputed cases."""

import datetime as dt
import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.functions import distributions, ids
from tidemark.operators import accuracy, benchmarks, bias, comparison, density, efficiency, filters, intra_period, maturity, revisions, rolling
from tidemark.plans import plot_data
from tidemark.sources import panels, schema
from tidemark.streaming import ingest

MAIN = "date date, variable string, vintage_date_forecast date, vintage_date_outturn date, unique_id string, metric string, frequency string, forecast_horizon int, target_minus_vintage int, value_forecast double, value_outturn double, k int, latest_vintage date, forecast_error double"
QUARTERS = [d.date() for d in pd.date_range("2000-03-31", periods=60, freq="QE")]


@pytest.mark.parametrize("last,end", [("2003-05-15", "2003-03-31"), ("2003-06-30", "2003-06-30")])
def test_panels_end_with_the_last_complete_quarter(spark, tmp_path, last, end):
    days = pd.date_range("1999-01-01", last, freq="D")
    rows = [(i, d.to_pydatetime(), 10.0, "1-URGENT", "F") for i, d in enumerate(days)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    for panel in (panels.quarterly_outturns, panels.monthly_outturns):
        assert str(panel(spark, str(tmp_path)).agg(F.max("date")).first()[0]) == end


def test_autoregression_query_has_early_vintages(spark):
    from tidemark.queries import ar_p, raw_forecasts

    sf = "/root/testdata/sf0.001"
    wanted = raw_forecasts(spark, sf).agg(F.min("vintage_date"), F.count_distinct("vintage_date")).first()
    assert str(wanted[0]) < "1998" and tuple(ar_p(spark, sf).agg(F.min("vintage_date"), F.count_distinct("vintage_date")).first()) == tuple(wanted)


def test_data_checks_see_every_group(spark):
    from tidemark.plans.container import SHOWN, data_checks

    quarters = [("2000-03-31", "1999-12-31"), ("2000-06-30", "2000-03-31"), ("2000-09-30", "2000-06-30")]
    new, out = [], []
    for g in range(250):
        for i, (v, d) in enumerate(quarters):
            out.append((d, v, f"v{g:03}", "levels", "Q", float(i)))
            new.append((d, v, f"v{g:03}", "levels", "Q", float(100 * i), "far", -1, -1))  # far, and 100 times the spread
            new.append((d, v, f"v{g:03}", "levels", "Q", float(i) + (50.0 if g == 249 else 0.0), "near", -1, -1))
            new.append((d, v, f"v{g:03}", "levels", "Q", float(100 * i), "late", 5, 3))
    key = "date string, vintage_date string, variable string, metric string, frequency string, value double"
    typed = lambda rows, more="": spark.createDataFrame(rows, key + more).withColumns({c: F.col(c).cast("date") for c in ("date", "vintage_date")})
    told = data_checks(typed(new, ", source string, forecast_horizon int, target_minus_vintage int"), typed(out))
    far, scale = [t for t in told if "far from" in t], [t for t in told if "in scale" in t]
    assert len(far) == SHOWN + 1 and far[-1].startswith("251 in all") and len(scale) == SHOWN + 1 and scale[-1].startswith("250 in all")
    assert all(t.startswith("late") for t in scale[:-1])
    one = data_checks(*[d.where("variable = 'v249'") for d in (typed(new, ", source string, forecast_horizon int, target_minus_vintage int"), typed(out))])
    assert len(one) == 3


def main_rows(series, horizon=0, lag=0):
    """One row per (id, quarter): forecast x against outturn y."""
    out = []
    for uid, (xs, ys) in series.items():
        for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
            out.append((QUARTERS[i], "v", QUARTERS[i], QUARTERS[i + 1], uid, "levels", "Q", lag, horizon, float(x), float(y), 0, QUARTERS[i + 1], float(y - x)))
    return out


@pytest.fixture(scope="module")
def hand(spark):
    y = [100.0] * 4
    return spark.createDataFrame(main_rows({"model_a": ([101, 102, 103, 104], y), "model_b": ([102, 104, 106, 108], y), "benchmark": ([103] * 4, y)}), MAIN)


def test_accuracy_by_hand(hand):
    out = {r["unique_id"]: r for r in accuracy.accuracy(hand).collect()}
    for uid, rmse, mae, rmedse in (("model_a", math.sqrt(7.5), 2.5, math.sqrt(6.5)), ("model_b", math.sqrt(30), 5, math.sqrt(26)), ("benchmark", 3, 3, 3)):
        r = out[uid]
        assert (r["rmse"], r["mean_abs_error"], r["rmedse"], r["n_observations"]) == (pytest.approx(rmse), mae, pytest.approx(rmedse), 4)
    ratio = {r["unique_id"]: r["rmse_to_benchmark"] for r in accuracy.compare_to_benchmark(accuracy.accuracy(hand), "benchmark").collect()}
    assert ratio["benchmark"] == 1 and ratio["model_b"] == pytest.approx(math.sqrt(30) / 3)
    with pytest.raises(ValueError):
        accuracy.compare_to_benchmark(accuracy.accuracy(hand), "nobody")


@pytest.mark.parametrize("have,want", [((5,), 5), ((5, 8, 11), 11), ((5, 8, 11, 14), 11), ((12, 14), 12), ((14,), 14)])
def test_maturity_truth_table(spark, have, want):
    rows = [(dt.date(2020, 3, 31), "v", "Q", "levels", "a", k, dt.date(2025, 3, 31)) for k in have]
    df = spark.createDataFrame(rows, "date date, variable string, frequency string, metric string, unique_id string, k int, latest_vintage date")
    assert [r["k"] for r in maturity.filter_k(df, 12).collect()] == [want]
    undated = df.withColumn("latest_vintage", F.lit(None).cast("date"))
    assert maturity.filter_k(undated, 12).count() == len(have)


def test_common_sample_by_hand(spark):
    q = QUARTERS
    rows = [("a", "v", q[i], q[i]) for i in range(4)] + [("b", "v", q[i], q[i]) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "unique_id string, variable string, vintage_date_forecast date, date date")
    got = {(r["unique_id"], r["date"]) for r in maturity.common_sample(df).collect()}
    assert got == {(u, q[i]) for u in "ab" for i in (1, 2, 3)}


def newey_west(u, lags):
    s = u @ u
    for k in range(1, min(lags, len(u) - 1) + 1):
        s += 2 * (1 - k / (lags + 1)) * (u[k:] @ u[:-k])
    return s


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 2, 40)
    y = 0.5 + 0.8 * x + rng.normal(0, 1, 40)
    z = x + rng.normal(0, 1, 40)
    return (x, y, z), spark.createDataFrame(main_rows({"m": (x, y), "other": (z, y)}, lag=3), MAIN)


def test_bias_is_newey_west(simulated):
    (x, y, _), df = simulated
    r = bias.bias_table(df).where("unique_id = 'm'").first()
    e = y - x
    se = math.sqrt(newey_west(e - e.mean(), 3)) / 40
    assert (r["bias_estimate"], r["std_error"], r["hac_maxlags"]) == (pytest.approx(e.mean()), pytest.approx(se), 3)
    assert r["p_value"] == pytest.approx(math.erfc(abs(e.mean() / se) / math.sqrt(2)))


def test_mincer_zarnowitz_by_numpy(simulated):
    (x, y, _), df = simulated
    b, v = revisions.hac_ols(y, np.column_stack([np.ones(40), x]), 3)
    r = efficiency.weak_efficiency(df).where("unique_id = 'm'").first()
    d = b - [0, 1]
    assert (r["constant_coef"], r["forecast_coef"]) == (pytest.approx(b[0]), pytest.approx(b[1]))
    assert (r["constant_se"], r["forecast_se"]) == (pytest.approx(math.sqrt(v[0, 0])), pytest.approx(math.sqrt(v[1, 1])))
    assert r["joint_test_fstat"] == pytest.approx(d @ np.linalg.inv(v) @ d / 2)


def test_flat_and_short_groups_have_a_status(spark):
    rows = main_rows({"flat": ([5] * 20, range(20)), "short": ([1, 2, 3], [1, 2, 4])})
    out = {r["unique_id"]: r for r in efficiency.weak_efficiency(spark.createDataFrame(rows, MAIN), same_date_range=False).collect()}
    assert out["flat"]["status"] == "degenerate" and out["short"]["status"] == "few" and out["flat"]["forecast_coef"] is None


def test_response_ratio_by_numpy(spark):
    rng = np.random.default_rng(9)
    x, z = rng.normal(3, 1, 40), rng.normal(0, 1, 40)
    rows = []
    for var, fc, ot in (("out", z, z + 0.5 * x + rng.normal(0, 0.2, 40)), ("ins", x, 1.5 * x + rng.normal(0, 0.3, 40))):
        rows += [(*r[:1], var, *r[2:]) for r in main_rows({"m": (fc, ot)}, horizon=2, lag=2)]
    df = spark.createDataFrame(rows, MAIN)
    u = np.array([r[13] for r in rows[:40]])
    w = np.array([r[10] for r in rows[40:]])
    args = dict(outcome_variable="out", outcome_metric="levels", instrument_variable="ins", instrument_metric="levels", horizons=[2], j=2)
    r = efficiency.response_ratio(df, "m", **args).first()
    d = x - x.mean()
    c1, c2 = d @ u / (d @ d), d @ w / (d @ d)
    s1, s2 = d * (u - u.mean() - c1 * d), d * (w - w.mean() - c2 * d)

    def cross(a, b):
        t = a @ b
        for k in (1, 2):
            t += (1 - k / 3) * (a[k:] @ b[:-k] + b[k:] @ a[:-k])
        return t / (d @ d) ** 2

    var = cross(s1, s1) / c2**2 + c1**2 / c2**4 * cross(s2, s2) - 2 * c1 / c2**3 * cross(s1, s2)
    assert (r["ratio"], r["ratio_se"], r["hac_bandwidth"]) == (pytest.approx(c1 / c2), pytest.approx(math.sqrt(var)), 2)
    strong = efficiency.strong_efficiency(df, "m", **args).first()
    assert strong["ols_coefficient"] == pytest.approx(c1) and strong["ols_se"] == pytest.approx(math.sqrt(cross(s1, s1)))


def test_diebold_mariano_by_numpy(simulated):
    (x, y, z), df = simulated
    d = (y - x) ** 2 - (y - z) ** 2
    r = comparison.dm_table(df, "other").first()
    n, H, u = 40, 4, d - d.mean()
    var = (u @ u + 2 * sum(u[k:] @ u[:-k] for k in range(1, H))) / n / n
    if var < 0:
        var = newey_west(u, 3) / n / n
    dm = d.mean() / math.sqrt(var) * math.sqrt((n + 1 - 2 * H + H / n * (H - 1)) / n)
    assert r["dm_statistic"] == pytest.approx(dm) and r["hac_maxlags"] == 3
    assert r["p_value"] == pytest.approx(float(distributions.t_two_sided(dm, 39)))
    same = comparison.dm_table(df.where("unique_id = 'm'").unionByName(df.where("unique_id = 'm'").withColumn("unique_id", F.lit("twin"))), "twin").first()
    assert same["dm_statistic"] == 0.0


def test_distribution_values():
    """Against tabulated values."""
    assert distributions.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert distributions.f_tail(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-9)
    assert 2 * distributions.normal_cdf(-distributions.Z95) == pytest.approx(0.05, abs=1e-12)
    assert distributions.normal_quantile(0.975) == pytest.approx(distributions.Z95)


def test_fluctuation_values():
    assert rolling.critical_value(0.3) == 3.012 and rolling.critical_value(0.35) == pytest.approx((3.012 + 2.890) / 2)
    with pytest.raises(ValueError):
        rolling.critical_value(0.05)


def test_windows_leave_the_last_one_out(simulated):
    _, df = simulated
    assert rolling.windows(df, 8).count() == 40 - 8
    out = rolling.rolling(df, 8, bias.bias_statistics).where("unique_id = 'm'").orderBy("window_start")
    first = out.first()
    e = np.array([r["forecast_error"] for r in df.where("unique_id = 'm'").orderBy("date").collect()])
    assert first["bias_estimate"] == pytest.approx(e[:8].mean())


@pytest.mark.parametrize("phi,c,n,seed", [((0.6,), 0.5, 4000, 42), ((0.5, 0.3), 0.2, 6000, 7)])
def test_autoregression_recovers_parameters(phi, c, n, seed):
    rng = np.random.default_rng(seed)
    y = [0.0] * len(phi)
    for _ in range(n + 500):
        y.append(c + sum(p * y[-1 - i] for i, p in enumerate(phi)) + rng.normal())
    model = benchmarks.fit_ar_t(np.array(y[-n:]), len(phi))
    assert model["success"] and model["ar_coeffs"] == pytest.approx(phi, abs=0.05) and model["constant"] == pytest.approx(c, abs=0.08)
    ahead = benchmarks.extend(np.array([1.0, 2.0]), {"success": True, "constant": 1.0, "ar_coeffs": np.array([0.5])}, 2)
    assert list(ahead) == [2.0, 2.0]


def test_intra_period_by_hand(spark):
    rows = [(dt.date(2022, 3, 31), "v", dt.date(2022, 3, 17), dt.date(2022, 4, 20), "m", "levels", "Q", 0, 0, 1.0, 3.0, 0, dt.date(2022, 4, 20), 2.0), (dt.date(2022, 6, 30), "v", dt.date(2022, 6, 16), dt.date(2022, 7, 20), "m", "levels", "Q", 0, 0, 1.0, -3.0, 0, dt.date(2022, 7, 20), -4.0)]
    df = spark.createDataFrame(rows, MAIN)
    r = intra_period.accuracy(df, "v", "levels", "Q").first()
    assert r["days_to_period_end"] == 14 and r["rmse"] == pytest.approx(math.sqrt(10))
    assert intra_period.accuracy(df, "v", "levels", "Q", statistic="mae").first()["mae"] == 3
    assert intra_period.bias(df, "v", "levels", "Q").first()["bias"] == -1


def test_labels():
    assert ids.excluded_parts(["a + x", "b + y"], ["a"]) == {"b"} and ids.excluded_parts(["a + x"], ["q"]) == {"a", "x"}
    assert ids.safe_name("new label") == "new_label"


def test_source_filter_and_ids(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x"), ("b", "y")], "source string, label string").withColumn("unique_id", ids.unique_id(["source", "label"]))
    assert {r["unique_id"] for r in df.collect()} == {"a + ", "a + x", "b + x", "b + y"}
    assert {r[0] for r in filters.filter_sources(df, ["b", "x"]).select("unique_id").collect()} == {"b + x"}
    assert filters.filter_sources(df, ["nobody"]).count() == 0
    assert {r[0] for r in df.select(ids.readable("unique_id")).collect()} == {"a", "a + x", "b + x", "b + y"}
    with pytest.raises(ValueError):
        filters.filter_tables(df, start_date="2020/01/01")


def test_interpolation(spark):
    df = spark.createDataFrame([(1, 0.1, 10.0), (1, 0.5, 20.0), (1, 0.9, 40.0)], "id int, quantile double, value double")
    assert [density.cdf(df, x).first()["probability"] for x in (5.0, 15.0, 40.0)] == [0.1, pytest.approx(0.3), 0.9]
    draws = np.array([r["value"] for r in density.sample(df, 2000, 1).collect()])
    assert draws.min() >= 10 and draws.max() <= 40 and np.median(draws) == pytest.approx(20, abs=1.5)


# -- schema and containers -----------------------------------------------------------------
def test_schema_reports_all_faults(spark):
    df = spark.createDataFrame([("2022-03-31", "2022-04-30", "v", "Q", "1.5"), ("nonsense", "2022-04-30", "", "W", "x")], "date string, vintage_date string, variable string, frequency string, value string")
    with pytest.raises(ValueError) as e:
        schema.validate(df, schema.fields(False))
    assert all(x in str(e.value) for x in ("date is not of type date", "nonsense", "variable is empty", "frequency", "value is not of type"))
    with pytest.raises(ValueError, match="missing required columns: value"):
        schema.validate(df.drop("value"), schema.fields(False))
    ok = df.limit(1).withColumn("junk", F.lit(1)).withColumn("date", F.lit("2022-02-10"))
    assert schema.validate(ok.unionByName(ok), schema.fields(False)).collect()[0]["date"] == dt.date(2022, 3, 31)


@pytest.fixture(scope="module")
def data(spark):
    return tm.ForecastData(tm.create_sample_outturns(spark), tm.create_sample_forecasts(spark), data_check=False)


def test_container_pairs_samples(data):
    rows = data.df.where("metric = 'levels'").collect()
    assert len(rows) == 13 and all(r["forecast_error"] == 0 for r in rows)
    assert {r[0] for r in data.df.select("metric").distinct().collect()} >= {"levels", "pop"}


def test_container_is_atomic(spark, data):
    before = data.forecasts.count()
    other = tm.create_sample_forecasts(spark).withColumn("value", F.col("value") * 2)
    with pytest.raises(ValueError, match="contradict"):
        data.add_forecasts(other, data_check=False)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        data.copy().add_forecasts(tm.create_sample_forecasts(spark), data_check=False)
    assert data.forecasts.count() == before
    with pytest.raises(ValueError):
        tm.ForecastData().add_forecasts(other)
    with pytest.raises(ValueError):
        data.copy().add_outturns(tm.create_sample_outturns(spark), metric="growth")


def test_container_filters(data):
    d = data.copy()
    d.filter(start_date="2024-01-01", metrics=["levels"], sources=["mpr2"])
    assert d.df.count() == 5 and data.df.count() > 13
    d.clear_filter()
    assert d.df.count() == data.df.count()
    d.filter(custom_filter=lambda x: x.where("no_such_column > 1"))
    assert d.df.count() == data.df.count()


def test_extra_ids_and_merge(spark, data):
    f = tm.create_sample_forecasts(spark).withColumn("new label", F.lit("ABC"))
    d = data.copy()
    d.add_forecasts(f, extra_ids=["new label"], data_check=False)
    assert d.id_columns == ["source", "new_label"]
    assert {r[0] for r in d.df.select("unique_id").distinct().collect()} == {"mpr2 + ", "mpr2 + ABC"}
    other = tm.ForecastData(tm.create_sample_outturns(spark), tm.create_sample_forecasts(spark).withColumn("source", F.lit("rival")), data_check=False)
    m = data.copy()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        m.merge(other)
    assert {r[0] for r in m.df.select("unique_id").distinct().collect()} == {"mpr2", "rival"}


def test_outturns_without_vintages(spark):
    o = tm.create_sample_outturns(spark).drop("vintage_date")
    d = tm.ForecastData(o, tm.create_sample_forecasts(spark), outturn_vintages=False, data_check=False)
    rows = d.df.where("metric = 'levels'").collect()
    assert len(rows) == 13 and {r["k"] for r in rows} == {0} and {r["latest_vintage"] for r in rows} == {None}


def test_benchmarks_and_results(spark, data):
    o = tm.create_sample_outturns(spark).withColumn("vintage_date", F.lit("2025-03-31").cast("date"))
    later = tm.create_sample_forecasts(spark).where("forecast_horizon >= 6").withColumn("forecast_horizon", F.col("forecast_horizon") - 6)
    d = tm.ForecastData(o, later, data_check=False)
    d.add_benchmarks("random_walk", variables=["gdpkp"], forecast_periods=4)
    walk = d.forecasts.where((F.col("unique_id") == benchmarks.RANDOM_WALK) & (F.col("metric") == "levels")).collect()
    assert len(walk) == 4 and {r["value"] for r in walk} == {105.0} and min(r["date"] for r in walk) == dt.date(2023, 9, 30)
    with pytest.raises(ValueError):
        d.add_benchmarks("oracle")
    res = tm.compute_accuracy_statistics(data, same_date_range=False)
    assert res.filter(variable="gdpkp", source="mpr2").to_csv().startswith("variable,") and len(res.filter(horizon=99)) == 0
    assert res.to_df().columns.count("source") == 1 and "compute_accuracy_statistics" in repr(res)
    assert plot_data.of_result(res).count() == len(res)
    with pytest.raises(NotImplementedError):
        plot_data.of_result(tm.diebold_mariano_table(data, "mpr2"))


def test_nowcasts(spark):
    o = tm.create_sample_nowcast_outturns(spark).where("date >= '2024-01-01'")
    f = tm.create_sample_nowcast_forecasts(spark).where("vintage_date >= '2025-01-01' and vintage_date < '2025-04-01'")
    d = tm.NowcastData(o, f, data_check=False)
    assert d.default_k == 0 and d.df.where("k < 0 and vintage_date_outturn >= date").count() == 0
    assert "days_to_publication" in d.df.columns and d.df.where("metric = 'pop'").count() > 0
    assert len(tm.compute_intra_period_accuracy(d, "gdp", "levels", "Q")) > 0
    for f in (tm.weak_efficiency_analysis, tm.revision_predictability_analysis):
        with pytest.raises(ValueError):
            f(d)


def test_density_container(spark):
    d = tm.DensityForecastData(tm.create_sample_outturns(spark), density_data=tm.create_sample_density_forecasts(spark))
    assert d.density_forecasts.where("metric = 'levels'").count() == 13 * 50
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        d.to_point_forecast()
    assert d.forecasts.where("metric = 'levels'").count() == 13
    with pytest.raises(NotImplementedError):
        d.to_point_forecast("mean")
    d.filter(variables=["none"], filter_point_forecasts=False)
    assert d.density_forecasts.count() == 0


def test_streamed_releases(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    o = tm.create_sample_outturns(spark).withColumn("metric", F.lit("levels"))
    for n in (13, 26):  # the second file repeats the first's rows
        o.orderBy("variable", "date").limit(n).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_outturns(spark, src, table, str(tmp_path / "mark")).awaitTermination()
        assert spark.read.parquet(table).count() == n


def test_legacy_keyword(simulated):
    from tidemark.plans.analysis import evaluate_bias

    with pytest.warns(FutureWarning):
        assert len(evaluate_bias(simulated[1], "v", "m", "levels", forecast_horizon=0)) == 1
    with pytest.raises(TypeError):
        evaluate_bias(simulated[1], "v", "m", "levels", forecast_horizon=0, horizon=0)


def test_moving_bands_and_kde(simulated):
    _, df = simulated
    out = plot_data.errors_across_time_data(df, source="m", width=4).orderBy("date").collect()
    e = np.array([r["error"] for r in out])
    assert out[2]["moving_mean"] is None and out[3]["moving_mean"] == pytest.approx(e[:4].mean()) and out[3]["moving_std"] == pytest.approx(e[:4].std(ddof=1))
    grid = plot_data.forecast_error_density_data(df, 0).where("unique_id = 'm'").orderBy("x").toPandas()
    assert len(grid) == 200 and np.trapezoid(grid["density"], grid["x"]) == pytest.approx(1, abs=0.01)
