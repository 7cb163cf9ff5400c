"""Efficiency regressions: outturn on forecast, errors on other forecasts, and ratios
of an error response to an outturn response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_p, normal_p, normal_quantile
from ..functions.inference import dot, field, joint_f, line_hac, long_run, ordered, total
from .bias import series
from .maturity import analysis_sample, filter_k, with_horizon

LEAST = 10


def mincer_zarnowitz(main: DataFrame, k: int = 12, source=None, variable=None, same_date_range: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Outturn on a constant and the forecast, all groups in one job.

    ``status`` is ``ok``, ``few`` (under ten observations) or ``degenerate`` (the
    forecast never varies); estimates are null unless it is ``ok``.
    """
    df = analysis_sample(main, k, source, variable, same_date_range, extra)
    out = line_hac(series(df, {"y": "value_outturn", "x": "value_forecast"}, extra=extra), "y", "x", "hac_maxlags")
    status = F.when(F.col("n_observations") < LEAST, "few").when(F.col("b1").isNull(), "degenerate").otherwise("ok")
    out = out.withColumn("status", status)
    fine = lambda c: F.when(F.col("status") == "ok", c)
    return out.withColumns(
        {
            "forecast_coef": fine(F.col("b1")),
            "constant_coef": fine(F.col("b0")),
            "forecast_se": fine(F.sqrt(F.greatest("v11", F.lit(0.0)))),
            "constant_se": fine(F.sqrt(F.greatest("v00", F.lit(0.0)))),
            "joint_test_fstat": fine(joint_f(F.col("b0"), F.col("b1") - 1.0, F.col("v00"), F.col("v01"), F.col("v11"))),
        }
    ).drop("y", "x", "b0", "b1", "v00", "v01", "v11", "rsquared")


def weak_efficiency(main: DataFrame, **args) -> DataFrame:
    out = mincer_zarnowitz(main, **args)
    out = out.withColumn("joint_test_pvalue", f_p(F.col("joint_test_fstat"), F.lit(2), F.col("n_observations") - 2))
    return out.withColumn("reject_weak_efficiency", F.coalesce(F.col("joint_test_pvalue") < 0.05, F.lit(False)))


def _crossed(main: DataFrame, source, outcome_variable, outcome_metric, instrument_variable, instrument_metric, horizons, j, k, extra) -> DataFrame:
    """Errors at each horizon beside the instrument of the same forecast vintage."""
    df = with_horizon(filter_k(main, k, extra=extra)).where(F.col("unique_id") == source)
    keys = [*(extra or []), "vintage_date_forecast"]
    left = df.where((F.col("variable") == outcome_variable) & (F.col("metric") == outcome_metric) & F.col("horizon").isin([int(h) for h in horizons])).select(*keys, "unique_id", "horizon", "forecast_horizon", F.col("forecast_error").alias("u"))
    right = df.where((F.col("variable") == instrument_variable) & (F.col("metric") == instrument_metric) & (F.col("horizon") == int(j))).select(*keys, F.col("value_forecast").alias("x"), F.col("value_outturn").alias("z"))
    return left.join(right, keys)


def strong_efficiency(main: DataFrame, source: str, outcome_variable: str, outcome_metric: str, instrument_variable: str, instrument_metric: str, horizons=range(13), j: int = 2, k: int = 12, alpha: float = 0.05, extra: list[str] | None = None) -> DataFrame:
    """Error of one variable on the forecast of another: no slope should remain."""
    rows = _crossed(main, source, outcome_variable, outcome_metric, instrument_variable, instrument_metric, horizons, j, k, extra)
    out = line_hac(series(rows, {"u": "u", "x": "x"}, ["vintage_date_forecast"], extra, ["unique_id", "horizon"]), "u", "x", "hac_maxlags").where("b1 is not null")
    out = out.withColumns({"ols_coefficient": F.col("b1"), "ols_se": F.sqrt(F.greatest("v11", F.lit(0.0)))})
    return _inference(out, "ols_coefficient", "ols_se", "coeff", alpha).select(
        *(extra or []), "unique_id", "horizon", F.lit(int(j)).alias("instrument_horizon"), F.lit(outcome_variable).alias("outcome_variable"), F.lit(instrument_variable).alias("instrument_variable"),
        "n_observations", "hac_maxlags", "ols_coefficient", "ols_se", "coeff_ci_lower", "coeff_ci_upper", "z_stat", "p_value", F.lit(alpha).alias("alpha"), "significant",
    )


def _inference(df: DataFrame, coef: str, se: str, prefix: str, alpha: float) -> DataFrame:
    z = normal_quantile(1 - alpha / 2)
    df = df.withColumns({f"{prefix}_ci_lower": F.col(coef) - z * F.col(se), f"{prefix}_ci_upper": F.col(coef) + z * F.col(se), "z_stat": F.try_divide(coef, se)})
    df = df.withColumn("p_value", normal_p(F.col("z_stat")))
    return df.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def _scores(y: str, slope: str) -> Column:
    return F.zip_with("dx", y, lambda a, b: a * (b - F.col(slope) * a))


def _centred(c: str) -> Column:
    return F.transform(c, lambda v: v - total(F.col(c)) / F.size(c))


def response_ratio(main: DataFrame, source: str, outcome_variable: str, outcome_metric: str, instrument_variable: str, instrument_metric: str, horizons=range(13), j: int = 2, k: int = 12, alpha: float = 0.05, extra: list[str] | None = None) -> DataFrame:
    """Two regressions on the same instrument forecast, of the outcome's error and of the
    instrument's own outturn; their slopes' ratio with a delta-method standard error
    from the joint Bartlett covariance."""
    rows = _crossed(main, source, outcome_variable, outcome_metric, instrument_variable, instrument_metric, horizons, j, k, extra)
    keys = [*(extra or []), "unique_id", "horizon"]
    g = rows.groupBy(*keys).agg(ordered(["vintage_date_forecast"], u="u", x="x", z="z").alias("_rows"), F.max("forecast_horizon").alias("_fh"))
    g = g.withColumns({c: field("_rows", c) for c in "uxz"}).withColumn("n_observations", F.size("_rows").cast("long"))
    g = g.withColumn("hac_bandwidth", F.least(F.greatest("_fh", F.lit(0)), F.col("n_observations") - 1).cast("int"))
    g = g.withColumns({f"d{c}": _centred(c) for c in "uxz"}).withColumn("sxx", dot(F.col("dx"), F.col("dx"))).where("sxx > 0")
    g = g.withColumns({"first_coefficient": dot(F.col("dx"), F.col("du")) / F.col("sxx"), "second_coefficient": dot(F.col("dx"), F.col("dz")) / F.col("sxx")})
    for s, d, b in (("s1", "du", "first_coefficient"), ("s2", "dz", "second_coefficient")):
        g = g.withColumn(s, _scores(d, b))
    lags, sq = F.col("hac_bandwidth"), F.col("sxx") * F.col("sxx")
    g = g.withColumns({v: long_run(F.col(a), F.col(b), lags) / sq for v, a, b in (("v11", "s1", "s1"), ("v22", "s2", "s2"))})
    # Products of two different score series at all lags, both directions, are symmetrised by long_run.
    g = g.withColumn("v12", long_run(F.col("s1"), F.col("s2"), lags) / sq)
    b1, b2 = F.col("first_coefficient"), F.col("second_coefficient")
    var = F.col("v11") / (b2 * b2) + b1 * b1 / (b2 * b2 * b2 * b2) * F.col("v22") - 2 * b1 / (b2 * b2 * b2) * F.col("v12")
    g = g.where(b2 != 0).withColumns({"first_se": F.sqrt(F.greatest("v11", F.lit(0.0))), "second_se": F.sqrt(F.greatest("v22", F.lit(0.0))), "ratio": b1 / b2, "ratio_se": F.sqrt(F.greatest(var, F.lit(0.0)))})
    return _inference(g, "ratio", "ratio_se", "ratio", alpha).select(
        *keys, F.lit(int(j)).alias("instrument_horizon"), F.lit(outcome_variable).alias("outcome_variable"), F.lit(instrument_variable).alias("instrument_variable"), "n_observations", "hac_bandwidth",
        "first_coefficient", "first_se", "second_coefficient", "second_se", "ratio", "ratio_se", "ratio_ci_lower", "ratio_ci_upper", "z_stat", "p_value", F.lit(alpha).alias("alpha"), "significant",
    )
