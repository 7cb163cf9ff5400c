"""Revisions of outturns and of forecasts, and what they tell about errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import f_p, normal_p
from ..functions.inference import line_hac
from .bias import series
from .maturity import common_sample, filter_k
from .filters import listed

TARGET = ["date", "variable", "frequency", "metric"]
PATH = ["variable", "unique_id", "metric", "frequency", "date"]


def outturn_revisions(outturns: DataFrame) -> DataFrame:
    """Each release against the first of its target: rank k and revision."""
    o = outturns.where(~F.col("_aligned")).drop("_aligned") if "_aligned" in outturns.columns else outturns
    w = Window.partitionBy(*TARGET)
    first = F.min_by("value", "vintage_date").over(w)
    return o.where("vintage_date is not null").withColumns({"k": (F.row_number().over(w.orderBy("vintage_date")) - 1).cast("int"), "revision": F.col("value") - first, "latest_vintage": F.max("vintage_date").over(w)})


def forecast_revisions(forecasts: DataFrame) -> DataFrame:
    """Change of each target's forecast from vintage to vintage, numbered from 0; the
    first has none."""
    w = Window.partitionBy(*PATH).orderBy("vintage_date")
    return forecasts.withColumns({"revision": F.col("value") - F.lag("value").over(w), "revision_number": (F.row_number().over(w) - 1).cast("int")})


def errors_and_revisions(main: DataFrame, forecasts: DataFrame, k: int = 12) -> DataFrame:
    """The error of one maturity beside the revision that led to the forecast."""
    r = forecast_revisions(forecasts).where("revision is not null").select(*PATH, F.col("vintage_date").alias("vintage_date_forecast"), "revision", "revision_number")
    return filter_k(main, k).join(r, [*PATH, "vintage_date_forecast"]).withColumn("horizon", F.col("target_minus_vintage"))


def revision_error_regression(main: DataFrame, forecasts: DataFrame, k: int = 12, source=None, variable=None, same_date_range: bool = True) -> DataFrame:
    """Errors on a constant and the last revision, all groups in one job."""
    df = errors_and_revisions(main, forecasts, k)
    if source is not None:
        df = df.where(F.col("unique_id").isin(listed(source)))
    if same_date_range:
        df = common_sample(df)
    if variable is not None:
        df = df.where(F.col("variable").isin(listed(variable)))
    out = line_hac(series(df, {"e": "forecast_error", "r": "revision"}), "e", "r", "hac_maxlags").where("b1 is not null")
    out = out.withColumns({"const": F.col("b0"), "beta": F.col("b1"), "const_se": F.sqrt(F.greatest("v00", F.lit(0.0))), "beta_se": F.sqrt(F.greatest("v11", F.lit(0.0)))})
    return out.drop("e", "r", "b0", "b1", "v00", "v01", "v11")


def revision_error_table(main: DataFrame, forecasts: DataFrame, **args) -> DataFrame:
    out = revision_error_regression(main, forecasts, **args)
    out = out.withColumns({"const_pvalue": normal_p(F.try_divide("const", "const_se")), "beta_pvalue": normal_p(F.try_divide("beta", "beta_se"))})
    return out.withColumn("correlated", F.coalesce(F.col("beta_pvalue") < 0.05, F.lit(False)))


def hac_ols(y: np.ndarray, x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and Newey-West covariance; ``x`` has its constant."""
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    s = x * (y - x @ b)[:, None]
    meat = s.T @ s
    for lag in range(1, min(lags, len(y) - 1) + 1):
        g = s[lag:].T @ s[:-lag]
        meat += (1 - lag / (lags + 1)) * (g + g.T)
    return b, inv @ meat @ inv


def revision_predictability(forecasts: DataFrame, n_revisions: int = 5, source=None, variable=None, frequency=None, same_date_range: bool = True) -> DataFrame:
    """The revision at the shortest distance on those at longer ones, target by target:
    joint F that no slope differs from zero, one lag.

    The regressors of one forecaster are a small dense matrix (targets by revisions),
    so each group is one grouped pandas call; groups are forecasters' series.
    """
    if n_revisions < 1:
        raise ValueError("n_revisions is a positive number")
    df = forecasts
    if source is not None:
        df = df.where(F.col("unique_id").isin(listed(source)))
    if same_date_range:
        df = common_sample(df)
    for column, wanted in (("variable", variable), ("frequency", frequency)):
        if wanted is not None:
            df = df.where(F.col(column).isin(listed(wanted)))
    rows = forecast_revisions(df).withColumn("horizon", F.col("target_minus_vintage")).where(F.col("horizon") <= n_revisions).select("variable", "unique_id", "metric", "frequency", "date", "horizon", "revision")
    keys = ["variable", "unique_id", "metric", "frequency"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="date", columns="horizon", values="revision", dropna=False).dropna()
        m = wide.to_numpy(float)
        head = pdf[keys].iloc[:1].reset_index(drop=True)
        if m.shape[1] < 2 or m.shape[0] <= m.shape[1]:
            return head.assign(joint_test_fstat=None, slopes=max(m.shape[1] - 1, 0), n_observations=len(m))
        b, v = hac_ols(m[:, 0], np.column_stack([np.ones(len(m)), m[:, 1:]]), 1)
        f = float(b[1:] @ np.linalg.pinv(v[1:, 1:]) @ b[1:]) / (len(b) - 1)
        return head.assign(joint_test_fstat=f, slopes=len(b) - 1, n_observations=len(m))

    out = rows.groupBy(*keys).applyInPandas(fit, "variable string, unique_id string, metric string, frequency string, joint_test_fstat double, slopes int, n_observations long")
    out = out.withColumn("joint_test_pvalue", f_p(F.col("joint_test_fstat"), F.col("slopes"), F.col("n_observations") - F.col("slopes") - 1))
    return out.withColumn("reject_null", F.coalesce(F.col("joint_test_pvalue") < 0.05, F.lit(False)))


def average_revision(forecasts: DataFrame) -> DataFrame:
    """Mean revision by horizon."""
    df = forecast_revisions(forecasts).withColumn("horizon", F.col("target_minus_vintage"))
    return df.groupBy("variable", "unique_id", "metric", "frequency", "horizon").agg(F.avg("revision").alias("mean_revision"), F.count("revision").alias("n_observations"))
