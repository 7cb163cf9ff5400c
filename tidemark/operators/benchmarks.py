"""Benchmark forecasts: random walk, and autoregressions with Student-t errors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar

RANDOM_WALK, AR = "baseline random walk model", "baseline ar(p) model"
SERIES = ["variable", "metric", "frequency", "vintage_date"]
LEAST_FOR_BIC = 8
SCALE_MIN, NU_MIN, NU_MAX = 0.001, 2.1, 30.0


def cutoffs(forecasts: DataFrame | None, outturns: DataFrame) -> DataFrame:
    """``variable, frequency, vintage_date, last_obs``: what a forecaster of each vintage
    had seen, from the least information horizon; from the outturns where there are
    no forecasts at all."""
    keys = ["variable", "frequency", "vintage_date"]
    if forecasts is None:
        return outturns.where("vintage_date is not null").groupBy(*keys).agg(F.max("date").alias("last_obs"))
    least = forecasts.groupBy(*keys).agg(F.min(F.struct("forecast_horizon", "date")).alias("m"))
    return least.select(*keys, calendar.add_periods(F.col("m.date"), -(F.col("m.forecast_horizon") + 1), F.col("frequency")).alias("last_obs"))


def training(outturns: DataFrame, forecasts: DataFrame | None, metric: str, variables=None, frequency=None, start=None) -> DataFrame:
    """Observations each vintage's model may use; undated outturns serve every vintage."""
    o = outturns.where(F.col("metric") == metric)
    if "_aligned" in o.columns:
        o = o.drop("_aligned")
    if variables is not None:
        o = o.where(F.col("variable").isin(variables))
    if frequency is not None:
        o = o.where(F.col("frequency") == frequency)
    cut = cutoffs(forecasts, outturns)
    dated = o.where("vintage_date is not null").join(cut, ["variable", "frequency", "vintage_date"])
    undated = o.where("vintage_date is null").drop("vintage_date").join(cut, ["variable", "frequency"])
    out = dated.select(*SERIES, "date", "value", "last_obs").unionByName(undated.select(*SERIES, "date", "value", "last_obs")).where("date <= last_obs and value is not null")
    return out.where(F.col("date") > F.lit(start)) if start is not None else out


def random_walk(outturns: DataFrame, forecasts: DataFrame | None, metric: str = "levels", variables=None, frequency=None, periods: int = 13) -> DataFrame:
    """The last value seen, for every period ahead; all series in one query."""
    last = training(outturns, forecasts, metric, variables, frequency).groupBy(*SERIES).agg(F.max(F.struct("date", "value")).alias("m"))
    ahead = last.withColumn("forecast_horizon", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    return ahead.select(calendar.add_periods(F.col("m.date"), F.col("forecast_horizon") + 1, F.col("frequency")).alias("date"), *SERIES, F.col("m.value").alias("value"), F.lit(RANDOM_WALK).alias("source"), F.col("forecast_horizon").cast("int"))


# -- autoregression ---------------------------------------------------------------
def stationary(raw: np.ndarray) -> np.ndarray:
    """Coefficients within the stationary region from free numbers, one or two lags."""
    if len(raw) == 1:
        return np.array([0.99 * math.tanh(raw[0])])
    b = 0.99 * math.tanh(raw[1])
    bound = 1.0 - b
    return np.array([(2.0 / (1.0 + math.exp(-np.clip(raw[0], -50, 50))) - 1.0) * bound, b])


def _loss(free: np.ndarray, y: np.ndarray, x: np.ndarray, p: int) -> float:
    """Negative log likelihood of constant, raw coefficients, scale and degrees of freedom."""
    scale, nu = max(free[p + 1], SCALE_MIN), min(max(free[p + 2], NU_MIN), NU_MAX)
    r = (y - free[0] - x @ stationary(free[1 : p + 1])) / scale
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    return float(-(len(y) * (c - math.log(scale)) - (nu + 1) / 2 * np.log1p(r * r / nu).sum()))


def minimise(f, at: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float, bool]:
    """Projected BFGS with numeric gradients and backtracking."""
    x, n = np.clip(at, low, high), len(at)
    value, h = f(x), np.eye(n)

    def gradient(z):
        g = np.empty(n)
        for i in range(n):
            d = 1e-6 * max(1.0, abs(z[i]))
            up, down = z.copy(), z.copy()
            up[i], down[i] = min(z[i] + d, high[i]), max(z[i] - d, low[i])
            g[i] = (f(up) - f(down)) / max(up[i] - down[i], 1e-300)
        return g

    g = gradient(x)
    for _ in range(rounds):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not np.isfinite(value) or not free.any() or np.abs(g[free]).max() < 1e-6 * max(1.0, abs(value)):
            break
        d = np.where(free, -(h * np.outer(free, free)) @ np.where(free, g, 0.0), 0.0)
        if g @ d >= 0:
            h, d = np.eye(n), np.where(free, -g, 0.0)
        step, moved = 1.0, False
        for _ in range(40):
            z = np.clip(x + step * d, low, high)
            v = f(z)
            if np.isfinite(v) and v <= value + 1e-4 * g @ (z - x):
                moved = True
                break
            step /= 2
        if not moved or np.abs(z - x).max() < 1e-10 * max(1.0, np.abs(x).max()):
            if np.array_equal(h, np.eye(n)):
                break
            h = np.eye(n)
            if not moved:
                continue
        g2 = gradient(z)
        s, u = z - x, g2 - g
        if s @ u > 1e-12:
            rho = 1 / (s @ u)
            e = np.eye(n) - rho * np.outer(s, u)
            h = e @ h @ e.T + rho * np.outer(s, s)
        if value - v < 1e-11 * max(1.0, abs(value)):
            x, value = z, v
            break
        x, value, g = z, v, g2
    return x, value, bool(np.isfinite(value))


def fit_ar_t(y: np.ndarray, p: int) -> dict:
    """Maximum likelihood of an AR(p) with Student-t errors."""
    y = np.asarray(y, float)
    n = len(y)
    if n <= p + 1:
        return {"success": False}
    own, x = y[p:], np.column_stack([y[p - i - 1 : n - i - 1] for i in range(p)])
    ols = np.linalg.lstsq(np.column_stack([np.ones(n - p), x]), own, rcond=None)[0]
    scale = max(float(np.std(own - ols[0] - x @ ols[1:])), SCALE_MIN)
    low = np.array([-np.inf] * (p + 1) + [SCALE_MIN, NU_MIN])
    high = np.array([np.inf] * (p + 2) + [NU_MAX])
    best, value, ok = minimise(lambda q: _loss(q, own, x, p), np.concatenate([ols, [scale, 5.0]]), low, high)
    if not ok:
        return {"success": False}
    return {"success": True, "constant": float(best[0]), "ar_coeffs": stationary(best[1 : p + 1]), "scale": float(best[p + 1]), "df": float(best[p + 2]), "log_likelihood": -value, "bic": 2 * value + (p + 3) * math.log(n - p)}


def extend(y: np.ndarray, model: dict, steps: int) -> np.ndarray:
    """Conditional means ahead; the mean of y where the fit failed."""
    if not model.get("success"):
        return np.full(steps, float(np.mean(y)))
    phi, path = model["ar_coeffs"], list(map(float, y))
    for _ in range(steps):
        path.append(model["constant"] + sum(c * path[-1 - i] for i, c in enumerate(phi)))
    return np.array(path[len(y) :])


def choose(y: np.ndarray, max_lag: int) -> tuple[int, dict]:
    """The lag of least BIC (one where the series is short), and its fit."""
    if len(y) < LEAST_FOR_BIC or max_lag == 1:
        return 1, fit_ar_t(y, 1)
    fits = {p: fit_ar_t(y, p) for p in range(1, max_lag + 1)}
    good = {p: m for p, m in fits.items() if m["success"]}
    if not good:
        return 1, fits[1]
    p = min(good, key=lambda q: good[q]["bic"])
    return p, good[p]


def autoregression(outturns: DataFrame, forecasts: DataFrame | None, metric: str = "levels", variables=None, frequency=None, periods: int = 13, max_lag: int = 2, start=None) -> DataFrame:
    """One fit per series and vintage, each in a grouped pandas call over that series."""
    if max_lag not in (1, 2):
        raise ValueError("max_lag is 1 or 2")
    rows = training(outturns, forecasts, metric, variables, frequency, start)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["value"].to_numpy(float)
        p, model = choose(y, max_lag)
        values = extend(y, model, periods) if model["success"] else np.full(periods, y[-1])
        head = pdf.iloc[0]
        return pd.DataFrame({**{c: [head[c]] * periods for c in SERIES}, "last": [pdf["date"].iloc[-1]] * periods, "value": values, "optimal_lag": [p] * periods, "forecast_horizon": range(periods)})

    out = rows.groupBy(*SERIES).applyInPandas(fit, "variable string, metric string, frequency string, vintage_date date, last date, value double, optimal_lag int, forecast_horizon int")
    return out.select(calendar.add_periods("last", F.col("forecast_horizon") + 1, F.col("frequency")).alias("date"), *SERIES, "value", F.lit(AR).alias("source"), "forecast_horizon", "optimal_lag")
