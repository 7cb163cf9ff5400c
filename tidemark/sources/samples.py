"""Small deterministic tables for examples and tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.distributions import normal_quantile

# Names, dates, sources and levels of the sample tables are part of their
# contract, since examples and tests refer to them.

def _frame(spark: SparkSession, df: pd.DataFrame) -> DataFrame:
    for c in ("date", "vintage_date"):
        df[c] = pd.to_datetime(df[c]).dt.date
    return spark.createDataFrame(df)


def _spark(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.getOrCreate()


def create_sample_outturns(spark: SparkSession | None = None) -> DataFrame:
    dates = pd.date_range("2022-03-31", periods=13, freq="QE")
    rows = [{"date": d, "variable": v, "vintage_date": "2025-09-30", "frequency": "Q", "value": 100.0 + i} for v in ("gdpkp", "cpisa") for i, d in enumerate(dates)]
    return _frame(_spark(spark), pd.DataFrame(rows))


def create_sample_forecasts(spark: SparkSession | None = None) -> DataFrame:
    dates = pd.date_range("2022-03-31", periods=13, freq="QE")
    rows = [{"date": d, "variable": "gdpkp", "vintage_date": "2025-03-31", "source": "mpr2", "frequency": "Q", "value": 100.0 + i, "forecast_horizon": i} for i, d in enumerate(dates)]
    return _frame(_spark(spark), pd.DataFrame(rows))


def create_sample_density_forecasts(spark: SparkSession | None = None) -> DataFrame:
    """Fifty quantiles of normal distributions whose means rise by one a quarter."""
    levels = [0.01 + 0.02 * i for i in range(50)]
    rows = [{"date": d, "variable": "gdpkp", "vintage_date": "2025-12-31", "source": "mpr2", "frequency": "Q", "quantile": q, "value": i + 1 + 0.5 * normal_quantile(q), "forecast_horizon": i} for i, d in enumerate(pd.date_range("2025-12-31", periods=13, freq="QE")) for q in levels]
    return _frame(_spark(spark), pd.DataFrame(rows))


def create_sample_nowcast_outturns(spark: SparkSession | None = None) -> DataFrame:
    """Two variables, 24 quarters, a first release and revisions up to March 2026."""
    rng, rows, last = np.random.default_rng(42), [], pd.Timestamp("2026-03-31")
    for variable, lag, step in (("gdp", 42, 3), ("cpi", 14, 1)):
        for d in pd.date_range("2020-03-31", periods=24, freq="QE"):
            value, release = 100 + rng.normal(0, 2), d + pd.Timedelta(days=lag)
            while release <= last:
                rows.append({"date": d, "variable": variable, "vintage_date": release, "frequency": "Q", "value": value})
                value, release = value + rng.normal(0, 0.1), release + pd.DateOffset(months=step)
    return _frame(_spark(spark), pd.DataFrame(rows))


def create_sample_nowcast_forecasts(spark: SparkSession | None = None) -> DataFrame:
    """Weekly vintages of two forecasters for the last, this and the next quarter."""
    rng, rows = np.random.default_rng(42), []
    for source in ("nowcast_dfm", "nowcast_bridge"):
        for variable in ("gdp", "cpi"):
            for v in pd.date_range("2020-01-01", "2026-03-31", freq="7D"):
                for offset in (-1, 0, 1):
                    d = (v.to_period("Q") + offset).end_time.normalize()
                    rows.append({"date": d, "variable": variable, "vintage_date": v, "source": source, "frequency": "Q", "value": 100 + rng.normal(0, 2), "forecast_horizon": max(offset, 0)})
    return _frame(_spark(spark), pd.DataFrame(rows))
