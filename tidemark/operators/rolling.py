"""Analyses over rolling windows of vintages, and fluctuation tests on them.

All windows are one job: rows meet a small table of windows by a range of vintages,
and the window is one more key of every group, maturity choice and common sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import strict_date

WINDOW = ["window_start", "window_end"]

# Two-sided and one-sided critical values of the fluctuation test by mu,
# from table I of Giacomini and Rossi (2010).
MU = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
CRITICAL = {
    ("two-sided", 0.05): [3.393, 3.179, 3.012, 2.890, 2.779, 2.634, 2.560, 2.433, 2.248],
    ("two-sided", 0.10): [3.170, 2.948, 2.766, 2.626, 2.500, 2.356, 2.252, 2.130, 1.950],
    ("one-sided", 0.05): [3.176, 2.938, 2.770, 2.624, 2.475, 2.352, 2.248, 2.080, 1.975],
    ("one-sided", 0.10): [2.928, 2.676, 2.482, 2.334, 2.168, 2.030, 1.904, 1.740, 1.600],
}

#: Statistic of each analysis that a fluctuation test can use.
STATISTIC = {"dm": "dm_statistic", "bias": "t_statistic", "weak_efficiency": "joint_test_fstat"}


def critical_value(mu: float, alpha: float = 0.05, kind: str = "two-sided") -> float:
    """Linear in mu between the table's entries."""
    if not 0.1 <= mu <= 0.9:
        raise ValueError(f"the window must be 0.1 to 0.9 of the sample, not {mu}")
    return float(np.interp(mu, MU, CRITICAL[kind, alpha]))


def vintages(main: DataFrame, start=None, end=None) -> DataFrame:
    """Distinct forecast vintages, numbered from 0."""
    df = main.select(F.col("vintage_date_forecast").alias("v"))
    if start is not None:
        df = df.where(F.col("v") >= F.lit(strict_date(start)))
    if end is not None:
        df = df.where(F.col("v") <= F.lit(strict_date(end)))
    return df.distinct().withColumn("i", F.row_number().over(Window.orderBy("v")) - 1)  # a row per vintage


def windows(main: DataFrame, size: int, start=None, end=None) -> DataFrame:
    """``window_start, window_end``: as many as there are vintages, less ``size``; the
    last possible window is left out."""
    v = vintages(main, start, end)
    last = v.groupBy().agg(F.max("i").alias("m"))
    ends = v.select(F.col("v").alias("window_end"), (F.col("i") - (size - 1)).alias("i"))
    return v.join(ends, "i").join(last, F.col("i") + size <= F.col("m")).select(F.col("v").alias("window_start"), "window_end")


def in_windows(main: DataFrame, table: DataFrame) -> DataFrame:
    """Each row once for every window that holds its vintage (``size`` at most)."""
    held = main.select("vintage_date_forecast").distinct()
    held = held.join(table, (F.col("vintage_date_forecast") >= F.col("window_start")) & (F.col("vintage_date_forecast") <= F.col("window_end")))
    return main.join(held, "vintage_date_forecast")


def rolling(main: DataFrame, size: int, analysis, start=None, end=None, **args) -> DataFrame:
    """``analysis(main, extra=[...], **args)`` in every window, one job."""
    known = main.select("vintage_date_forecast").distinct()
    for name, x in (("start", start), ("end", end)):
        if x is not None and known.where(F.col("vintage_date_forecast") == F.lit(strict_date(x))).isEmpty():
            raise ValueError(f"{name} vintage {x} not found")
    table = windows(main, size, start, end)
    return analysis(in_windows(main, table), extra=WINDOW, **args)


def fluctuation(rolled: DataFrame, statistic: str, size: int, table: DataFrame) -> tuple[DataFrame, float]:
    """Absolute statistics against the critical values, their largest of each series,
    and mu. The number of windows is read from the ``table`` of windows, a small action
    over vintages; the analysis runs once."""
    n = table.count()
    if not n:
        raise ValueError("window too large for the vintages")
    mu = size / (n + size - 1)
    return flagged(rolled, statistic, critical_value(mu, 0.05), critical_value(mu, 0.10)), mu


def flagged(rolled: DataFrame, statistic: str, at_5: float, at_10: float) -> DataFrame:
    w = Window.partitionBy("variable", "metric", "frequency", "unique_id", "horizon")
    df = rolled.withColumn("test_statistic", F.abs(statistic)).withColumn("max_test_statistic", F.max("test_statistic").over(w))
    if statistic != "test_statistic":
        df = df.drop(statistic)
    df = df.withColumns({"critical_value_05": F.lit(at_5), "critical_value_10": F.lit(at_10)})
    return df.withColumns({f"reject{m}_{a}": F.col(f"{p}test_statistic") > F.col(f"critical_value_{a}") for m, p in (("", ""), ("_max", "max_")) for a in ("05", "10")})
