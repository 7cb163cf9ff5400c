"""Quantile forecasts: growth, nearest quantile, sampling, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .transforms import _growth


def growth(density: DataFrame) -> DataFrame:
    """Levels, pop and yoy of each quantile's path."""
    keys = [c for c in density.columns if c not in ("value", "date", "forecast_horizon", "target_minus_vintage", "metric")]
    return _growth(density, keys)


def nearest_quantile(density: DataFrame, target: float = 0.5) -> DataFrame:
    """Rows of the quantile nearest to the target in each distribution, the lower of two."""
    keys = [c for c in density.columns if c not in ("value", "quantile")]
    w = Window.partitionBy(*keys)
    gap = F.abs(F.col("quantile") - target)
    return density.withColumn("_q", F.min(F.struct(F.round(gap, 12).alias("g"), "quantile")).over(w)["quantile"]).where("quantile = _q").drop("_q")


def to_point(density: DataFrame, method: str = "median") -> DataFrame:
    if method == "mean":
        raise NotImplementedError("only the median can be read from quantiles")
    if method != "median":
        raise ValueError("method is 'median'")
    return nearest_quantile(density, 0.5).drop("quantile")


def interpolate(xs: Column, ys: Column, at: Column) -> Column:
    """Piecewise linear through ascending points, flat beyond the ends."""
    n = F.size(xs)
    i = F.size(F.filter(xs, lambda v: v <= at))  # points at or below
    lo, hi = F.greatest(i, F.lit(1)), F.least(i + 1, n)
    x0, x1, y0, y1 = F.element_at(xs, lo), F.element_at(xs, hi), F.element_at(ys, lo), F.element_at(ys, hi)
    return F.when((i == 0) | (i == n) | (x1 == x0), y0).otherwise(y0 + (y1 - y0) * (at - x0) / (x1 - x0))


def distributions(density: DataFrame) -> DataFrame:
    """One row per distribution: its quantiles and values as ascending arrays."""
    keys = [c for c in density.columns if c not in ("value", "quantile")]
    pts = F.array_sort(F.collect_list(F.struct("quantile", "value")))
    return density.groupBy(*keys).agg(pts.alias("_p")).withColumns({"quantiles": F.transform("_p", lambda r: r["quantile"]), "values": F.transform("_p", lambda r: r["value"])}).drop("_p")


def sample(density: DataFrame, n: int = 10_000, seed: int = 0) -> DataFrame:
    """``n`` draws of each distribution by its inverse distribution function.

    Draw number i uses the same uniform in every distribution, a hash of (seed, i),
    so paths over horizons move together and reruns agree.
    """
    d = distributions(density).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "draw"), 11) + 0.5) / float(1 << 53)
    return d.withColumn("value", interpolate(F.col("quantiles"), F.col("values"), u)).drop("quantiles", "values")


def cdf(density: DataFrame, at: float | Column) -> DataFrame:
    """Probability below a value, of each distribution."""
    at = F.lit(float(at)) if isinstance(at, int | float) else at
    return distributions(density).withColumn("probability", interpolate(F.col("values"), F.col("quantiles"), at)).drop("quantiles", "values")
