"""What each chart shows, as a DataFrame; drawing is optional.

``{name}_data`` gives the rows of chart ``name``; ``drawing`` draws them. Charts show a
few series, so their rows may go to the driver; the queries themselves stay distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import accuracy as acc
from ..operators import density, intra_period, maturity, revisions
from ..operators.filters import filter_sources, listed, strict_date


def _frame(x) -> DataFrame:
    return x.to_df() if hasattr(x, "to_df") else x.df if hasattr(x, "uses_intra_period_vintages") else x


def _pick(df: DataFrame, **wanted) -> DataFrame:
    for c, v in wanted.items():
        if v is not None and c in df.columns:
            df = df.where(F.col(c).isin(listed(v)))
    return df


# -- results --------------------------------------------------------------------
def accuracy_data(result, variable=None, metric=None, frequency=None, statistic: str = "rmse") -> DataFrame:
    return _pick(_frame(result), variable=variable, metric=metric, frequency=frequency).select("variable", "unique_id", "horizon", F.col(statistic).alias("value")).orderBy("unique_id", "horizon")


def compare_to_benchmark_data(result, benchmark_model: str, variable=None, metric=None, statistic: str = "rmse") -> DataFrame:
    ratio = acc.ratio_to(_pick(_frame(result), variable=variable, metric=metric), benchmark_model, statistic)
    return ratio.where(F.col("unique_id") != benchmark_model).select("variable", "unique_id", "horizon", F.col(f"{statistic}_to_benchmark").alias("value"))


def significance(df: DataFrame) -> DataFrame:
    """Class of each point: by the fluctuation flags where there are any, else by p."""
    if "reject_05" in df.columns:
        mark = F.when(F.col("reject_05"), "5%").when(F.col("reject_10"), "10%").otherwise("none")
    else:
        mark = F.when(F.col("p_value") < 0.05, "5%").when(F.col("p_value") < 0.10, "10%").otherwise("none")
    return df.withColumn("significance", mark)


def rolling_relative_accuracy_data(result, variable=None, horizon=None) -> DataFrame:
    return significance(_pick(_frame(result), variable=variable, horizon=horizon)).select("variable", "unique_id", "horizon", "window_end", "rmse_ratio", "significance").orderBy("window_end")


def bias_by_horizon_data(result, variable=None, source=None, metric=None) -> DataFrame:
    return _pick(_frame(result), variable=variable, unique_id=source, metric=metric).select("variable", "unique_id", "horizon", "bias_estimate", "ci_lower", "ci_upper").orderBy("horizon")


def rolling_bias_data(result, variable=None, source=None, horizon=None) -> DataFrame:
    return _pick(_frame(result), variable=variable, unique_id=source, horizon=horizon).select("variable", "unique_id", "horizon", "window_end", "bias_estimate", "ci_lower", "ci_upper").orderBy("window_end")


def blanchard_leigh_ratios_data(result) -> DataFrame:
    return _frame(result).select("horizon", "ratio", "ratio_ci_lower", "ratio_ci_upper").orderBy("horizon")


def strong_efficiency_data(result) -> DataFrame:
    return _frame(result).select("horizon", "ols_coefficient", "coeff_ci_lower", "coeff_ci_upper").orderBy("horizon")


def correlation_heatmap_data(result, names: list[str], variable=None, horizon=None) -> DataFrame:
    df = _pick(_frame(result), variable=variable, horizon=horizon)
    return df.groupBy("unique_id").pivot("unique_id_b", names).agg(F.avg("correlation")).orderBy("unique_id")


def rolling_correlation_data(result, anchor: str, variable=None, horizon=None) -> DataFrame:
    df = _pick(_frame(result), variable=variable, horizon=horizon)
    return df.where((F.col("unique_id") == anchor) & (F.col("unique_id_b") != anchor)).select("unique_id_b", "window_end", "correlation").orderBy("window_end")


def intra_period_accuracy_data(data, variable, metric, frequency, statistic: str = "rmse", k: int = 0, axis: str = "period_end", z: float = 1.959963984540054, **args) -> DataFrame:
    df = intra_period.accuracy(_frame(data), variable, metric, frequency, statistic=statistic, k=k, axis=axis, **args)
    return df.withColumns({"lower": F.col(statistic) - z * F.col("std_error"), "upper": F.col(statistic) + z * F.col("std_error")})


def intra_period_bias_data(data, variable, metric, frequency, k: int = 0, axis: str = "period_end", z: float = 1.959963984540054, **args) -> DataFrame:
    df = intra_period.bias(_frame(data), variable, metric, frequency, k=k, axis=axis, **args)
    return df.withColumns({"lower": F.col("bias") - z * F.col("std_error"), "upper": F.col("bias") + z * F.col("std_error")})


# -- main table --------------------------------------------------------------------
def moving(df: DataFrame, value: str, keys: list[str], order: list[str], width: int) -> DataFrame:
    """``moving_mean, moving_std`` over full windows of rows; a missing deviation is 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - width, 0)
    full = F.count(F.lit(1)).over(w) == width
    return df.withColumns({"moving_mean": F.when(full, F.avg(value).over(w)), "moving_std": F.when(full, F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)))})


def errors_across_time_data(data, variable=None, source=None, metric=None, horizon=None, k: int = 12, kind: str = "raw", width: int = 4) -> DataFrame:
    """Errors (raw, absolute or squared) over target dates with moving bands; the
    smallest horizon unless one is named."""
    df = maturity.with_horizon(maturity.filter_k(_pick(_frame(data), variable=variable, metric=metric, unique_id=source), k))
    keys = ["variable", "metric", "frequency", "unique_id"]
    if horizon is None:
        df = df.withColumn("_least", F.min("horizon").over(Window.partitionBy(*keys))).where("horizon = _least").drop("_least")
    else:
        df = df.where(F.col("horizon") == horizon)
    e = F.col("forecast_error")
    df = df.withColumn("error", {"raw": e, "absolute": F.abs(e), "squared": e * e}[kind])
    return moving(df.select(*keys, "horizon", "date", "vintage_date_forecast", "error"), "error", [*keys, "horizon"], ["date", "vintage_date_forecast"], width)


def forecast_errors_data(data, vintage, variable=None, source=None, metric=None, k: int = 12) -> DataFrame:
    df = maturity.filter_k(_pick(_frame(data), variable=variable, metric=metric, unique_id=source), k).where(F.col("vintage_date_forecast") == F.lit(strict_date(vintage)))
    w = Window.partitionBy("variable", "metric", "unique_id")
    return df.select("variable", "metric", "unique_id", "date", "forecast_error", F.avg("forecast_error").over(w).alias("mean_error")).orderBy("date")


def forecast_errors_by_horizon_data(data, variable=None, source=None, metric=None, k: int = 12) -> DataFrame:
    return acc.profile_by_horizon(maturity.with_horizon(maturity.filter_k(_pick(_frame(data), variable=variable, metric=metric, unique_id=source), k)))


def kde(df: DataFrame, value: str, keys: list[str], points: int = 200, reach: float = 3.0) -> DataFrame:
    """Gaussian density on a grid of each group, Scott's bandwidth.

    A group's grid is exploded from its own range, so every value meets ``points``
    grid points and no group meets another.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).where("n > 1 and sd > 0")
    stats = stats.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    stats = stats.withColumns({"lo": F.col("lo") - reach * F.col("h"), "hi": F.col("hi") + reach * F.col("h")})
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)))
    met = df.select(*keys, F.col(value).alias("_v")).join(stats, keys).withColumn("x", grid)
    u = (F.col("x") - F.col("_v")) / F.col("h")
    out = met.groupBy(*keys, "x").agg(F.avg(F.exp(-0.5 * u * u)).alias("_a"), F.first("h").alias("_h"), F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    return out.withColumn("density", F.col("_a") / (F.col("_h") * math.sqrt(2 * math.pi))).drop("_a", "_h")


def forecast_error_density_data(data, horizon: int, variable=None, metric=None, k: int = 12, points: int = 200) -> DataFrame:
    df = maturity.with_horizon(maturity.filter_k(_pick(_frame(data), variable=variable, metric=metric), k)).where(F.col("horizon") == horizon)
    return kde(df, "forecast_error", ["variable", "metric", "unique_id"], points)


def vintage_data(data, vintage, variable: str, metric: str, k: int = 12, sources=None) -> DataFrame:
    """One vintage's forecasts, outturns as known then, and later ones."""
    v = F.lit(strict_date(vintage))
    own = lambda d: d.where((F.col("variable") == variable) & (F.col("metric") == metric))
    f = own(data.forecasts).where(F.col("vintage_date") == v)
    if sources is not None:
        f = filter_sources(f, listed(sources))
    o = own(data.outturns)
    o = o.where(~F.col("_aligned")) if "_aligned" in o.columns else o
    known = o.where(F.col("vintage_date") == v).select("date", "value", F.lit("outturn at the vintage").alias("series"))
    wd = Window.partitionBy("date")
    fixed = F.max(F.when(F.col("target_minus_vintage") == -(k + 1), F.col("target_minus_vintage"))).over(wd)
    later = o.withColumn("_d", F.coalesce(fixed, F.min("target_minus_vintage").over(wd))).where("target_minus_vintage = _d").select("date", "value", F.lit("outturn").alias("series"))
    return f.select("date", "value", F.col("unique_id").alias("series")).unionByName(known).unionByName(later).orderBy("series", "date")


def nowcasts_data(data, target, variable: str, metric: str, k: int = 0) -> DataFrame:
    """Forecasts of one target over their vintages, with its outturn."""
    df = maturity.filter_k(data.df, k).where((F.col("variable") == variable) & (F.col("metric") == metric) & (F.col("date") == F.lit(strict_date(target))))
    return df.select("unique_id", "vintage_date_forecast", "value_forecast", "value_outturn").orderBy("unique_id", "vintage_date_forecast")


def hedgehog_data(data, variable: str, metric: str, source=None, releases: list[int] | None = None) -> DataFrame:
    """Forecast paths (distance 0 and up) and the distinct outturns, releases ranked."""
    f = _pick(data.forecasts, variable=variable, metric=metric, unique_id=source).where("target_minus_vintage >= 0")
    paths = f.select("date", "vintage_date", "unique_id", "value", F.lit("forecast").alias("kind"), F.lit(None).cast("int").alias("release"), F.lit(None).cast("double").alias("shade"))
    o = _pick(data.outturns, variable=variable, metric=metric)
    o = o.where(~F.col("_aligned")) if "_aligned" in o.columns else o
    w = Window.partitionBy("date")
    ranked = o.select("date", "vintage_date", "value").distinct().withColumn("release", F.dense_rank().over(w.orderBy("vintage_date")).cast("int"))
    ranked = ranked.withColumn("shade", F.try_divide((F.col("release") - 1).cast("double"), F.max("release").over(w) - 1))
    if releases is not None:
        ranked = ranked.where(F.col("release").isin([int(r) for r in releases]))
    return paths.unionByName(ranked.select("date", "vintage_date", F.lit(None).cast("string").alias("unique_id"), "value", F.lit("outturn").alias("kind"), "release", "shade"))


def outturn_revisions_data(data, variable=None, metric=None, k=(1, 2, 4, 8, 12), width: int = 4) -> DataFrame:
    """Revisions at each maturity, with moving bands."""
    r = _pick(revisions.outturn_revisions(data.outturns if hasattr(data, "outturns") else data), variable=variable, metric=metric)
    keys = ["date", "variable", "frequency", "metric"]
    each = r.withColumn("maturity", F.explode(F.array(*[F.lit(int(x)) for x in listed(k)])))
    w = Window.partitionBy(*keys, "maturity")
    lo = F.max(F.when(F.col("k") <= F.col("maturity"), F.col("k"))).over(w)
    hi = F.min(F.when(F.col("k") > F.col("maturity"), F.col("k"))).over(w)
    own = each.withColumn("_k", F.coalesce(lo, hi)).where("k = _k").select(*keys, "maturity", "revision")
    return moving(own, "revision", ["variable", "frequency", "metric", "maturity"], ["date"], width)


def outturns_data(data, variable=None, metric=None, k=(0, 12)) -> DataFrame:
    r = _pick(revisions.outturn_revisions(data.outturns if hasattr(data, "outturns") else data), variable=variable, metric=metric)
    each = r.withColumn("maturity", F.explode(F.array(*[F.lit(int(x)) for x in listed(k)])))
    w = Window.partitionBy("date", "variable", "frequency", "metric", "maturity")
    best = F.coalesce(F.max(F.when(F.col("k") <= F.col("maturity"), F.col("k"))).over(w), F.min(F.when(F.col("k") > F.col("maturity"), F.col("k"))).over(w))
    return each.withColumn("_k", best).where("k = _k").select("date", "variable", "metric", "frequency", "maturity", "value").orderBy("date")


def average_revision_by_period_data(data, variable=None, source=None, metric=None) -> DataFrame:
    return revisions.average_revision(_pick(data.forecasts if hasattr(data, "forecasts") else data, variable=variable, unique_id=source, metric=metric))


def normalised(df: DataFrame, spoke: str, value: str, keys: list[str]) -> DataFrame:
    """Min-max by spoke, 0.5 where all are equal; forecasters that lack a spoke go."""
    w = Window.partitionBy(*keys, spoke)
    spokes = df.groupBy(*keys).agg(F.count_distinct(spoke).alias("_all")) if keys else None
    have = df.groupBy(*keys, "unique_id").agg(F.count_distinct(spoke).alias("_n"))
    if spokes is not None:
        complete = have.join(spokes, keys).where("_n = _all").select(*keys, "unique_id")
    else:
        complete = have.withColumn("_all", F.max("_n").over(Window.partitionBy(F.lit(1)))).where("_n = _all").select("unique_id")
    df = df.join(complete, [*keys, "unique_id"], "left_semi")
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumns({"_lo": lo, "_hi": hi}).withColumn("score", F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def radar_data(stats, spokes=("rmse", "rmedse", "mean_abs_error"), horizon: int = 0) -> DataFrame:
    """Statistics as spokes of each variable, from an accuracy result at one horizon."""
    df = _frame(stats).where(F.col("horizon") == horizon)
    long = df.select("variable", "metric", "unique_id", F.explode(F.array(*[F.struct(F.lit(s).alias("spoke"), F.col(s).alias("value")) for s in spokes])).alias("s")).select("variable", "metric", "unique_id", "s.*")
    return normalised(long, "spoke", "value", ["variable", "metric"])


def density_vintage_data(data, vintage, variable: str, metric: str = "levels", quantiles=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """The quantiles nearest to those asked, of one vintage."""
    own = data.density_forecasts.where((F.col("variable") == variable) & (F.col("metric") == metric) & (F.col("vintage_date") == F.lit(strict_date(vintage))))
    out = None
    for q in quantiles:
        part = density.nearest_quantile(own, q).withColumn("wanted", F.lit(float(q)))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("unique_id", "date", "wanted")


#: Chart of each analysis; the others have none.
CHART = {
    "compute_accuracy_statistics": "accuracy",
    "bias_analysis": "bias_by_horizon",
    "strong_efficiency_analysis": "strong_efficiency",
    "blanchard_leigh_horizon_analysis": "blanchard_leigh_ratios",
    "forecast_errors_correlation_analysis": "correlation_heatmap",
}


def chart_of(result) -> str:
    """Name of the chart that shows a result."""
    name = result.metadata.get("test_name")
    if name in ("rolling_analysis", "fluctuation_tests"):
        cols = result.to_df().columns
        chart = "rolling_relative_accuracy" if "rmse_ratio" in cols else "rolling_bias" if "bias_estimate" in cols else "rolling_correlation" if "correlation" in cols else None
    else:
        chart = CHART.get(name)
    if chart is None:
        raise NotImplementedError(f"{name} has no chart")
    return chart


def of_result(result, **args) -> DataFrame:
    return globals()[f"{chart_of(result)}_data"](result, **args)
