"""Growth rates of series, and levels back from growth rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar

SERIES = ["variable", "vintage_date", "frequency", "metric"]


def _ratio(a: Column, b: Column) -> Column:
    """a / b - 1 with IEEE results: infinite over a zero base, null for 0 / 0."""
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, infinite).otherwise(F.try_divide(a, b) - 1)


def transform_series(df: DataFrame, transform: str, keys: list[str] | None = None) -> DataFrame:
    """``levels``, ``diff``, ``pop`` or ``yoy`` of each series, by position in date order."""
    if transform == "levels":
        return df.withColumn("metric", F.lit("levels"))
    keys = keys or [c for c in ("variable", "vintage_date", "frequency", "unique_id", "quantile") if c in df.columns]
    w = Window.partitionBy(*keys).orderBy("date")
    if transform == "diff":
        value = F.col("value") - F.lag("value").over(w)
    elif transform == "pop":
        value = _ratio(F.col("value"), F.lag("value").over(w))
    elif transform == "yoy":
        back = F.when(F.col("frequency") == "Q", F.lag("value", 4).over(w)).when(F.col("frequency") == "M", F.lag("value", 12).over(w))
        value = _ratio(F.col("value"), back)
    else:
        raise ValueError(f"unknown transform {transform!r}")
    return df.withColumn("value", value).where("value is not null").withColumn("metric", F.lit(transform))


def _growth(df: DataFrame, keys: list[str]) -> DataFrame:
    """Levels, pop and yoy rows from one pass over the sorted series."""
    w = Window.partitionBy(*keys).orderBy("date")
    v = F.col("value")
    yoy_base = F.when(F.col("frequency") == "Q", F.lag("value", 4).over(w)).when(F.col("frequency") == "M", F.lag("value", 12).over(w))
    three = F.array(F.struct(F.lit("levels").alias("metric"), v.alias("value")), F.struct(F.lit("pop").alias("metric"), F.col("_pop").alias("value")), F.struct(F.lit("yoy").alias("metric"), F.col("_yoy").alias("value")))
    out = df.withColumns({"_pop": _ratio(v, F.lag("value").over(w)), "_yoy": _ratio(v, yoy_base)}).withColumn("_m", F.explode(three))
    return out.withColumns({"metric": F.col("_m.metric"), "value": F.col("_m.value")}).drop("_m", "_pop", "_yoy").where("value is not null")


def prepare_outturns(outturns: DataFrame) -> DataFrame:
    """Levels with their growth rates; other metrics pass through."""
    levels = _growth(outturns.where("metric = 'levels'"), ["variable", "vintage_date", "frequency"])
    return levels.unionByName(outturns.where("metric <> 'levels'"))


def last_observation(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, last_obs``: the last date observed before each vintage's first forecast,
    inferred from the least information horizon."""
    f = forecasts.groupBy(*keys, "frequency").agg(F.min(F.struct("forecast_horizon", "date")).alias("m"))
    return f.select(*keys, calendar.add_periods(F.col("m.date"), -(F.col("m.forecast_horizon") + 1), F.col("frequency")).alias("last_obs"))


def to_levels(outturns: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Forecasts in levels: own ones, and others rebuilt from growth on the outturns
    of the same vintage (undated outturns where the vintage has none).

    diff sums and pop multiplies up from the last observed level; yoy compounds on
    the level one year earlier, observed or rebuilt. Groups that already have levels
    keep them; groups without a base are left out. If a forecaster gives several
    growth metrics, the first in alphabetical order is used.
    """
    keys = [c for c in ("source", "variable", "frequency", "vintage_date", "unique_id") if c in forecasts.columns]
    own, other = forecasts.where("metric = 'levels'"), forecasts.where("metric <> 'levels'")
    have = own.select(*keys).distinct()
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    other = other.join(have, same(other, have), "left_anti")
    first = Window.partitionBy(*keys)
    other = other.withColumn("_first", F.min("metric").over(first)).where("metric = _first").drop("_first")
    last = last_observation(other, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "last_obs")
    other = other.join(last, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).drop(*[f"_{k}" for k in keys])

    # One row of history per (variable, vintage): period index -> level.
    o = outturns.where("metric = 'levels'").withColumn("p", calendar.period_index("date", F.col("frequency")))
    hist = o.groupBy("variable", "frequency", "vintage_date").agg(F.map_from_entries(F.collect_list(F.struct("p", "value"))).alias("hist"))
    dated = hist.where("vintage_date is not null")
    undated = hist.where("vintage_date is null").select("variable", "frequency", F.col("hist").alias("hist0"))
    other = other.join(dated, ["variable", "frequency", "vintage_date"], "left").join(undated, ["variable", "frequency"], "left")
    other = other.withColumn("hist", F.coalesce("hist", "hist0")).drop("hist0")
    other = other.withColumn("p", calendar.period_index("date", F.col("frequency"))).withColumn("p0", calendar.period_index("last_obs", F.col("frequency")))
    base_p = F.array_max(F.filter(F.map_keys("hist"), lambda x: x <= F.col("p0")))
    other = other.withColumn("base", F.element_at("hist", base_p))
    path = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.aggregate(F.collect_list("value").over(path), F.lit(1.0), lambda a, x: a * (1.0 + x))
    # yoy: this and every earlier rebuilt growth of the same season, on the last observed one.
    year = calendar.periods_a_year(F.col("frequency"))
    season = Window.partitionBy(*keys, F.pmod("p", year)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    chain = F.aggregate(F.collect_list("value").over(season), F.lit(1.0), lambda a, x: a * (1.0 + x))
    first_p = F.first("p").over(season)
    seasonal = F.try_element_at("hist", first_p - year)
    level = F.when(F.col("metric") == "diff", F.col("base") + F.sum("value").over(path)).when(F.col("metric") == "pop", F.col("base") * growth).when(F.col("metric") == "yoy", F.when(first_p - year <= F.col("p0"), seasonal) * chain)
    rebuilt = other.withColumn("_level", level)
    whole = Window.partitionBy(*keys)
    rebuilt = rebuilt.withColumn("_bad", F.max(F.col("_level").isNull()).over(whole)).where(~F.col("_bad"))
    rebuilt = rebuilt.withColumn("value", F.col("_level")).withColumn("metric", F.lit("levels")).select(*forecasts.columns)
    return own.unionByName(rebuilt)


def prepare_forecasts(forecasts: DataFrame, outturns: DataFrame, id_columns: list[str], compute_levels: bool = True, *, outturn_vintages: bool = True) -> DataFrame:
    """Levels, pop and yoy of all forecasts, growth spliced onto observed history.

    History of the same vintage goes before the forecasts of each forecaster, as far
    back as the longest growth rate needs; computed rates win over given ones.
    """
    other = forecasts.where("metric <> 'levels'")
    levels = to_levels(outturns, forecasts) if compute_levels else forecasts.where("metric = 'levels'")
    year = calendar.periods_a_year(F.col("frequency"))
    least = levels.groupBy("frequency").agg(F.min("target_minus_vintage").alias("_least"))  # two rows at most
    o = outturns.where("metric = 'levels'")
    if "_aligned" in o.columns:
        o = o.drop("_aligned")
    ids = levels.select("variable", "frequency", "vintage_date", "unique_id", *id_columns).distinct()
    if outturn_vintages:
        o = o.join(least, "frequency").where(F.col("target_minus_vintage").isNull() | (F.col("target_minus_vintage") >= F.col("_least") - (year + 1)))
        helper = o.select("date", "variable", "frequency", "vintage_date", "value").join(ids, ["variable", "frequency", "vintage_date"])
    else:
        # Undated outturns: the last year and one period before each vintage.
        o = o.select("date", "variable", "frequency", "value").join(ids, ["variable", "frequency"]).where("date < vintage_date")
        w = Window.partitionBy("variable", "frequency", "vintage_date", "unique_id").orderBy(F.desc("date"))
        helper = o.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= year + 1).drop("_n")
    helper = helper.withColumn("_helper", F.lit(True))
    spliced = levels.withColumn("_helper", F.lit(False)).unionByName(helper, allowMissingColumns=True)
    grown = _growth(spliced, ["variable", "vintage_date", "frequency", "unique_id"]).where("not _helper").drop("_helper")
    both = grown.withColumn("_given", F.lit(0)).unionByName(other.withColumn("_given", F.lit(1)))
    key = [c for c in forecasts.columns if c != "value"]
    w = Window.partitionBy(*key).orderBy("_given", "value")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_given").select(*forecasts.columns)
