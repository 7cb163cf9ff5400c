"""Pairing forecasts with releases and choosing one release: the main table's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar

PAIR = ["date", "variable", "frequency", "metric"]
SERIES = ["variable", "metric", "frequency", "unique_id", "date"]
GROUP = ["variable", "unique_id", "metric", "frequency", "horizon"]


def main_table(forecasts: DataFrame, outturns: DataFrame, id_columns: list[str], variables: list[str] | None = None, ids: list[str] | None = None, *, outturn_vintages: bool = True, calendar_k: bool = True) -> DataFrame:
    """Every forecast beside every release of its target, with maturity and error.

    Filters and column pruning reach both scans. The join is an equi-join on the
    target; forecasts of one target are at most (forecasters x vintages) and its
    releases a few, so its output is the size of the answer.
    """
    f, o = forecasts, outturns
    if variables is not None:
        f, o = f.where(F.col("variable").isin(variables)), o.where(F.col("variable").isin(variables))
    if ids is not None:
        f = f.where(F.col("unique_id").isin(ids))
    if "_aligned" in o.columns:  # copies made for transformations are no releases
        o = o.where(~F.col("_aligned"))
    labels = [c for c in id_columns if c in f.columns]
    f = f.select(*PAIR, F.col("vintage_date").alias("vintage_date_forecast"), F.col("value").alias("value_forecast"), "unique_id", "forecast_horizon", "target_minus_vintage", *labels)
    o = o.select(*PAIR, F.col("vintage_date").alias("vintage_date_outturn"), F.col("value").alias("value_outturn"))
    joined = f.join(o, PAIR)
    if outturn_vintages:
        joined = joined.withColumn("k", calendar.maturity("date", "vintage_date_outturn", F.col("frequency")))
        if calendar_k:
            joined = joined.where("k >= -1")
        latest = F.max("vintage_date_outturn").over(Window.partitionBy(*SERIES))
    else:
        joined = joined.withColumn("k", F.lit(0))
        latest = F.lit(None).cast("date")
    joined = joined.withColumn("latest_vintage", latest).withColumn("forecast_error", F.col("value_outturn") - F.col("value_forecast"))
    return joined.select(
        "date", "variable", "vintage_date_forecast", "vintage_date_outturn", "unique_id", "metric", "frequency", "forecast_horizon", "target_minus_vintage", "value_forecast", "value_outturn", "k", "latest_vintage", "forecast_error", *labels
    )


def filter_k(df: DataFrame, k: int = 12, fill: bool = True, extra: list[str] | None = None) -> DataFrame:
    """One maturity of each series: the largest k up to the one asked, else the smallest above.

    A series without release dates (``latest_vintage`` is null, a value of the whole
    series) keeps all its rows, with or without ``fill``; no separate job decides it.
    """
    undated = F.col("latest_vintage").isNull()
    if not fill:
        return df.where(undated | (F.col("k") == k))
    keys = [c for c in ("date", "variable", "frequency", "metric", "unique_id", "source") if c in df.columns] + (extra or [])
    w = Window.partitionBy(*keys)
    lo = F.max(F.when(F.col("k") <= k, F.col("k"))).over(w)
    hi = F.min(F.when(F.col("k") > k, F.col("k"))).over(w)
    return df.withColumns({"_lo": lo, "_hi": hi}).where(undated | (F.col("k") == F.coalesce("_lo", "_hi"))).drop("_lo", "_hi")


def common_sample(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rows whose (vintage, date) pair every forecaster of the group has.

    Groups are variables (and metrics); counts are two aggregations over distinct
    ids, so no id sets are gathered.
    """
    vintage = "vintage_date_forecast" if "vintage_date_forecast" in df.columns else "vintage_date"
    group = ["variable"] + (["metric"] if "metric" in df.columns else []) + (extra or [])
    pair = group + [vintage, "date"]
    each = df.select(*pair, "unique_id").distinct()
    all_ = df.select(*group, "unique_id").distinct().groupBy(*group).agg(F.count("*").alias("_all"))
    have = each.groupBy(*pair).agg(F.count("*").alias("_have")).join(all_, group).where(F.col("_have") == F.col("_all")).select(*pair)
    return df.join(have, pair, "left_semi").select(*df.columns)


def with_horizon(df: DataFrame) -> DataFrame:
    return df.withColumn("horizon", F.col("target_minus_vintage").cast("int"))


def analysis_sample(df: DataFrame, k: int, source=None, variable=None, same_date_range: bool = True, extra: list[str] | None = None) -> DataFrame:
    """The order in which analyses narrow the main table: maturity, exact ids, common
    sample, variables. The sample is common to the chosen forecasters, before the
    variables are chosen."""
    out = filter_k(with_horizon(df), k, extra=extra)
    if source is not None:
        out = out.where(F.col("unique_id").isin([source] if isinstance(source, str) else list(source)))
    if same_date_range:  # with one forecaster every row is common
        out = common_sample(out, extra)
    if variable is not None:
        out = out.where(F.col("variable").isin([variable] if isinstance(variable, str) else list(variable)))
    return out


def nowcast_k(outturn_side: DataFrame, keys: list[str]) -> DataFrame:
    """Maturity by release rank: 0, 1, ... from the target date on, -1, -2, ... back before it."""
    pre = F.col("vintage_date_outturn") < F.col("date")
    w = Window.partitionBy(*keys, pre)
    rank = F.when(pre, -F.dense_rank().over(w.orderBy(F.desc("vintage_date_outturn")))).otherwise(F.dense_rank().over(w.orderBy("vintage_date_outturn")) - 1)
    return outturn_side.withColumn("k", rank.cast("int"))
