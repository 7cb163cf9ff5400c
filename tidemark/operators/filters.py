"""Predicates over forecast, outturn and result tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

# Variable and metric of the standard report.
REPORT_VARIABLES = [("unemp", "levels"), ("cpisa", "yoy"), ("gdpkp", "yoy"), ("aweagg", "yoy")]


def strict_date(x: str | date | None) -> date | None:
    """A date, or a string in the form YYYY-MM-DD."""
    if x is None or (isinstance(x, date) and not isinstance(x, datetime)):
        return x
    if isinstance(x, datetime):
        return x.date()
    try:
        return datetime.strptime(x, "%Y-%m-%d").date()
    except (TypeError, ValueError) as e:
        raise ValueError(f"{x!r} is not a date in the form YYYY-MM-DD") from e


def listed(x) -> list | None:
    return None if x is None else [x] if isinstance(x, str | int) else list(x)


def filter_sources(df: DataFrame, sources: list[str], extra: Column | None = None) -> DataFrame:
    """Forecasters by label: at each place where a wanted label occurs, the other
    labels of that place are excluded; where none occurs anywhere, all are.

    The exclusion set is worked out over distinct ids in the same plan: nothing is
    collected. ``extra`` is a condition that keeps rows all the same.
    """
    wanted = F.col("_part").isin(listed(sources))
    named = df.select("unique_id").distinct()
    places = named.select("unique_id", F.posexplode(ids.parts()).alias("_pos", "_part"))
    hit = places.where(wanted).select("_pos").distinct()
    bad_parts = places.join(hit, "_pos", "left_semi").where(~wanted).select("_part").distinct()
    bad = places.join(bad_parts, "_part", "left_semi").select("unique_id").distinct()
    any_hit = hit.select(F.lit(1).alias("_one")).limit(1)
    good = named.join(bad, "unique_id", "left_anti").withColumn("_one", F.lit(1)).join(any_hit, "_one", "left_semi").select("unique_id")
    if extra is not None:
        good = good.unionByName(named.where(extra)).distinct()
    return df.join(good, "unique_id", "left_semi").select(*df.columns)


def filter_tables(
    df: DataFrame,
    start_date=None,
    end_date=None,
    start_vintage=None,
    end_vintage=None,
    variables=None,
    metrics=None,
    sources=None,
    frequencies=None,
    custom_filter: Callable[[DataFrame], DataFrame] | None = None,
    vintage: str = "vintage_date_forecast",
) -> DataFrame:
    """Inclusive bounds and value lists, as predicates that reach the scan.

    Sources with a ``+`` name whole ids; others are labels, see :func:`filter_sources`.
    A custom filter sees the vintage as ``vintage_date_forecast``; one that uses a
    column the table lacks does nothing.
    """
    for column, low, high in (("date", start_date, end_date), (vintage, start_vintage, end_vintage)):
        low, high = strict_date(low), strict_date(high)
        if low is not None:
            df = df.where(F.col(column) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(column) <= F.lit(high))
    for column, wanted in (("variable", variables), ("metric", metrics), ("frequency", frequencies)):
        if wanted is not None:
            df = df.where(F.col(column).isin(listed(wanted)))
    if sources is not None:
        whole = [s for s in listed(sources) if "+" in s]
        labels = [s for s in listed(sources) if "+" not in s]
        exact = F.col("unique_id").isin(whole) if whole else None
        df = filter_sources(df, labels, exact) if labels else df.where(exact)
    if custom_filter is not None:
        seen = df.withColumnRenamed(vintage, "vintage_date_forecast") if vintage != "vintage_date_forecast" else df
        try:
            out = custom_filter(seen)
            out.schema  # noqa: B018  resolves the plan, without a job
        except AnalysisException as e:
            if "UNRESOLVED_COLUMN" not in str(e):
                raise
            return df
        df = out.withColumnRenamed("vintage_date_forecast", vintage) if vintage != "vintage_date_forecast" else out
    return df


def covid_filter(df: DataFrame, vintage: str = "vintage_date_forecast") -> DataFrame:
    """Leaves out pandemic targets of forecasts made before they were known. The dates are fixed values."""
    d, v = F.col("date"), F.col(vintage)
    gdp = (d < "2020-01-01") | (d >= "2022-04-01") | (v >= "2022-01-01")
    other = (d < "2020-01-01") | (d > "2021-12-31") | (v >= "2020-10-01")
    return df.where(F.when(F.col("variable") == "gdpkp", gdp).otherwise(other))


def filter_report_variables(df: DataFrame) -> DataFrame:
    ok = F.lit(False)
    for v, m in REPORT_VARIABLES:
        ok = ok | ((F.col("variable") == v) & (F.col("metric") == m))
    return df.where(ok)


def filter_models(df: DataFrame, names: list[str]) -> DataFrame:
    """Forecasters by name, whatever the case."""
    return df.where(F.lower("unique_id").isin([n.lower() for n in names]))
