"""Outturn vintages that were never published as such: snapshots for forecast vintages,
and pseudo vintages before the first one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from .filters import strict_date


def snapshots(outturns: DataFrame, forecasts: DataFrame) -> DataFrame:
    """For each forecast vintage without a release of its own in a series, what had
    been released by then: of each target date the latest release.

    Targets that the forecasts of that vintage cover are left out, and history goes
    back only as far as growth rates need. A vintage is expanded to the few target
    dates between that and the farthest ahead that any release was, so the as-of step
    is an equi-join on series and date, dealt by both, and an aggregate keeps the
    latest release; no release list is ever sorted.
    """
    o = outturns.where(~F.col("_aligned")).drop("_aligned") if "_aligned" in outturns.columns else outturns
    f = forecasts.select("variable", "date", "vintage_date", "frequency")
    distance = calendar.periods_between("date", "vintage_date", F.col("frequency"))
    reach = f.groupBy("variable").agg(F.min(distance).alias("_reach"))
    series = ["variable", "metric", "frequency"]
    names = o.groupBy(*series).agg(F.max(distance).alias("_ahead")).join(reach, "variable")
    # Every forecast vintage serves every series of a forecast variable: a row for both.
    vintages = f.agg(F.collect_set("vintage_date").alias("vs"))
    have = o.select(*series, F.col("vintage_date").alias("v")).distinct()
    need = names.join(vintages).withColumn("v", F.explode("vs")).drop("vs").join(have, [*series, "v"], "left_anti")
    back = F.col("_reach") - (calendar.periods_a_year(F.col("frequency")) + 1)
    need = need.where(back <= F.col("_ahead")).withColumn("_i", F.explode(F.sequence(back.cast("int"), F.col("_ahead").cast("int"))))
    need = need.select(*series, "v", calendar.add_periods("v", F.col("_i"), F.col("frequency")).alias("date"))
    targets = f.select("variable", F.col("vintage_date").alias("v"), "date").distinct()
    known = need.join(targets, ["variable", "v", "date"], "left_anti").join(o, [*series, "date"]).where(F.col("vintage_date") <= F.col("v"))
    latest = known.groupBy(*series, "v", "date").agg(F.max(F.struct("vintage_date", "value")).alias("m"))
    out = latest.select("date", F.col("v").alias("vintage_date"), "variable", "frequency", "metric", F.col("m.value").alias("value"))
    return out.withColumn("target_minus_vintage", calendar.periods_between("date", "vintage_date", F.col("frequency"))).withColumn("_aligned", F.lit(True))


def pseudo_vintages(outturns: DataFrame, fill_to, vintage_frequency: str = "Q", lags: dict[str, int] | None = None) -> DataFrame:
    """Rows of the first vintage as they would have stood at earlier period ends.

    A row is known from its publication on: its period end plus the variable's lag,
    which is the least seen in the first vintage or given.
    """
    fill_to = strict_date(fill_to)
    o = outturns
    if o.where("vintage_date is not null").isEmpty():  # all undated: known at the last date
        o = o.withColumn("vintage_date", F.lit(o.agg(F.max("date")).first()[0]))
    first = o.groupBy("variable").agg(F.min("vintage_date").alias("first"))  # a row per variable
    rows = o.join(first, "variable").where(F.col("vintage_date") == F.col("first"))
    lag = F.min(calendar.periods_between("first", "date", vintage_frequency)).over(Window.partitionBy("variable"))
    if lags:
        given = F.create_map(*[x for k, v in lags.items() for x in (F.lit(k), F.lit(int(v)))])
        lag = F.coalesce(F.try_element_at(given, F.col("variable")), lag)
    rows = rows.withColumn("_from", calendar.add_periods("date", lag, vintage_frequency))
    end = first.agg(F.max("first")).first()[0]
    if end is None or fill_to >= end:
        raise ValueError(f"fill_to ({fill_to}) must be before the latest first vintage ({end})")
    # Period ends from fill_to on; a row starts at its publication at the earliest.
    begin = F.greatest(F.col("_from"), F.lit(fill_to))
    steps = calendar.periods_between("first", begin, vintage_frequency)
    out = rows.where(steps >= 0).withColumn("_i", F.explode(F.sequence(F.lit(0), steps)))
    out = out.withColumn("vintage_date", calendar.add_periods(begin, F.col("_i"), vintage_frequency)).where((F.col("vintage_date") < F.col("first")) & (F.col("vintage_date") >= F.col("_from")))
    out = out.withColumn("target_minus_vintage", calendar.periods_between("date", "vintage_date", F.col("frequency")))
    return out.select(*outturns.columns)
