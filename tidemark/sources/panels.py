"""Vintaged panels derived from the orders table, for the registered queries.

Quarterly: one variable per order priority; release k of a quarter sees six tenths
and k tenths more of its orders, so outturns are revised; three forecasters repeat or
average first releases. Monthly: one variable per order status, three releases, and
nowcasts that scale up what a month had by days 7, 14, 21 and 28.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders up to the end of the last complete quarter of the data."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    end = o.agg(F.trunc(F.date_add(F.max("o_orderdate").cast("date"), 1), "quarter").cast("timestamp").alias("_end"))
    return o.join(F.broadcast(end), F.col("o_orderdate") < F.col("_end")).drop("_end").withColumn("v", F.col("o_totalprice").cast("decimal(18,2)"))


def _releases(o: DataFrame, keys: list[str], base: int, n: int) -> DataFrame:
    """Sums of the orders each release sees: one aggregation, then one row per release."""
    sums = [F.sum(F.when(F.pmod("o_orderkey", F.lit(10)) < base + k, F.col("v")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias(f"r{k}") for k in range(n)]
    wide = o.groupBy(*keys).agg(*sums)
    return wide.select(*keys, F.posexplode(F.array(*[f"r{k}" for k in range(n)])).alias("k", "value"))


def quarterly_outturns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("variable"), calendar.period_end(F.col("o_orderdate").cast("date"), "Q").alias("date"), "o_orderkey", "v")
    r = _releases(o, ["variable", "date"], 6, 5).withColumn("value", F.sqrt("value"))  # off the lattice of cents: no ties when rounded
    return r.select("date", calendar.add_periods("date", F.col("k") + 1, "Q").alias("vintage_date"), "variable", F.lit("Q").alias("frequency"), "value")


def quarterly_forecasts(outturns: DataFrame) -> DataFrame:
    """Forecasters ``last``, ``mean4`` and ``mean8``, five periods ahead."""
    first = outturns.where(calendar.maturity("date", "vintage_date", "Q") == 0).select("variable", "date", "value")
    made = []
    for source, width, lag in (("last", 1, 1), ("mean4", 4, 1), ("mean8", 8, 2)):
        w = Window.partitionBy("variable").orderBy("date").rowsBetween(1 - width, 0)
        f = first.withColumns({"value": F.avg("value").over(w), "_n": F.count("*").over(w)}).where(F.col("_n") == width)
        made.append(f.select("variable", calendar.add_periods("date", lag, "Q").alias("vintage_date"), "value", F.lit(source).alias("source"), F.lit(lag).alias("_lag")))
    f = made[0].unionByName(made[1]).unionByName(made[2])
    f = f.join(first.select(F.col("date").alias("vintage_date")).distinct(), "vintage_date", "left_semi")
    f = f.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return f.select(calendar.add_periods("vintage_date", F.col("h"), "Q").alias("date"), "vintage_date", "variable", "source", F.lit("Q").alias("frequency"), (F.col("h") + F.col("_lag") - 1).cast("int").alias("forecast_horizon"), "value")


def monthly_outturns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select(F.col("o_orderstatus").alias("variable"), F.last_day(F.col("o_orderdate").cast("date")).alias("date"), "o_orderkey", "v")
    r = _releases(o, ["variable", "date"], 8, 3)
    return r.select("date", F.date_add("date", (14 + 30 * F.col("k")).cast("int")).alias("vintage_date"), "variable", F.lit("M").alias("frequency"), "value")


def monthly_nowcasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    o = _orders(spark, sf_dir).select(F.col("o_orderstatus").alias("variable"), F.last_day(d).alias("date"), F.day(d).alias("day"), "v")
    zero = F.lit(0).cast("decimal(18,2)")
    wide = o.groupBy("variable", "date").agg(*[F.sum(F.when(F.col("day") <= dd, F.col("v")).otherwise(zero)).cast("double").alias(f"s{dd}") for dd in (7, 14, 21, 28)], *[F.count_if(F.col("day") <= dd).alias(f"n{dd}") for dd in (7, 14, 21, 28)])
    each = F.array(*[F.struct(F.lit(dd).alias("day"), F.col(f"s{dd}").alias("s"), F.col(f"n{dd}").alias("n")) for dd in (7, 14, 21, 28)])
    f = wide.select("variable", "date", F.explode(each).alias("e")).where("e.n > 0")
    return f.select("date", F.make_date(F.year("date"), F.month("date"), F.col("e.day")).alias("vintage_date"), "variable", F.lit("part").alias("source"), F.lit("M").alias("frequency"), F.lit(0).alias("forecast_horizon"), (F.col("e.s") * F.day("date") / F.col("e.day")).alias("value"))


def quarterly_density(forecasts: DataFrame) -> DataFrame:
    """Nine quantiles around each forecast, a fan of two per cent a decile."""
    q = F.explode(F.array(*[F.lit(x / 10) for x in range(1, 10)]))
    return forecasts.withColumn("quantile", q).withColumn("value", F.col("value") * (1 + (F.col("quantile") - 0.5) * 0.2))
