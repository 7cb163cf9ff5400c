"""Registered queries: each operator over whole derived panels, with SQL that gives
the same rows in DuckDB.

Panels come from ``orders`` (see ``sources.panels``); every query goes through the
library's operators, the SQL is written independently of them.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar, ids
from .operators import accuracy, benchmarks, bias, comparison, density, efficiency, filters, intra_period, maturity, revisions, rolling, transforms, vintages
from .plans import container, plot_data
from .sources import panels, schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# -- panels ------------------------------------------------------------------------
def raw_outturns(spark, sf_dir) -> DataFrame:
    return schema.with_distance(panels.quarterly_outturns(spark, sf_dir)).withColumn("metric", F.lit("levels"))


def raw_forecasts(spark, sf_dir) -> DataFrame:
    f = panels.quarterly_forecasts(panels.quarterly_outturns(spark, sf_dir))
    return schema.with_distance(f).withColumns({"metric": F.lit("levels"), "unique_id": ids.unique_id(["source"])})


def main_levels(spark, sf_dir, until: str | None = None) -> DataFrame:
    o = raw_outturns(spark, sf_dir)
    if until:
        o = o.where(F.col("vintage_date") <= F.lit(until).cast("date"))
    return maturity.main_table(raw_forecasts(spark, sf_dir), o, [])


def monthly(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = schema.with_distance(panels.monthly_outturns(spark, sf_dir)).withColumn("metric", F.lit("levels"))
    f = schema.with_distance(panels.monthly_nowcasts(spark, sf_dir)).withColumns({"metric": F.lit("levels"), "unique_id": ids.unique_id(["source"])})
    return o, f


def _day(p: str) -> str:
    """SQL: end of the quarter with index p."""
    return f"last_day(make_date(cast(({p}) // 4 as int), cast(({p}) % 4 as int) * 3 + 3, 1))"


OUTT = """
q as (select o_orderpriority as variable, year(o_orderdate)*4 + quarter(o_orderdate) - 1 as p, o_orderkey, cast(o_totalprice as decimal(18,2)) as v
      from orders where o_orderdate < timestamp '2001-07-01 00:00:00'),
rel as (select q.variable, q.p, r.k, sqrt(cast(sum(case when q.o_orderkey % 10 < 6 + r.k then q.v else 0 end) as double)) as value
        from q cross join (values (0),(1),(2),(3),(4)) as r(k) group by q.variable, q.p, r.k),
outt as (select variable, p as tp, p + k + 1 as vp, value from rel)"""
FC = """,
src as (select * from (values ('last', 1, 1), ('mean4', 4, 1), ('mean8', 8, 2)) as s(source, w, lag)),
base as (select o.variable, o.tp, o.value from outt o where o.vp = o.tp + 1),
fc0 as (select s.source, s.lag, b.variable, v.vp, avg(b.value) as fv, count(*) as n, max(s.w) as w
        from src s cross join (select distinct tp as vp from base) v
        join base b on b.tp <= v.vp - s.lag and b.tp > v.vp - s.lag - s.w
        group by s.source, s.lag, b.variable, v.vp),
fc as (select f.source as unique_id, f.variable, f.vp, f.vp + h.h as tp, h.h as horizon, h.h + f.lag - 1 as forecast_horizon, f.fv
       from fc0 f cross join (values (0),(1),(2),(3),(4)) as h(h) where f.n = f.w)"""


def _main(until: str = "true") -> str:
    return f""",
main as (select f.unique_id, f.variable, f.tp, f.vp as vintage_forecast, o.vp as vintage_outturn, f.horizon, f.forecast_horizon, o.vp - o.tp - 1 as k,
         f.fv as value_forecast, o.value as value_outturn, o.value - f.fv as forecast_error, max(o.vp) over (partition by f.variable, f.unique_id, f.tp) as latest
         from fc f join outt o on f.variable = o.variable and f.tp = o.tp where o.vp - o.tp - 1 >= -1 and {until})"""


def _fk(k: int = 12) -> str:
    return f""",
mk as (select *, max(case when k <= {k} then k end) over (partition by tp, variable, unique_id) as lo,
       min(case when k > {k} then k end) over (partition by tp, variable, unique_id) as hi from main),
fk as (select * from mk where k = coalesce(lo, hi))"""


COMMON = """,
nall as (select variable, count(distinct unique_id) as n_all from fk group by variable),
have as (select variable, vintage_forecast, tp, count(distinct unique_id) as n from fk group by variable, vintage_forecast, tp),
cs as (select fk.* from fk join have using (variable, vintage_forecast, tp) join nall using (variable) where n = n_all)"""
BASE = "with" + OUTT + FC + _main() + _fk() + COMMON
BY = "variable, unique_id, horizon"


# -- calendar, keys, checks ----------------------------------------------------------
@query("""
select o_orderkey, last_day(make_date(year(o_orderdate), cast(quarter(o_orderdate) * 3 as int), 1)) as quarter_end, last_day(cast(o_orderdate as date)) as month_end,
  cast(date_diff('day', date_trunc('quarter', cast(o_orderdate as date)), cast(o_orderdate as date)) as int) as day_of_quarter,
  cast((1998 * 4 + 2) - (year(o_orderdate) * 4 + quarter(o_orderdate)) as int) as target_minus_vintage from orders
""")
def period_end_snap(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return o.select("o_orderkey", calendar.period_end("d", "Q").alias("quarter_end"), calendar.period_end("d", "M").alias("month_end"), calendar.days_in_period("d", "Q").alias("day_of_quarter"), calendar.periods_between(F.lit("1998-06-30").cast("date"), "d", "Q").alias("target_minus_vintage"))


@query(f"with{OUTT} select {_day('tp')} as date, {_day('vp')} as vintage_date, variable, 'Q' as frequency, value, cast(tp - vp as int) as target_minus_vintage from outt")
def validated_outturns(spark, sf_dir):
    """Schema check, coercion from strings, period ends and distance."""
    text = panels.quarterly_outturns(spark, sf_dir).withColumn("date", F.col("date").cast("string")).withColumn("noise", F.lit(1))
    return schema.with_distance(schema.validate(text, schema.fields(False)))


@query(f"""with{OUTT}{FC} select unique_id, variable, {_day('vp')} as vintage_date, {_day('tp')} as date, fv as value from fc where vp >= 4*1999""")
def exclude_existing(spark, sf_dir):
    """Anti-join of new rows with those that are there, null-safe over shared keys."""
    f = raw_forecasts(spark, sf_dir)
    return container.fresh_rows(f, f.where("vintage_date < date'1999-01-01'")).select("unique_id", "variable", "vintage_date", "date", "value")


def _late(spark, sf_dir, quarters: int) -> DataFrame:
    """The forecasts as if made some quarters later."""
    f = raw_forecasts(spark, sf_dir).withColumn("vintage_date", calendar.add_periods("vintage_date", quarters, "Q"))
    return schema.with_distance(f)


@query(f"""with{OUTT}{FC} select f.unique_id as source, f.variable, 'levels' as metric, 'Q' as frequency, count(distinct f.vp * 100000 + f.tp) as n
from fc f join outt o on f.variable = o.variable and f.tp = o.tp where f.forecast_horizon = 0 and o.vp <= f.vp + 2 group by 1, 2""")
def published_targets(spark, sf_dir):
    """Data check A: targets at horizon 0 of forecasts stamped two quarters late had been published."""
    return container.published_targets(_late(spark, sf_dir, 2), raw_outturns(spark, sf_dir))


@query(f"""with{OUTT}{FC}, p as (select f.unique_id, f.variable, f.fv, o.value from fc f join outt o on o.variable = f.variable and o.tp = f.tp and o.vp = f.vp + 1 where f.tp = f.vp)
select unique_id as source, variable, 'levels' as metric, count(*) as n, round(avg(abs(fv - value)), 4) as gap, round(stddev_samp(value), 4) as sd, count(*) >= 2 and avg(abs(fv - value)) > 0.5 * stddev_samp(value) as far from p group by 1, 2""")
def values_near_outturns(spark, sf_dir):
    """Data check B, of forecasts stamped a quarter late."""
    return rounded(container.values_near_outturns(_late(spark, sf_dir, 1), raw_outturns(spark, sf_dir)), 4, "gap", "sd")


@query(f"""with{OUTT}{FC}, last as (select variable, tp, max_by(value, vp) as o from outt group by 1, 2), p as (select f.unique_id, f.variable, f.fv * case when f.variable = '5-LOW' then 10 else 1 end as fv, l.o from fc f join last l using (variable, tp)),
s as (select unique_id, variable, count(*) as n, quantile_cont(fv, 0.75) - quantile_cont(fv, 0.25) as a, quantile_cont(o, 0.75) - quantile_cont(o, 0.25) as b from p group by 1, 2)
select unique_id as source, variable, 'levels' as metric, n, round(a, 4) as a, round(b, 4) as b, n >= 3 and a > 0 and b > 0 and greatest(a / b, b / a) > 5 as apart from s""")
def spreads_beside_outturns(spark, sf_dir):
    """Data check C; one variable's forecasts are ten times too large."""
    f = raw_forecasts(spark, sf_dir).withColumn("value", F.col("value") * F.when(F.col("variable") == "5-LOW", 10).otherwise(1))
    return rounded(container.spreads_beside_outturns(f, raw_outturns(spark, sf_dir)), 4, "a", "b")


# -- growth and levels ---------------------------------------------------------------
@query(f"""with{OUTT}, w as (select variable, tp, vp, value, lag(value) over s as v1, lag(value, 4) over s as v4 from outt window s as (partition by variable, vp order by tp))
select {_day('tp')} as date, {_day('vp')} as vintage_date, variable, metric, round(value, 6) as value from (
  select variable, tp, vp, 'levels' as metric, value from w union all
  select variable, tp, vp, 'pop', value / v1 - 1 from w where v1 is not null union all
  select variable, tp, vp, 'yoy', value / v4 - 1 from w where v4 is not null) t""")
def prepare_outturns(spark, sf_dir):
    return rounded(transforms.prepare_outturns(raw_outturns(spark, sf_dir)), 6, "value").select("date", "vintage_date", "variable", "metric", "value")


@query(f"""with{OUTT}{FC},
spl as (select variable, vp, tp, unique_id, fv as value, 0 as helper from fc
  union all select o.variable, o.vp, o.tp, i.unique_id, o.value, 1 from outt o join (select distinct variable, vp, unique_id from fc) i on i.variable = o.variable and i.vp = o.vp),
w as (select *, lag(value) over s as v1, lag(value, 4) over s as v4 from spl window s as (partition by variable, vp, unique_id order by tp))
select unique_id, variable, {_day('vp')} as vintage_date, {_day('tp')} as date, metric, round(value, 6) as value from (
  select unique_id, variable, vp, tp, 'levels' as metric, value, helper from w union all
  select unique_id, variable, vp, tp, 'pop', value / v1 - 1, helper from w where v1 is not null union all
  select unique_id, variable, vp, tp, 'yoy', value / v4 - 1, helper from w where v4 is not null) t where helper = 0""")
def prepare_forecasts(spark, sf_dir):
    """Growth of forecasts spliced onto the same vintage's outturns."""
    out = transforms.prepare_forecasts(raw_forecasts(spark, sf_dir), raw_outturns(spark, sf_dir), ["source"])
    return rounded(out, 6, "value").select("unique_id", "variable", "vintage_date", "date", "metric", "value")


@query(f"""with{OUTT}, w as (select variable, tp, vp, value - lag(value) over (partition by variable, vp order by tp) as d from outt)
select {_day('tp')} as date, {_day('vp')} as vintage_date, variable, 'diff' as metric, round(d, 6) as value from w where d is not null""")
def differences(spark, sf_dir):
    return rounded(transforms.transform_series(raw_outturns(spark, sf_dir), "diff"), 6, "value").select("date", "vintage_date", "variable", "metric", "value")


def _levels(spark, sf_dir, metric: str, value) -> DataFrame:
    f = raw_forecasts(spark, sf_dir).withColumns({"metric": F.lit(metric), "value": value})
    return rounded(transforms.to_levels(raw_outturns(spark, sf_dir), f), 3, "value").select("unique_id", "variable", "vintage_date", "date", "value")


_BASE_LEVEL = "b as (select f.*, o.value as base from fc f join outt o on o.variable = f.variable and o.vp = f.vp and o.tp = f.tp - f.forecast_horizon - 1)"


@query(f"""with{OUTT}{FC}, {_BASE_LEVEL}
select unique_id, variable, {_day('vp')} as vintage_date, {_day('tp')} as date, round(base * product(1 + 0.01 * (horizon + 1)) over (partition by unique_id, variable, vp order by tp), 3) as value from b""")
def levels_from_pop(spark, sf_dir):
    return _levels(spark, sf_dir, "pop", 0.01 * (F.col("target_minus_vintage") + 1))


@query(f"""with{OUTT}{FC}, {_BASE_LEVEL}
select unique_id, variable, {_day('vp')} as vintage_date, {_day('tp')} as date, round(base + sum(10.0 * (horizon + 1)) over (partition by unique_id, variable, vp order by tp), 3) as value from b""")
def levels_from_diff(spark, sf_dir):
    return _levels(spark, sf_dir, "diff", 10.0 * (F.col("target_minus_vintage") + 1))


@query(f"""with{OUTT}{FC}, y as (select f.*, o.value as base from fc f join outt o on o.variable = f.variable and o.vp = f.vp and o.tp = f.vp + f.horizon % 4 - 4 and o.tp <= f.tp - f.forecast_horizon - 1),
ok as (select unique_id, variable, vp from y group by 1, 2, 3 having count(*) = 5)
select unique_id, variable, {_day('vp')} as vintage_date, {_day('tp')} as date, round(base * product(1 + 0.02 * (horizon + 1)) over (partition by unique_id, variable, vp, horizon % 4 order by tp), 3) as value
from y join ok using (unique_id, variable, vp)""")
def levels_from_yoy(spark, sf_dir):
    return _levels(spark, sf_dir, "yoy", 0.02 * (F.col("target_minus_vintage") + 1))


# -- main table and filters ------------------------------------------------------------
_MAIN_OUT = f"{_day('tp')} as date, variable, {_day('vintage_forecast')} as vintage_date_forecast, {_day('vintage_outturn')} as vintage_date_outturn, unique_id, cast(horizon as int) as target_minus_vintage, cast(forecast_horizon as int) as forecast_horizon, cast(k as int) as k, {_day('latest')} as latest_vintage, round(value_forecast, 2) as value_forecast, round(value_outturn, 2) as value_outturn, round(forecast_error, 2) as forecast_error"


def _main_out(df: DataFrame) -> DataFrame:
    keep = ["date", "variable", "vintage_date_forecast", "vintage_date_outturn", "unique_id", "target_minus_vintage", "forecast_horizon", "k", "latest_vintage", "value_forecast", "value_outturn", "forecast_error"]
    return rounded(df, 2, "value_forecast", "value_outturn", "forecast_error").select(*keep)


@query("with" + OUTT + FC + _main() + f" select {_MAIN_OUT} from main")
def main_table(spark, sf_dir):
    return _main_out(main_levels(spark, sf_dir))


@query("with" + OUTT + FC + _main("o.vp <= 4*2000+3") + _fk(2) + f" select {_MAIN_OUT} from fk")
def filter_k_fill(spark, sf_dir):
    return _main_out(maturity.filter_k(main_levels(spark, sf_dir, "2000-12-31"), 2))


@query("with" + OUTT + FC + _main() + f" select {_MAIN_OUT} from main where k = 2")
def filter_k_exact(spark, sf_dir):
    return _main_out(maturity.filter_k(main_levels(spark, sf_dir), 2, fill=False))


@query("with" + OUTT + FC + f""" select f.unique_id, f.variable, {_day('f.tp')} as date, {_day('f.vp')} as vintage_date_forecast, round(o.value - f.fv, 2) as forecast_error from fc f join outt o on o.variable = f.variable and o.tp = f.tp and o.vp = o.tp + 1""")
def filter_k_undated(spark, sf_dir):
    """Outturns without release dates: no maturity is asked of them, exact or not."""
    first = raw_outturns(spark, sf_dir).where(calendar.maturity("date", "vintage_date", "Q") == 0).withColumn("vintage_date", F.lit(None).cast("date"))
    main = maturity.main_table(raw_forecasts(spark, sf_dir), first, [], outturn_vintages=False)
    out = maturity.filter_k(maturity.filter_k(main, 12, fill=False), 3)
    return rounded(out, 2, "forecast_error").select("unique_id", "variable", "date", "vintage_date_forecast", "forecast_error")


@query("with" + OUTT + FC + _main() + f" select {_MAIN_OUT} from main where tp between 4*1998 and 4*1999+3 and vintage_forecast >= 4*1997+2 and variable in ('1-URGENT', '5-LOW') and unique_id = 'mean4'")
def filter_tables(spark, sf_dir):
    return _main_out(filters.filter_tables(main_levels(spark, sf_dir), "1998-01-01", "1999-12-31", start_vintage="1997-09-30", variables=["1-URGENT", "5-LOW"], sources=["mean4"]))


@query("with" + OUTT + FC + _main() + """ select variable, unique_id || ' + ' || substr(variable, 1, 1) as unique_id, count(*) as n from main
where unique_id in ('last', 'mean8') and substr(variable, 1, 1) = '2' group by 1, 2""")
def filter_sources(spark, sf_dir):
    """Labels at two places of the id: each place with a wanted label is narrowed."""
    df = main_levels(spark, sf_dir).withColumn("label", F.substring("variable", 1, 1)).withColumnRenamed("unique_id", "source")
    df = df.withColumn("unique_id", ids.unique_id(["source", "label"]))
    return filters.filter_sources(df, ["last", "mean8", "2"]).groupBy("variable", "unique_id").agg(F.count("*").alias("n"))


@query("with" + OUTT + FC + _main() + f""", s as (select unique_id, case when variable = '1-URGENT' then 'gdpkp' else variable end as variable, {_day('tp + 92')} as date, {_day('vintage_forecast + 92')} as vintage_date_forecast, forecast_error from main)
select unique_id, variable, count(*) as n from s where case when variable = 'gdpkp' then date < date '2020-01-01' or date >= date '2022-04-01' or vintage_date_forecast >= date '2022-01-01'
else date < date '2020-01-01' or date > date '2021-12-31' or vintage_date_forecast >= date '2020-10-01' end group by 1, 2""")
def covid_filter(spark, sf_dir):
    """The panel 23 years on, so that it spans the pandemic."""
    later = lambda c: calendar.add_periods(c, 92, "Q")
    df = main_levels(spark, sf_dir).withColumns({"date": later("date"), "vintage_date_forecast": later("vintage_date_forecast"), "variable": F.when(F.col("variable") == "1-URGENT", "gdpkp").otherwise(F.col("variable"))})
    return filters.covid_filter(df).groupBy("unique_id", "variable").agg(F.count("*").alias("n"))


@query(BASE + f" select {_MAIN_OUT} from cs")
def common_sample(spark, sf_dir):
    return _main_out(maturity.common_sample(maturity.filter_k(main_levels(spark, sf_dir), 12)))


# -- accuracy --------------------------------------------------------------------------
_ACC = f"""acc as (select {BY}, count(*) as n_observations, avg(forecast_error*forecast_error) as mse, sqrt(avg(forecast_error*forecast_error)) as rmse, sqrt(median(forecast_error*forecast_error)) as rmedse,
 avg(abs(forecast_error)) as mean_abs_error, min(vintage_forecast) as v0, max(vintage_forecast) as v1 from cs group by {BY})"""


@query(BASE + ", " + _ACC + f" select variable, unique_id, cast(horizon as int) as horizon, n_observations, round(rmse, 2) as rmse, round(rmedse, 2) as rmedse, round(mean_abs_error, 2) as mean_abs_error, {_day('v0')} as start_date, {_day('v1')} as end_date from acc")
def accuracy_k12(spark, sf_dir):
    out = rounded(accuracy.accuracy(main_levels(spark, sf_dir), 12), 2, "rmse", "rmedse", "mean_abs_error")
    return out.select("variable", "unique_id", "horizon", "n_observations", "rmse", "rmedse", "mean_abs_error", "start_date", "end_date")


@query(BASE + ", " + _ACC + " select a.variable, a.unique_id, cast(a.horizon as int) as horizon, round(a.rmse / b.rmse, 6) as rmse_to_benchmark from acc a join acc b on a.variable = b.variable and a.horizon = b.horizon and b.unique_id = 'last'")
def compare_to_benchmark(spark, sf_dir):
    out = accuracy.ratio_to(accuracy.accuracy(main_levels(spark, sf_dir), 12), "last", "rmse")
    return rounded(out, 6, "rmse_to_benchmark").select("variable", "unique_id", "horizon", "rmse_to_benchmark")


@query(BASE + ", " + _ACC + """, r as (select a.unique_id, a.horizon, round(a.rmse / b.rmse, 6) as x from acc a join acc b on a.variable = b.variable and a.horizon = b.horizon and b.unique_id = 'last' where a.variable = '1-URGENT' and a.unique_id <> 'last')
select unique_id, max(case when horizon = 0 then x end) as "0", max(case when horizon = 1 then x end) as "1", max(case when horizon = 4 then x end) as "4" from r group by 1""")
def comparison_table(spark, sf_dir):
    out = accuracy.comparison_table(accuracy.accuracy(main_levels(spark, sf_dir), 12), "1-URGENT", "levels", "last", horizons=[0, 1, 4])
    return rounded(out, 6, "0", "1", "4")


@query("with" + OUTT + FC + _main() + _fk() + f" select variable, unique_id, cast(horizon as int) as horizon, round(avg(forecast_error), 2) as mean_error, round(stddev_samp(forecast_error), 2) as std_error, count(*) as n_observations from fk group by {BY}")
def error_profile_by_horizon(spark, sf_dir):
    out = accuracy.profile_by_horizon(maturity.with_horizon(maturity.filter_k(main_levels(spark, sf_dir), 12)))
    return rounded(out, 2, "mean_error", "std_error").select("variable", "unique_id", "horizon", "mean_error", "std_error", "n_observations")


# -- robust inference ---------------------------------------------------------------------
def _hac(source: str, value: str, keys: str, order: str = "tp, vintage_forecast") -> str:
    """Common tables: demeaned series g, sums of squares s0 and weighted lags sl."""
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
g as (select {keys}, {value} - avg({value}) over w as u, row_number() over (partition by {keys} order by {order}) as rn, max(forecast_horizon) over w as L, {value} as y from {source} window w as (partition by {keys})),
s0 as (select {keys}, max(L) as L, count(*) as n, avg(y) as est, sum(u*u) as s0 from g group by {keys}),
sl as (select {', '.join('a.' + k.strip() for k in keys.split(','))}, sum(a.u * b.u) as s1, sum((1.0 - (a.rn - b.rn) / (a.L + 1.0)) * a.u * b.u) as s2
  from g a join g b on {on} and a.rn > b.rn and a.rn - b.rn <= a.L group by {', '.join('a.' + k.strip() for k in keys.split(','))})"""


@query(BASE + "," + _hac("cs", "forecast_error", BY) + f""" select variable, unique_id, cast(horizon as int) as horizon, n as n_observations, cast(L as int) as hac_maxlags, round(est, 2) as bias_estimate,
 round(sqrt(s0.s0 + 2 * coalesce(s2, 0)) / n, 2) as std_error, round(est / (sqrt(s0.s0 + 2 * coalesce(s2, 0)) / n), 4) as t_statistic from s0 left join sl using ({BY})""")
def bias_hac(spark, sf_dir):
    out = rounded(rounded(bias.bias_statistics(main_levels(spark, sf_dir)), 2, "bias_estimate", "std_error"), 4, "t_statistic")
    return out.select("variable", "unique_id", "horizon", "n_observations", "hac_maxlags", "bias_estimate", "std_error", "t_statistic")


@query(BASE + "," + _hac("cs", "forecast_error", BY) + f""", t as (select variable, unique_id, cast(horizon as int) as horizon, est, sqrt(s0.s0 + 2 * coalesce(s2, 0)) / n as se from s0 left join sl using ({BY}))
select variable, unique_id, horizon, round(est - 1.959963984540054 * se, 2) as ci_lower, round(est + 1.959963984540054 * se, 2) as ci_upper, case when abs(est / se) > 1.959963984540054 then 'Biased' else 'Unbiased' end as bias_conclusion,
 abs(est / se) > 2.5758293035489004 as below_01, abs(est / se) > 1.6448536269514722 as below_10 from t""")
def bias_table(spark, sf_dir):
    """SQL has no normal distribution: its critical values bracket the p-values at 1, 5 and 10 %."""
    out = bias.bias_table(main_levels(spark, sf_dir))
    out = out.withColumns({"below_01": F.col("p_value") < 0.01, "below_10": F.col("p_value") < 0.10})
    return rounded(out, 2, "ci_lower", "ci_upper").select("variable", "unique_id", "horizon", "ci_lower", "ci_upper", "bias_conclusion", "below_01", "below_10")


_MZ = f""", m as (select {BY}, value_forecast as x, value_outturn as y, tp, vintage_forecast, max(forecast_horizon) over (partition by {BY}) as L from cs),
b as (select {BY}, count(*) as n, max(L) as L, regr_slope(y,x) as b1, regr_intercept(y,x) as b0, avg(x) as mx, sum(x) as sx, sum(x*x) as sxx, regr_sxx(y, x) as dxx from m group by {BY}),
r as (select m.variable, m.unique_id, m.horizon, b.L, row_number() over (partition by m.variable, m.unique_id, m.horizon order by m.tp, m.vintage_forecast) as rn, m.y - b.b0 - b.b1*m.x as g0, (m.y - b.b0 - b.b1*m.x)*(m.x - b.mx) as g1
   from m join b using ({BY})),
z0 as (select {BY}, sum(g0*g0) as a00, sum(g0*g1) as a01, sum(g1*g1) as a11 from r group by {BY}),
zl as (select a.variable, a.unique_id, a.horizon, sum((1.0-(a.rn-c.rn)/(a.L+1.0))*2*a.g0*c.g0) as c00, sum((1.0-(a.rn-c.rn)/(a.L+1.0))*(a.g0*c.g1+a.g1*c.g0)) as c01, sum((1.0-(a.rn-c.rn)/(a.L+1.0))*2*a.g1*c.g1) as c11
   from r a join r c on a.variable=c.variable and a.unique_id=c.unique_id and a.horizon=c.horizon and a.rn>c.rn and a.rn-c.rn<=a.L group by a.variable, a.unique_id, a.horizon),
z as (select b.*, (a00+coalesce(c00,0))/(n*n) as q00, (a01+coalesce(c01,0))/(n*dxx) as q01, (a11+coalesce(c11,0))/(dxx*dxx) as q11 from b join z0 using ({BY}) left join zl using ({BY})),
zz as (select *, q00 - 2*mx*q01 + mx*mx*q11 as v00, q01 - mx*q11 as v01, q11 as v11 from z)"""


@query(BASE + _MZ + " select variable, unique_id, cast(horizon as int) as horizon, n as n_observations, round(b1, 5) as forecast_coef, round(sqrt(v11), 5) as forecast_se, round((b0*b0*v11 - 2*b0*(b1-1)*v01 + (b1-1)*(b1-1)*v00) / (2*(v00*v11 - v01*v01)), 3) as joint_test_fstat from zz where n >= 10")
def mz_hac(spark, sf_dir):
    out = efficiency.mincer_zarnowitz(main_levels(spark, sf_dir)).where("status = 'ok'")
    return rounded(rounded(out, 5, "forecast_coef", "forecast_se"), 3, "joint_test_fstat").select("variable", "unique_id", "horizon", "n_observations", "forecast_coef", "forecast_se", "joint_test_fstat")


# With two restrictions the F distribution's tail is (1 + 2 F / d) ** (-d / 2), d the other degrees of freedom.
@query(BASE + _MZ + """, w as (select variable, unique_id, cast(horizon as int) as horizon, n, b0, sqrt(v00) as se0, (b0*b0*v11 - 2*b0*(b1-1)*v01 + (b1-1)*(b1-1)*v00) / (2*(v00*v11 - v01*v01)) as f from zz where n >= 10)
select variable, unique_id, horizon, 'ok' as status, round(b0, 2) as constant_coef, round(se0, 2) as constant_se, round(pow(1 + 2 * f / (n - 2), -(n - 2) / 2.0), 6) as joint_test_pvalue, pow(1 + 2 * f / (n - 2), -(n - 2) / 2.0) < 0.05 as reject_weak_efficiency from w""")
def weak_efficiency(spark, sf_dir):
    out = efficiency.weak_efficiency(main_levels(spark, sf_dir)).where("n_observations >= 10")
    out = rounded(rounded(out, 2, "constant_coef", "constant_se"), 6, "joint_test_pvalue")
    return out.select("variable", "unique_id", "horizon", "status", "constant_coef", "constant_se", "joint_test_pvalue", "reject_weak_efficiency")


_DM = """, dd as (select a.variable, a.unique_id, a.horizon, a.tp, a.vintage_forecast, a.forecast_error*a.forecast_error - b.forecast_error*b.forecast_error as d, a.forecast_error as e, b.forecast_error as eb, greatest(a.forecast_horizon, b.forecast_horizon) as forecast_horizon
 from cs a join cs b on a.variable=b.variable and a.horizon=b.horizon and a.tp=b.tp and a.vintage_forecast=b.vintage_forecast and a.k=b.k and b.unique_id='last' where a.unique_id<>'last')"""


@query(BASE + _DM + "," + _hac("dd", "d", BY) + f""", rr as (select {BY}, sqrt(avg(e*e)) / sqrt(avg(eb*eb)) as ratio from dd group by {BY})
select variable, unique_id, cast(horizon as int) as horizon, n as n_observations, cast(L as int) as hac_maxlags, round(ratio, 6) as rmse_ratio,
 round(est / sqrt(case when s0.s0 + 2*coalesce(s1,0) < 0 then s0.s0 + 2*coalesce(s2,0) else s0.s0 + 2*coalesce(s1,0) end) * n * sqrt((n + 1 - 2*(L+1) + ((L+1)*1.0/n)*L)/n), 4) as dm_statistic
from s0 left join sl using ({BY}) join rr using ({BY})""")
def dm_table(spark, sf_dir):
    out = rounded(rounded(comparison.dm_statistics(main_levels(spark, sf_dir), "last"), 4, "dm_statistic"), 6, "rmse_ratio")
    return out.select("variable", "unique_id", "horizon", "n_observations", "hac_maxlags", "rmse_ratio", "dm_statistic")


_DM_MAE = _DM.replace("a.forecast_error*a.forecast_error - b.forecast_error*b.forecast_error", "abs(a.forecast_error) - abs(b.forecast_error)")


# Student's t at 5 %, two-sided, by the Cornish-Fisher expansion of the normal quantile; values that close to it are left out by both.
_T5 = "(1.959963984540054 + 2.372271230 / nu + 2.822498616 / (nu*nu) + 2.555852090 / (nu*nu*nu) + 1.589536200 / (nu*nu*nu*nu))"


@query(BASE + _DM_MAE + "," + _hac("dd", "d", BY) + f""", s as (select variable, unique_id, cast(horizon as int) as horizon, n, n - 1.0 as nu,
 est / sqrt(case when s0.s0 + 2*coalesce(s1,0) < 0 then s0.s0 + 2*coalesce(s2,0) else s0.s0 + 2*coalesce(s1,0) end) * n * sqrt((n + 1 - 2*(L+1) + ((L+1)*1.0/n)*L)/n) as dm from s0 left join sl using ({BY}))
select variable, unique_id, horizon, n as n_observations, round(dm, 4) as dm_statistic, abs(dm) > {_T5} as below_05 from s""")
def dm_pvalues(spark, sf_dir):
    """Absolute losses; SQL has no t distribution, so its 5 % point stands for the p-value."""
    out = comparison.dm_table(main_levels(spark, sf_dir), "last", loss="mae").withColumn("below_05", F.col("p_value") < 0.05)
    return rounded(out, 4, "dm_statistic").select("variable", "unique_id", "horizon", "n_observations", "dm_statistic", "below_05")


_CROSS = """, cr as (select a.unique_id, a.horizon, a.vintage_forecast, a.forecast_horizon, a.forecast_error as u, b.value_forecast as x, b.value_outturn as zz from fk a join fk b on a.vintage_forecast = b.vintage_forecast and a.unique_id = b.unique_id
 where a.unique_id = 'mean4' and a.variable = '1-URGENT' and b.variable = '2-HIGH' and b.horizon = 2)"""
_STRONG_ARGS = dict(outcome_variable="1-URGENT", outcome_metric="levels", instrument_variable="2-HIGH", instrument_metric="levels", horizons=range(5), j=2)


@query("with" + OUTT + FC + _main() + _fk() + _CROSS + " select unique_id, cast(horizon as int) as horizon, count(*) as n_observations, round(regr_slope(u, x), 6) as ols_coefficient, cast(max(forecast_horizon) as int) as hac_maxlags from cr group by 1, 2")
def strong_efficiency(spark, sf_dir):
    out = efficiency.strong_efficiency(main_levels(spark, sf_dir), "mean4", **_STRONG_ARGS)
    return rounded(out, 6, "ols_coefficient").select("unique_id", "horizon", "n_observations", "ols_coefficient", "hac_maxlags")


@query("with" + OUTT + FC + _main() + _fk() + _CROSS + " select unique_id, cast(horizon as int) as horizon, count(*) as n_observations, round(regr_slope(u, x), 6) as first_coefficient, round(regr_slope(zz, x), 6) as second_coefficient, round(regr_slope(u, x) / regr_slope(zz, x), 4) as ratio from cr group by 1, 2")
def response_ratio(spark, sf_dir):
    out = efficiency.response_ratio(main_levels(spark, sf_dir), "mean4", **_STRONG_ARGS)
    return rounded(rounded(out, 6, "first_coefficient", "second_coefficient"), 4, "ratio").select("unique_id", "horizon", "n_observations", "first_coefficient", "second_coefficient", "ratio")


@query(BASE + """, mm as (select variable, horizon, tp, vintage_forecast, unique_id, avg(forecast_error) as e from cs group by 1, 2, 3, 4, 5)
select a.variable, cast(a.horizon as int) as horizon, a.unique_id, b.unique_id as unique_id_b, round(corr(a.e, b.e), 6) as correlation, count(*) as n_observations from mm a join mm b using (variable, horizon, tp, vintage_forecast) group by 1, 2, 3, 4 having count(*) >= 5""")
def error_correlation(spark, sf_dir):
    out = rounded(comparison.error_correlation(main_levels(spark, sf_dir)), 6, "correlation")
    return out.select("variable", "horizon", "unique_id", "unique_id_b", "correlation", "n_observations")


# -- revisions ------------------------------------------------------------------------------
@query(f"with{OUTT} select {_day('tp')} as date, {_day('vp')} as vintage_date, variable, cast(row_number() over (partition by variable, tp order by vp) - 1 as int) as k, round(value - first_value(value) over (partition by variable, tp order by vp), 2) as revision from outt")
def outturn_revisions(spark, sf_dir):
    return rounded(revisions.outturn_revisions(raw_outturns(spark, sf_dir)), 2, "revision").select("date", "vintage_date", "variable", "k", "revision")


_REV = ", rv as (select *, fv - lag(fv) over w as revision, row_number() over w - 1 as num from fc window w as (partition by variable, unique_id, tp order by vp))"


@query(f"with{OUTT}{FC}{_REV} select unique_id, variable, {_day('tp')} as date, {_day('vp')} as vintage_date, round(revision, 2) as revision, cast(num as int) as revision_number from rv")
def forecast_revisions(spark, sf_dir):
    return rounded(revisions.forecast_revisions(raw_forecasts(spark, sf_dir)), 2, "revision").select("unique_id", "variable", "date", "vintage_date", "revision", "revision_number")


@query(f"with{OUTT}{FC}{_REV} select unique_id, variable, cast(horizon as int) as horizon, round(avg(revision), 2) as mean_revision, count(revision) as n_observations from rv group by 1, 2, 3")
def avg_revision_by_horizon(spark, sf_dir):
    return rounded(revisions.average_revision(raw_forecasts(spark, sf_dir)), 2, "mean_revision").select("unique_id", "variable", "horizon", "mean_revision", "n_observations")


@query("with" + OUTT + FC + _main() + _fk() + _REV + """, er as (select fk.variable, fk.unique_id, fk.horizon, fk.tp, fk.vintage_forecast, fk.forecast_error, rv.revision from fk join rv on rv.variable = fk.variable and rv.unique_id = fk.unique_id and rv.tp = fk.tp and rv.vp = fk.vintage_forecast where rv.revision is not null),
na as (select variable, count(distinct unique_id) as n_all from er group by 1), hv as (select variable, vintage_forecast, tp, count(distinct unique_id) as nn from er group by 1, 2, 3),
es as (select er.* from er join hv using (variable, vintage_forecast, tp) join na using (variable) where nn = n_all)
select variable, unique_id, cast(horizon as int) as horizon, count(*) as n_observations, round(regr_slope(forecast_error, revision), 5) as beta, round(regr_r2(forecast_error, revision), 5) as rsquared from es group by 1, 2, 3""")
def revisions_errors(spark, sf_dir):
    out = revisions.revision_error_regression(main_levels(spark, sf_dir), raw_forecasts(spark, sf_dir))
    return rounded(out, 5, "beta", "rsquared").select("variable", "unique_id", "horizon", "n_observations", "beta", "rsquared")


@query()
def revision_predictability(spark, sf_dir):
    return revisions.revision_predictability(raw_forecasts(spark, sf_dir))


# -- rolling --------------------------------------------------------------------------------
_WIN = """, vs as (select vp, row_number() over (order by vp) - 1 as i from (select distinct vintage_forecast as vp from main) t),
wn as (select a.vp as ws, b.vp as we from vs a join vs b on b.i = a.i + 7 where a.i + 8 <= (select max(i) from vs)),
main2 as (select main.*, ws, we from main join wn on vintage_forecast between ws and we),
mk2 as (select *, max(case when k <= 12 then k end) over (partition by ws, tp, variable, unique_id) as lo, min(case when k > 12 then k end) over (partition by ws, tp, variable, unique_id) as hi from main2),
fk2 as (select * from mk2 where k = coalesce(lo, hi)),
na2 as (select ws, variable, count(distinct unique_id) as n_all from fk2 group by 1, 2), hv2 as (select ws, variable, vintage_forecast, tp, count(distinct unique_id) as nn from fk2 group by 1, 2, 3, 4),
cs2 as (select fk2.* from fk2 join hv2 using (ws, variable, vintage_forecast, tp) join na2 using (ws, variable) where nn = n_all)"""
_ROLL = "with" + OUTT + FC + _main() + _WIN
_RB = _ROLL + "," + _hac("cs2", "forecast_error", "ws, we, " + BY) + f""", rb as (select ws, we, {BY}, n, est, nullif(sqrt(s0.s0 + 2*coalesce(s2,0))/n, 0) as se from s0 left join sl using (ws, we, {BY}))"""


@query(_RB + f" select {_day('ws')} as window_start, {_day('we')} as window_end, variable, unique_id, cast(horizon as int) as horizon, n as n_observations, round(est, 2) as bias_estimate, round(coalesce(se, 0), 2) as std_error from rb")
def rolling_bias(spark, sf_dir):
    out = rolling.rolling(main_levels(spark, sf_dir), 8, bias.bias_statistics)
    return rounded(out, 2, "bias_estimate", "std_error").select("window_start", "window_end", "variable", "unique_id", "horizon", "n_observations", "bias_estimate", "std_error")


@query(_ROLL + f" select {_day('ws')} as window_start, {_day('we')} as window_end, variable, unique_id, cast(horizon as int) as horizon, count(*) as n_observations, round(sqrt(avg(forecast_error*forecast_error)), 2) as rmse from cs2 group by ws, we, {BY}")
def rolling_accuracy(spark, sf_dir):
    out = rolling.rolling(main_levels(spark, sf_dir), 8, accuracy.accuracy)
    return rounded(out, 2, "rmse").select("window_start", "window_end", "variable", "unique_id", "horizon", "n_observations", "rmse")


@query(_RB + f""", nw as (select count(distinct ws) as n_windows from rb), cv as (select 8.0 / (n_windows + 7) as mu from nw),
c5 as (select mu, case when mu < 0.2 then 3.393 + (mu - 0.1) / 0.1 * (3.179 - 3.393) when mu < 0.3 then 3.179 + (mu - 0.2) / 0.1 * (3.012 - 3.179) when mu < 0.4 then 3.012 + (mu - 0.3) / 0.1 * (2.890 - 3.012) else 2.890 + (mu - 0.4) / 0.1 * (2.779 - 2.890) end as c from cv)
select {_day('ws')} as window_start, variable, unique_id, cast(horizon as int) as horizon, round(c, 6) as critical_value_05, round(abs(est / se), 3) as test_statistic, abs(est / se) > c as reject_05, round(max(abs(est / se)) over (partition by {BY}), 3) as max_test_statistic from rb, c5""")
def fluctuation_bias(spark, sf_dir):
    main = main_levels(spark, sf_dir)
    out, _ = rolling.fluctuation(rolling.rolling(main, 8, bias.bias_statistics), "t_statistic", 8, rolling.windows(main, 8))
    return rounded(rounded(out, 3, "test_statistic", "max_test_statistic"), 6, "critical_value_05").select("window_start", "variable", "unique_id", "horizon", "critical_value_05", "test_statistic", "reject_05", "max_test_statistic")


# -- nowcasts --------------------------------------------------------------------------------
MONTHLY = """with o as (select o_orderstatus as variable, cast(o_orderdate as date) as d, last_day(cast(o_orderdate as date)) as tgt, o_orderkey, cast(o_totalprice as decimal(18,2)) as v from orders where o_orderdate < timestamp '2001-07-01 00:00:00'),
rel as (select o.variable, o.tgt as date, r.k, cast(sum(case when o.o_orderkey % 10 < 8 + r.k then o.v else 0 end) as double) as value from o cross join (values (0),(1),(2)) as r(k) group by 1, 2, 3),
outt as (select variable, date, cast(date + cast(14 + 30*k as int) as date) as vintage_date, value from rel),
vint as (select distinct variable, tgt, w.day as dd, make_date(year(tgt), month(tgt), w.day) as vintage_date, day(tgt) as dim from o cross join (values (7),(14),(21),(28)) as w(day)),
fc as (select v.variable, v.tgt as date, v.vintage_date, cast(sum(o.v) as double) * max(v.dim) / max(v.dd) as value from vint v join o on o.variable = v.variable and o.tgt = v.tgt and o.d <= v.vintage_date group by 1, 2, 3),
main as (select f.variable, f.date, f.vintage_date as vf, t.vintage_date as vo, f.value as fv, t.value as ov, t.value - f.value as e, dense_rank() over (partition by f.variable, f.date order by t.vintage_date) - 1 as k from fc f join outt t on f.variable = t.variable and f.date = t.date)"""


def nowcast_main(spark, sf_dir) -> DataFrame:
    o, f = monthly(spark, sf_dir)
    main = maturity.main_table(f, o, [], calendar_k=False)
    return maturity.nowcast_k(main, ["date", "variable", "frequency", "metric"])


@query(MONTHLY + " select variable, date, vf as vintage_date_forecast, vo as vintage_date_outturn, cast(k as int) as k, cast(date_diff('day', vf, vo) as int) as days_to_publication from main")
def nowcast_k(spark, sf_dir):
    return nowcast_main(spark, sf_dir).select("variable", "date", "vintage_date_forecast", "vintage_date_outturn", "k", F.datediff("vintage_date_outturn", "vintage_date_forecast").alias("days_to_publication"))


_EARLY = MONTHLY + """, early as (select variable, date, vintage_date, value from outt union all select variable, date, cast(date - 10 as date), value * 0.9 from outt where vintage_date = date + 14 union all select variable, date, cast(date - 5 as date), value * 0.95 from outt where vintage_date = date + 14)
select variable, date, vintage_date as vintage_date_outturn, cast(case when vintage_date < date then -dense_rank() over (partition by variable, date, vintage_date < date order by vintage_date desc) else dense_rank() over (partition by variable, date, vintage_date < date order by vintage_date) - 1 end as int) as k from early"""


@query(_EARLY)
def nowcast_k_early(spark, sf_dir):
    """Releases before the period ends count back from -1."""
    o, _ = monthly(spark, sf_dir)
    first = o.where(F.datediff("vintage_date", "date") == 14)
    early = o.unionByName(first.withColumns({"vintage_date": F.date_sub("date", 10), "value": F.col("value") * 0.9})).unionByName(first.withColumns({"vintage_date": F.date_sub("date", 5), "value": F.col("value") * 0.95}))
    return maturity.nowcast_k(early.withColumnRenamed("vintage_date", "vintage_date_outturn"), ["date", "variable"]).select("variable", "date", "vintage_date_outturn", "k")


@query(MONTHLY + """, fv as (select distinct vintage_date as v from fc), need as (select s.variable, fv.v from (select distinct variable from outt) s cross join fv where not exists (select 1 from outt t where t.variable = s.variable and t.vintage_date = fv.v)),
reach as (select variable, min((year(date)*12 + month(date)) - (year(vintage_date)*12 + month(vintage_date))) as m from fc group by 1),
kn as (select n.variable, n.v, t.date, t.value, row_number() over (partition by n.variable, n.v, t.date order by t.vintage_date desc) as rn from need n join outt t on t.variable = n.variable and t.vintage_date <= n.v join reach r on r.variable = n.variable
  where (year(t.date)*12 + month(t.date)) - (year(n.v)*12 + month(n.v)) >= r.m - 13)
select variable, v as vintage_date, date, round(value, 2) as value from kn where rn = 1 and not exists (select 1 from fc where fc.variable = kn.variable and fc.vintage_date = kn.v and fc.date = kn.date)""")
def nowcast_align_asof(spark, sf_dir):
    return rounded(vintages.snapshots(*monthly(spark, sf_dir)), 2, "value").select("variable", "vintage_date", "date", "value")


@query(MONTHLY + " select 'part' as unique_id, cast(round_even(date_diff('day', vf, date) / 7.0, 0) as int) * 7 as days_to_period_end, round(sqrt(avg(e*e)), 2) as rmse, round(stddev_samp(e*e) / (2 * sqrt(count(*)) * sqrt(avg(e*e))), 2) as std_error, count(*) as n_observations from main where k = 0 and variable = 'F' group by 1, 2")
def intra_period_accuracy(spark, sf_dir):
    return rounded(intra_period.accuracy(nowcast_main(spark, sf_dir), "F", "levels", "M"), 2, "rmse", "std_error").drop("k_fallback_used")


@query(MONTHLY + " select 'part' as unique_id, cast(round_even(date_diff('day', vf, vo) / 7.0, 0) as int) * 7 as days_to_publication, round(avg(e), 2) as bias, round(stddev_samp(e) / sqrt(count(*)), 2) as std_error, count(*) as n_observations from main where k = 0 and variable = 'O' group by 1, 2")
def intra_period_bias(spark, sf_dir):
    return rounded(intra_period.bias(nowcast_main(spark, sf_dir), "O", "levels", "M", axis="publication"), 2, "bias", "std_error").drop("k_fallback_used")


# -- vintages, benchmarks, densities -------------------------------------------------------------
@query(f"""with{OUTT}, f0 as (select variable, min(vp) as first from outt group by 1), lag0 as (select o.variable, min(o.vp - o.tp) as lag from outt o join f0 on f0.variable = o.variable and o.vp = f0.first group by 1)
select o.variable, {_day('o.tp')} as date, {_day('v.v')} as vintage_date, o.value from (select * from outt where vp >= 4*1998) o
join (select variable, min(vp) as first from outt where vp >= 4*1998 group by 1) f on f.variable = o.variable and o.vp = f.first
join (select variable, min(vp - tp) as lag from outt where vp = 4*1998 group by 1) l on l.variable = o.variable
join (select distinct vp as v from outt union select distinct tp from outt) v on v.v >= 4*1996 and v.v < f.first and v.v >= o.tp + l.lag""")
def pseudo_vintages(spark, sf_dir):
    """The panel from 1998 on, filled back to the first quarter of 1996."""
    o = raw_outturns(spark, sf_dir).where("vintage_date >= date'1998-01-01'")
    return vintages.pseudo_vintages(o, "1996-03-31").select("variable", "date", "vintage_date", "value")


@query(f"""with{OUTT}{FC}, cut as (select variable, vp, min(tp - forecast_horizon - 1) as last_obs from (select *, min(forecast_horizon) over (partition by variable, vp) as m from fc) t where forecast_horizon = m group by 1, 2),
lv as (select c.variable, c.vp, max(o.tp) as tp, max_by(o.value, o.tp) as value from cut c join outt o on o.variable = c.variable and o.vp = c.vp and o.tp <= c.last_obs group by 1, 2)
select variable, {_day('vp')} as vintage_date, {_day('tp + h.h + 1')} as date, cast(h.h as int) as forecast_horizon, value from lv cross join (select unnest(range(0, 13)) as h) h""")
def random_walk(spark, sf_dir):
    out = benchmarks.random_walk(raw_outturns(spark, sf_dir), raw_forecasts(spark, sf_dir))
    return out.select("variable", "vintage_date", "date", "forecast_horizon", "value")


@query()
def ar_p(spark, sf_dir):
    """Maximum likelihood by vintage: no SQL form."""
    o = panels.quarterly_outturns(spark, sf_dir)
    first = schema.with_distance(o.where(calendar.maturity("date", "vintage_date", "Q") == 0)).withColumns({"metric": F.lit("levels"), "vintage_date": F.lit(None).cast("date"), "value": F.log("value")})
    return benchmarks.autoregression(first, raw_forecasts(spark, sf_dir), periods=5)


def _density(spark, sf_dir) -> DataFrame:
    return panels.quarterly_density(raw_forecasts(spark, sf_dir))


_DENS = FC + ", dn as (select f.*, q.q / 10.0 as quantile, f.fv * (1 + (q.q / 10.0 - 0.5) * 0.2) as value from fc f cross join (select unnest(range(1, 10)) as q) q)"


@query(f"with{OUTT}{_DENS} select unique_id, variable, {_day('vp')} as vintage_date, {_day('tp')} as date, round(value, 2) as value, cast(quantile as double) as quantile from dn where quantile = 0.6")
def density_nearest_quantile(spark, sf_dir):
    out = density.nearest_quantile(_density(spark, sf_dir), 0.57)
    return rounded(out, 2, "value").select("unique_id", "variable", "vintage_date", "date", "value", "quantile")


@query(f"""with{OUTT}{_DENS}, w as (select *, lag(value) over s as v1, lag(value, 4) over s as v4 from dn window s as (partition by unique_id, variable, vp, quantile order by tp))
select unique_id, variable, {_day('vp')} as vintage_date, {_day('tp')} as date, cast(quantile as double) as quantile, metric, round(x, 6) as value from (
 select unique_id, variable, vp, tp, quantile, 'levels' as metric, value as x from w union all select unique_id, variable, vp, tp, quantile, 'pop', value / v1 - 1 from w where v1 is not null union all select unique_id, variable, vp, tp, quantile, 'yoy', value / v4 - 1 from w where v4 is not null) t""")
def density_pop_yoy(spark, sf_dir):
    out = density.growth(_density(spark, sf_dir))
    return rounded(out, 6, "value").select("unique_id", "variable", "vintage_date", "date", "quantile", "metric", "value")


@query()
def density_sample(spark, sf_dir):
    """A hundred draws of each distribution by a seeded hash."""
    return density.sample(_density(spark, sf_dir), 100, 7).select("unique_id", "variable", "vintage_date", "date", "draw", "value")


@query(f"""with{OUTT}{_DENS}, a as (select *, 3500.0 as lim from dn), s as (select *, lag(value) over w as v0, lag(quantile) over w as q0, min(value) over g as lo, max(value) over g as hi from a window w as (partition by unique_id, variable, vp, tp order by quantile), g as (partition by unique_id, variable, vp, tp))
select unique_id, variable, {_day('vp')} as vintage_date, {_day('tp')} as date, round(max(case when lim < lo then 0.1 when lim >= hi then 0.9 when v0 <= lim and value > lim then q0 + (quantile - q0) * (lim - v0) / (value - v0) end), 6) as probability from s group by unique_id, variable, vp, tp""")
def density_cdf(spark, sf_dir):
    return rounded(density.cdf(_density(spark, sf_dir), 3500.0), 6, "probability").select("unique_id", "variable", "vintage_date", "date", "probability")


# -- chart data -------------------------------------------------------------------------------------
@query("with" + OUTT + FC + _main() + _fk() + f""", h0 as (select * from (select *, min(horizon) over (partition by variable, unique_id) as mh from fk) t where horizon = mh)
select variable, unique_id, {_day('tp')} as date, round(abs(forecast_error), 2) as error, round(case when count(*) over w = 4 then avg(abs(forecast_error)) over w end, 2) as moving_mean, round(case when count(*) over w = 4 then stddev_samp(abs(forecast_error)) over w end, 2) as moving_std
from h0 window w as (partition by variable, unique_id order by tp, vintage_forecast rows 3 preceding)""")
def moving_error(spark, sf_dir):
    out = plot_data.errors_across_time_data(main_levels(spark, sf_dir), kind="absolute", width=4)
    return rounded(out, 2, "error", "moving_mean", "moving_std").select("variable", "unique_id", "date", "error", "moving_mean", "moving_std")


class _Handles:
    """Forecasts and outturns, as a container shows them."""

    def __init__(self, forecasts: DataFrame, outturns: DataFrame):
        self.forecasts, self.outturns = forecasts, outturns


@query(f"""with{OUTT}{FC} select {_day('tp')} as date, {_day('vp')} as vintage_date, unique_id, round(fv, 2) as value, 'forecast' as kind, cast(null as int) as release from fc where variable = '5-LOW' union all
select {_day('tp')}, {_day('vp')}, null, round(value, 2), 'outturn', cast(dense_rank() over (partition by tp order by vp) as int) from outt where variable = '5-LOW'""")
def hedgehog(spark, sf_dir):
    out = plot_data.hedgehog_data(_Handles(raw_forecasts(spark, sf_dir), raw_outturns(spark, sf_dir)), "5-LOW", "levels")
    return rounded(out, 2, "value").drop("shade")


@query("with" + OUTT + FC + _main() + _fk() + """, h1 as (select variable, unique_id, forecast_error as v from fk where horizon = 1), st as (select variable, unique_id, avg(v) as m, stddev_samp(v) as sd, count(*) as n, stddev_samp(v) * pow(count(*), -0.2) as h, min(v) as lo, max(v) as hi from h1 group by 1, 2),
gr as (select st.*, lo - 3*h + (hi - lo + 6*h) * i / 49.0 as x, i from st cross join (select unnest(range(0, 50)) as i) g)
select variable, unique_id, round(x, 2) as x, round(1e3 * avg(exp(-0.5 * pow((x - v) / h, 2))) / (max(h) * sqrt(2 * pi())), 6) as density from gr join h1 using (variable, unique_id) group by variable, unique_id, i, x""")
def kde_errors(spark, sf_dir):
    out = plot_data.forecast_error_density_data(main_levels(spark, sf_dir), 1, points=50).withColumn("density", F.col("density") * 1e3)
    return rounded(rounded(out, 6, "density"), 2, "x").select("variable", "unique_id", "x", "density")


@query(BASE + ", " + _ACC + """, lg as (select variable, unique_id, 'rmse' as spoke, rmse as x from acc where horizon = 0 union all select variable, unique_id, 'rmedse', rmedse from acc where horizon = 0 union all select variable, unique_id, 'mean_abs_error', mean_abs_error from acc where horizon = 0)
select variable, unique_id, spoke, round(case when max(x) over w = min(x) over w then 0.5 else (x - min(x) over w) / (max(x) over w - min(x) over w) end, 6) as score from lg window w as (partition by variable, spoke)""")
def radar_normalised(spark, sf_dir):
    out = plot_data.radar_data(accuracy.accuracy(main_levels(spark, sf_dir), 12))
    return rounded(out, 6, "score").select("variable", "unique_id", "spoke", "score")


# -- containers ---------------------------------------------------------------------------------------
@query("with" + OUTT + FC + _main() + f""" select variable, unique_id, 'levels' as metric, count(*) as n, round(sum(forecast_error), 0) as total_error, min({_day('vintage_forecast')}) as first_vintage from main group by 1, 2""")
def container_main(spark, sf_dir):
    """Ingestion end to end: checks, growth, pairing; the levels of the main table."""
    o = panels.quarterly_outturns(spark, sf_dir)
    data = container.ForecastData(o, panels.quarterly_forecasts(o), data_check=False)
    data.filter(metrics=["levels"])
    return data.df.groupBy("variable", "unique_id", "metric").agg(F.count("*").alias("n"), F.round(F.sum("forecast_error"), 0).alias("total_error"), F.min("vintage_date_forecast").alias("first_vintage"))


@query("with" + OUTT + FC + _main() + """ select variable, unique_id, count(*) as n, round(sum(forecast_error), 0) as total_error from main where vintage_forecast < 4*2000 or unique_id <> 'mean8' group by 1, 2""")
def container_merge(spark, sf_dir):
    """Two containers of overlapping forecasters and outturns, merged."""
    o = panels.quarterly_outturns(spark, sf_dir)
    f = panels.quarterly_forecasts(o)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        data = container.ForecastData(o, f.where("source <> 'mean8'"), data_check=False)
        data.merge(container.ForecastData(o, f.where("source <> 'last' and vintage_date < date'2000-01-01'"), data_check=False))
    data.filter(metrics=["levels"])
    return data.df.groupBy("variable", "unique_id").agg(F.count("*").alias("n"), F.round(F.sum("forecast_error"), 0).alias("total_error"))


@query(MONTHLY + " select variable, cast(k as int) as k, count(*) as n, round(sum(e), 0) as total_error, cast(sum(date_diff('day', vf, vo)) as bigint) as days from main group by 1, 2")
def container_nowcasts(spark, sf_dir):
    """Nowcast ingestion: release ranks, days to publication."""
    data = container.NowcastData(panels.monthly_outturns(spark, sf_dir), panels.monthly_nowcasts(spark, sf_dir), data_check=False)
    data.filter(metrics=["levels"])
    return data.df.groupBy("variable", "k").agg(F.count("*").alias("n"), F.round(F.sum("forecast_error"), 0).alias("total_error"), F.sum("days_to_publication").alias("days"))


@query("with" + OUTT + FC + _main() + _DENS.removeprefix(FC) + """ select variable, unique_id, count(*) as n, round(sum(forecast_error), 0) as total_error from main group by 1, 2""")
def container_density(spark, sf_dir):
    """Density ingestion, then the median as point forecasts."""
    o = panels.quarterly_outturns(spark, sf_dir)
    data = container.DensityForecastData(o, density_data=panels.quarterly_density(panels.quarterly_forecasts(o)))
    data.to_point_forecast()
    data.filter(metrics=["levels"], filter_density_forecasts=False)
    return data.df.groupBy("variable", "unique_id").agg(F.count("*").alias("n"), F.round(F.sum("forecast_error"), 0).alias("total_error"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
