"""Checking and typing of incoming tables.

Unknown columns go, known ones are cast; rows that cannot be cast, break a rule or
contradict each other are reported together, with examples, by one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar

FREQUENCIES = ("Q", "M")
METRICS = ("levels", "pop", "yoy")
EXAMPLES = 5


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = False
    rule: str | None = None  # SQL over the cast column
    reason: str = ""


def fields(forecast: bool, optional: list[str] | None = None, *, nullable_vintage: bool = False) -> list[Field]:
    """Columns of a forecast or an outturn table, and the optional ones named."""
    out = [
        Field("date", "date"),
        Field("vintage_date", "date", nullable_vintage),
        Field("variable", "string", rule="length(variable) > 0", reason="is empty"),
        Field("frequency", "string", rule="frequency in ('Q', 'M')", reason="is not 'Q' or 'M'"),
        Field("value", "double", rule="not isnan(value)", reason="is not a number"),
    ]
    if forecast:
        out += [Field("forecast_horizon", "int"), Field("source", "string", rule="length(source) > 0", reason="is empty")]
    for c in optional or []:
        if c == "quantile":
            out.append(Field(c, "double", rule="quantile between 0 and 1", reason="is outside [0, 1]"))
        elif c == "days_in_period":
            out.append(Field(c, "int", rule="days_in_period >= 0", reason="is negative"))
        elif c == "metric":
            out.append(Field(c, "string", rule="metric in ('levels', 'pop', 'yoy')", reason="is not levels, pop or yoy"))
        else:
            out.append(Field(c, "string", True))
    return out


def _cast(f: Field, own: str) -> Column:
    c = F.col(f"`{f.name}`")
    if f.kind == "date":
        return c.try_cast("timestamp").cast("date") if own == "string" else c.try_cast("date")
    if f.kind == "double":
        return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    return c.try_cast(f.kind)


def require(df: DataFrame, schema: list[Field]) -> None:
    missing = [f.name for f in schema if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def validate(df: DataFrame, schema: list[Field], *, keys: list[str] | None = None) -> DataFrame:
    """The typed table: dates at period ends, exact duplicates once."""
    return checked(df, schema, keys=keys)[0]


def checked(df: DataFrame, schema: list[Field], *, keys: list[str] | None = None, keep: bool = False) -> tuple[DataFrame, list[str], DataFrame]:
    """The typed table, the frequencies in it, and what ``keep`` persisted.

    One action finds all broken cells; one more finds keys with several values. With
    ``keep`` the typed rows are persisted, so that neither these actions nor later ones
    compute the input again.
    """
    require(df, schema)
    known = [f for f in schema if f.name in df.columns]
    kinds = dict(df.dtypes)
    raw = {f.name: f"_raw_{f.name}" for f in known}
    cells = df.select(*[_cast(f, kinds[f.name]).alias(f.name) for f in known], *[F.col(f"`{f.name}`").cast("string").alias(raw[f.name]) for f in known])
    checks: list[tuple[str, str, Column]] = []
    for f in known:
        checks.append((f.name, f"is not of type {f.kind}", F.col(f.name).isNull() & F.col(raw[f.name]).isNotNull()))
        if not f.nullable:
            checks.append((f.name, "is null", F.col(raw[f.name]).isNull()))
        if f.rule:
            checks.append((f.name, f.reason, ~F.expr(f.rule) & F.col(f.name).isNotNull()))
    # A bit for each broken rule travels with the row instead of the raw cells.
    bits = reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, _, c) in enumerate(checks)])
    typed = cells.select(*[f.name for f in known], bits.alias("_bad"))
    if keep:
        typed = typed.persist(StorageLevel.MEMORY_AND_DISK)
    counted = typed.agg(*[F.count_if(F.col("_bad").bitwiseAND(F.lit(1 << i)) != 0).alias(f"n{i}") for i in range(len(checks))], F.collect_set("frequency").alias("frequencies")).first()
    bad = [(i, n, why, c) for i, (n, why, c) in enumerate(checks) if counted[f"n{i}"]]
    if bad:
        lines = []
        for i, name, why, c in bad:
            shown = [str(r[0]) for r in cells.where(c).select(raw[name]).limit(EXAMPLES).collect()]
            lines.append(f"- {name} {why} in {counted[f'n{i}']} rows, such as {', '.join(shown)}")
        raise ValueError("the table breaks its schema:\n" + "\n".join(lines))
    out = typed.select(*[f.name for f in known]).withColumn("date", calendar.period_end("date", F.col("frequency"))).distinct()
    keys = keys or [f.name for f in known if f.name != "value"]
    twice = out.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(EXAMPLES).collect()
    if twice:
        shown = "; ".join(", ".join(f"{k}={r[k]}" for k in keys) for r in twice)
        raise ValueError(f"several values for one key: {shown}")
    return out, counted["frequencies"], typed


def with_distance(df: DataFrame) -> DataFrame:
    """``target_minus_vintage``, null where a date is."""
    return df.withColumn("target_minus_vintage", calendar.periods_between("date", "vintage_date", F.col("frequency")))


def with_legacy_horizon(df: DataFrame, first: int | dict[str, int] | None = None) -> DataFrame:
    """``forecast_horizon`` from the calendar distance, less the first horizon (of all
    variables or of each), where the table has none."""
    if "forecast_horizon" in df.columns:
        return df
    if isinstance(first, dict) and first:
        table = F.create_map(*[x for k, v in first.items() for x in (F.lit(k), F.lit(int(v)))])
        less = F.coalesce(F.try_element_at(table, F.col("variable")), F.lit(0))
    else:
        less = F.lit(int(first or 0))
    date, vintage = F.col("date").cast("date"), F.col("vintage_date").cast("date")
    return df.withColumn("forecast_horizon", (calendar.periods_between(date, vintage, F.col("frequency")) - less).cast("int"))
