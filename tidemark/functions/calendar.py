"""Period arithmetic on dates, as column expressions.

A frequency is ``"Q"`` or ``"M"``, either a string or a column of such strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Frequency = str | Column


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _by(freq: Frequency, quarterly: Column, monthly: Column) -> Column:
    if isinstance(freq, str):
        if freq not in ("Q", "M"):
            raise ValueError(f"unsupported frequency {freq!r}; use 'Q' or 'M'")
        return quarterly if freq == "Q" else monthly
    return F.when(freq == "Q", quarterly).when(freq == "M", monthly)


def period_index(date: str | Column, freq: Frequency) -> Column:
    """Number of the period that holds the date; consecutive periods differ by one."""
    d = _col(date)
    return _by(freq, F.year(d) * 4 + F.quarter(d), F.year(d) * 12 + F.month(d)).cast("int")


def period_end(date: str | Column, freq: Frequency) -> Column:
    d = _col(date)
    return _by(freq, F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1))), F.last_day(d))


def add_periods(date: str | Column, n: int | Column, freq: Frequency) -> Column:
    """End of the period ``n`` periods on."""
    n = F.lit(n) if isinstance(n, int) else n
    start = F.trunc(_col(date), "month")
    return _by(freq, period_end(F.add_months(start, (n * 3).cast("int")), "Q"), F.last_day(F.add_months(start, n.cast("int"))))


def periods_between(target: str | Column, vintage: str | Column, freq: Frequency) -> Column:
    """Calendar distance target minus vintage in periods; null if either is null."""
    return period_index(target, freq) - period_index(vintage, freq)


def maturity(target: str | Column, release: str | Column, freq: Frequency) -> Column:
    """Periods between the target and its release, less one."""
    return periods_between(release, target, freq) - 1


def days_in_period(date: str | Column, freq: Frequency) -> Column:
    """Days since the start of the date's period."""
    d = _col(date)
    return _by(freq, F.datediff(d, F.trunc(d, "quarter")), F.datediff(d, F.trunc(d, "month")))


def periods_a_year(freq: Frequency) -> Column | int:
    return {"Q": 4, "M": 12}[freq] if isinstance(freq, str) else F.when(freq == "Q", 4).when(freq == "M", 12)
