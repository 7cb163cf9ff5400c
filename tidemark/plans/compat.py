"""Deprecated keyword names."""

from __future__ import annotations

import functools
import warnings


def accept_forecast_horizon(f):
    """Takes ``forecast_horizon=`` for ``horizon=``, with a warning; both are an error."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        if "forecast_horizon" in kwargs:
            if "horizon" in kwargs:
                raise TypeError("horizon and forecast_horizon are the same argument")
            warnings.warn("forecast_horizon= is now horizon=", FutureWarning, stacklevel=2)
            kwargs["horizon"] = kwargs.pop("forecast_horizon")
        return f(*args, **kwargs)

    return run


def horizon_column(name: str) -> str:
    """The grouping column behind a name from an older table."""
    if name == "forecast_horizon":
        warnings.warn("results are grouped by horizon, not forecast_horizon", FutureWarning, stacklevel=2)
        return "horizon"
    return name
