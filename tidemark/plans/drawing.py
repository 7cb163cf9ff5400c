"""Drawing of chart data with matplotlib, where it is installed.

``CHARTS`` says of each chart what its axes, series, bands and marks are; one function
for each kind draws it. Chart data are small (a few series), so they come to the driver;
``draw`` gives the data back where there is no matplotlib.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Colours in the order of the series, and what a figure looks like.
PALETTE = ("#1b5e7b", "#d9822b", "#5a9367", "#a23e48", "#6c5b9c", "#8c7a4f", "#3aa6a6", "#555555")
THEME = {"figure.figsize": (9.0, 5.0), "axes.spines.top": False, "axes.spines.right": False, "axes.grid": True, "grid.alpha": 0.25, "legend.frameon": False, "font.size": 11.0, "axes.titleweight": "bold", "axes.titlelocation": "left"}
#: What a mark of a point's significance looks like.
MARKERS = {"5%": "o", "10%": "s", "none": "x"}


@dataclass(frozen=True)
class Chart:
    kind: str  # lines, points, bars, heat, hedgehog or radar
    x: str = ""
    y: str = ""
    series: tuple[str, ...] = ()
    low: str = ""
    high: str = ""
    marks: str = ""
    level: float | None = None
    title: str = ""
    x_label: str = ""
    y_label: str = ""


CHARTS = {
    "accuracy": Chart("lines", "horizon", "value", ("unique_id",), title="Accuracy by horizon", x_label="Horizon", y_label="Statistic"),
    "compare_to_benchmark": Chart("lines", "horizon", "value", ("unique_id",), level=1.0, title="Relative to the benchmark", x_label="Horizon", y_label="Ratio"),
    "rolling_relative_accuracy": Chart("lines", "window_end", "rmse_ratio", ("unique_id", "horizon"), marks="significance", level=1.0, title="Relative accuracy in rolling windows", x_label="End of window", y_label="Ratio of RMSE"),
    "bias_by_horizon": Chart("lines", "horizon", "bias_estimate", ("unique_id",), "ci_lower", "ci_upper", level=0.0, title="Bias by horizon", x_label="Horizon", y_label="Mean error"),
    "rolling_bias": Chart("lines", "window_end", "bias_estimate", ("unique_id", "horizon"), "ci_lower", "ci_upper", level=0.0, title="Bias in rolling windows", x_label="End of window", y_label="Mean error"),
    "blanchard_leigh_ratios": Chart("lines", "horizon", "ratio", (), "ratio_ci_lower", "ratio_ci_upper", level=0.0, title="Response of errors to responses of outturns", x_label="Horizon", y_label="Ratio"),
    "strong_efficiency": Chart("lines", "horizon", "ols_coefficient", (), "coeff_ci_lower", "coeff_ci_upper", level=0.0, title="Response of errors", x_label="Horizon", y_label="Coefficient"),
    "correlation_heatmap": Chart("heat", "unique_id", title="Correlation of errors"),
    "rolling_correlation": Chart("lines", "window_end", "correlation", ("unique_id_b",), title="Correlation of errors in rolling windows", x_label="End of window", y_label="Correlation"),
    "density_vintage": Chart("lines", "date", "value", ("unique_id", "wanted"), title="Quantiles of a vintage", x_label="Date", y_label="Value"),
    "errors_across_time": Chart("lines", "date", "error", ("unique_id",), title="Errors over time", x_label="Date", y_label="Error", level=0.0),
    "vintage": Chart("lines", "date", "value", ("series",), title="Forecasts of a vintage", x_label="Date", y_label="Value"),
    "nowcasts": Chart("lines", "vintage_date_forecast", "value_forecast", ("unique_id",), title="Nowcasts of a target", x_label="Vintage", y_label="Value"),
    "forecast_errors": Chart("bars", "date", "forecast_error", ("unique_id",), level=0.0, title="Errors of a vintage", x_label="Date", y_label="Error"),
    "forecast_errors_by_horizon": Chart("lines", "horizon", "mean_error", ("unique_id",), level=0.0, title="Errors by horizon", x_label="Horizon", y_label="Mean error"),
    "forecast_error_density": Chart("lines", "x", "density", ("unique_id",), title="Density of errors", x_label="Error", y_label="Density"),
    "hedgehog": Chart("hedgehog", "date", "value", title="Forecasts and outturns", x_label="Date", y_label="Value"),
    "intra_period_accuracy": Chart("points", "", "rmse", ("unique_id",), "lower", "upper", title="Accuracy within the period", y_label="Statistic"),
    "intra_period_bias": Chart("points", "", "bias", ("unique_id",), "lower", "upper", level=0.0, title="Bias within the period", y_label="Mean error"),
    "outturn_revisions": Chart("lines", "date", "revision", ("maturity",), level=0.0, title="Revisions of outturns", x_label="Date", y_label="Revision"),
    "outturns": Chart("lines", "date", "value", ("maturity",), title="Outturns", x_label="Date", y_label="Value"),
    "radar": Chart("radar", "spoke", "score", ("unique_id",), title="Normalised statistics"),
    "average_revision_by_period": Chart("lines", "horizon", "mean_revision", ("unique_id",), level=0.0, title="Average revision", x_label="Horizon", y_label="Revision"),
}


def draw(df: DataFrame, name: str, *, existing_plot=None, custom_labels: dict[str, str] | None = None, title: str | None = None):
    """``(figure, axes)`` of chart ``name``, or the data without matplotlib.

    ``existing_plot`` is a pair like the one returned; the chart is added to it.
    ``custom_labels`` replaces series' names, and the texts ``title``, ``x`` and ``y``.
    """
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return df
    chart, labels = CHARTS[name], dict(custom_labels or {})
    rows = df.toPandas()
    with plt.rc_context(THEME):
        if existing_plot is not None:
            fig, ax = existing_plot
        else:
            fig, ax = plt.subplots(subplot_kw={"projection": "polar"} if chart.kind == "radar" else None)
        KINDS[chart.kind](ax, rows, chart, labels)
        if chart.level is not None and existing_plot is None:
            ax.axhline(chart.level, color="#999999", linewidth=1.0, linestyle="--")
        ax.set_title(labels.get("title", title or chart.title))
        if chart.kind not in ("radar", "heat"):
            ax.set_xlabel(labels.get("x", chart.x_label or chart.x.replace("_", " ")))
            ax.set_ylabel(labels.get("y", chart.y_label or chart.y.replace("_", " ")))
        if chart.kind != "heat":
            ax.legend()
    return fig, ax


def _series(rows, chart: Chart, labels: dict[str, str]):
    """``(label, rows)`` of each series, by name."""
    keys = [c for c in chart.series if c in rows.columns]
    if not keys:
        yield labels.get("", None), rows
        return
    for value, part in rows.groupby(keys, sort=True, dropna=False):
        value = value if isinstance(value, tuple) else (value,)
        text = ", ".join(str(v) for v in value)
        yield labels.get(text, text), part


def _axis(rows, chart: Chart) -> str:
    """Within a period the axis is the one the data have."""
    return chart.x or next(c for c in rows.columns if c.startswith("days_to_"))


def _lines(ax, rows, chart: Chart, labels) -> None:
    x, begun = _axis(rows, chart), len(ax.lines)
    for i, (label, part) in enumerate(_series(rows, chart, labels)):
        colour, part = PALETTE[(begun + i) % len(PALETTE)], part.sort_values(x)
        ax.plot(part[x], part[chart.y], color=colour, label=label, marker=None if chart.marks or len(part) > 40 else "o", markersize=4)
        if chart.low:
            ax.fill_between(part[x], part[chart.low].astype(float), part[chart.high].astype(float), color=colour, alpha=0.15)
        if "moving_mean" in part.columns:
            mean, sd = part["moving_mean"].astype(float), part["moving_std"].astype(float)
            ax.plot(part[x], mean, color=colour, linestyle=":")
            ax.fill_between(part[x], mean - sd, mean + sd, color=colour, alpha=0.12)
        for mark, own in part.groupby(chart.marks) if chart.marks else ():
            ax.scatter(own[x], own[chart.y], color=colour, marker=MARKERS[mark])
    if "value_outturn" in rows.columns and len(rows):
        ax.axhline(float(rows["value_outturn"].iloc[0]), color="#222222", label=labels.get("outturn", "outturn"))


def _points(ax, rows, chart: Chart, labels) -> None:
    x = _axis(rows, chart)
    for i, (label, part) in enumerate(_series(rows, chart, labels)):
        part = part.sort_values(x, ascending=False)
        y = part[chart.y if chart.y in part.columns else next(c for c in part.columns if c in ("rmse", "rmedse", "mean_abs_error"))].astype(float)
        ax.errorbar(part[x], y, yerr=[y - part[chart.low].astype(float), part[chart.high].astype(float) - y], color=PALETTE[i % len(PALETTE)], marker="o", capsize=3, label=label)
    if not ax.xaxis_inverted():  # time runs towards the period's end
        ax.invert_xaxis()


def _bars(ax, rows, chart: Chart, labels) -> None:
    groups = list(_series(rows, chart, labels))
    dates = sorted(set(rows[chart.x]))
    at, width = {d: i for i, d in enumerate(dates)}, 0.8 / max(len(groups), 1)
    for i, (label, part) in enumerate(groups):
        ax.bar([at[d] + (i - (len(groups) - 1) / 2) * width for d in part[chart.x]], part[chart.y].astype(float), width, color=PALETTE[i % len(PALETTE)], label=label)
        if "mean_error" in part.columns and len(part):
            ax.axhline(float(part["mean_error"].iloc[0]), color=PALETTE[i % len(PALETTE)], linestyle=":")
    ax.set_xticks(range(len(dates)), [str(d) for d in dates], rotation=45)


def _heat(ax, rows, chart: Chart, labels) -> None:
    names = [c for c in rows.columns if c != chart.x]
    cells = rows.set_index(chart.x)[names].astype(float)
    ax.imshow(cells.to_numpy(), vmin=-1, vmax=1, cmap="RdBu_r")
    ax.set_xticks(range(len(names)), [labels.get(n, n) for n in names], rotation=45)
    ax.set_yticks(range(len(cells)), [labels.get(n, n) for n in cells.index])
    for i, row in enumerate(cells.to_numpy()):
        for j, v in enumerate(row):
            ax.text(j, i, "" if math.isnan(v) else f"{v:.2f}", ha="center", va="center")
    ax.grid(False)


def _hedgehog(ax, rows, chart: Chart, labels) -> None:
    """Each vintage's path as a thin line, releases from light to dark."""
    paths, seen = rows[rows["kind"] == "forecast"], {}
    for (name, _), part in paths.groupby(["unique_id", "vintage_date"], sort=True):
        first = name not in seen
        colour = seen.setdefault(name, PALETTE[len(seen) % len(PALETTE)])
        part = part.sort_values("date")
        ax.plot(part["date"], part["value"].astype(float), color=colour, linewidth=0.8, alpha=0.7, label=labels.get(name, name) if first else None)
    known = rows[rows["kind"] == "outturn"]
    for release, part in known.groupby("release", sort=True):
        part, shade = part.sort_values("date"), part["shade"].astype(float).fillna(1.0).mean()
        ax.plot(part["date"], part["value"].astype(float), color="black", alpha=0.25 + 0.75 * float(shade), linewidth=1.6, label=labels.get("outturn", "outturn") if release == known["release"].max() else None)


def _radar(ax, rows, chart: Chart, labels) -> None:
    spokes = sorted(set(rows[chart.x]))
    angles = [2 * math.pi * i / len(spokes) for i in range(len(spokes))]
    for i, (label, part) in enumerate(_series(rows, chart, labels)):
        of = part.groupby(chart.x)[chart.y].mean()
        r = [float(of[s]) for s in spokes]
        ax.plot([*angles, *angles[:1]], [*r, *r[:1]], color=PALETTE[i % len(PALETTE)], label=label)
        ax.fill([*angles, *angles[:1]], [*r, *r[:1]], color=PALETTE[i % len(PALETTE)], alpha=0.1)
    ax.set_xticks(angles, [labels.get(s, s) for s in spokes])
    ax.set_ylim(0, 1)


KINDS = {"lines": _lines, "points": _points, "bars": _bars, "heat": _heat, "hedgehog": _hedgehog, "radar": _radar}


def chart(name: str, data, *args, existing_plot=None, custom_labels: dict[str, str] | None = None, title: str | None = None, **kwargs):
    """Data of a chart by its function in ``plot_data``, drawn."""
    from . import plot_data

    return draw(getattr(plot_data, f"{name}_data")(data, *args, **kwargs), name, existing_plot=existing_plot, custom_labels=custom_labels, title=title)


def functions() -> dict:
    """``plot_{name}`` of every chart."""

    def one(name: str):
        def plot(data, *args, **kwargs):
            return chart(name, data, *args, **kwargs)

        plot.__name__ = plot.__qualname__ = f"plot_{name}"
        plot.__doc__ = f"{CHARTS[name].title}: draws ``plot_data.{name}_data``; also takes ``existing_plot``, ``custom_labels`` and ``title``."
        return plot

    return {f"plot_{n}": one(n) for n in CHARTS}
