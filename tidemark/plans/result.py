"""A lazy result table with what produced it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators.filters import filter_sources, listed


class TestResult:
    """Wraps a DataFrame; nothing runs until it is shown, counted or converted.

    Label columns are split from ``unique_id`` and replace any of the same name.
    """

    __test__ = False  # not a pytest class

    def __init__(self, df: DataFrame, id_columns: list[str] | None = None, metadata: dict | None = None):
        labels = list(id_columns or [])
        if labels and "unique_id" in df.columns:
            df = ids.split_id(df, labels)
        self._df, self.id_columns, self.metadata = df, labels, dict(metadata or {})

    def to_df(self) -> DataFrame:
        return self._df

    def to_pandas(self):
        return self._df.toPandas()

    def __getitem__(self, key):
        return self._df[key]

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._df, name)

    def __dataframe__(self, *args, **kwargs):
        return self._df.toArrow().__dataframe__(*args, **kwargs)

    def __len__(self) -> int:
        return self._df.count()

    def __repr__(self) -> str:
        return f"TestResult({self.metadata.get('test_name', 'unknown')}: {', '.join(self._df.columns)})"

    def describe(self) -> DataFrame:
        return self._df.summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")

    def summary(self) -> str:
        lines = [f"test: {self.metadata.get('test_name', 'unknown')}", f"rows: {len(self)}"]
        lines += [f"{k}: {v}" for k, v in self.metadata.items() if k != "test_name"]
        text = "\n".join(lines)
        print(text)
        return text

    def filter(self, variable=None, source=None, horizon=None, **columns) -> TestResult:
        df = self._df
        for name, wanted in {"variable": variable, "horizon": horizon, **columns}.items():
            if wanted is not None:
                if name not in df.columns:
                    raise KeyError(f"the result has no column {name!r}")
                df = df.where(F.col(name).isin(listed(wanted)))
        if source is not None:
            df = filter_sources(df, listed(source))
        return TestResult(df, self.id_columns, self.metadata)

    def to_csv(self, path: str | os.PathLike | None = None, **kwargs) -> str | None:
        """Text without a path; with one, Spark writes a folder of CSV there."""
        if path is None:
            return self._df.toPandas().to_csv(index=False, **kwargs)
        self._df.write.mode("overwrite").option("header", True).csv(str(path), **kwargs)
        return None

    def plot_data(self, **args) -> DataFrame:
        from . import plot_data

        return plot_data.of_result(self, **args)

    def plot(self, *, existing_plot=None, custom_labels: dict[str, str] | None = None, title: str | None = None, **args):
        """Draws where matplotlib is installed; otherwise gives the chart's data."""
        from . import drawing, plot_data

        return drawing.draw(plot_data.of_result(self, **args), plot_data.chart_of(self), existing_plot=existing_plot, custom_labels=custom_labels, title=title)
