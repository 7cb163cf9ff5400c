"""Loaders of a published report's tables, kept as parquet in a folder of the user's."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def report_folder() -> str:
    """``TIDEMARK_REPORT_DATA``: a path that Spark can read."""
    path = os.environ.get("TIDEMARK_REPORT_DATA")
    if not path:
        raise FileNotFoundError("set TIDEMARK_REPORT_DATA to the folder that holds outturns.parquet and forecasts.parquet")
    return path.rstrip("/")


def _load(name: str, minimal: bool, folder: str | None, spark: SparkSession | None) -> DataFrame:
    spark = spark or SparkSession.builder.getOrCreate()
    df = spark.read.parquet(f"{folder or report_folder()}/{name}.parquet")
    if minimal:  # a small, recent part; both predicates reach the scan
        df = df.where("variable in ('gdpkp', 'cpisa') and date between date'2018-01-01' and date'2019-12-31'")
    return df


def load_report_outturns(minimal: bool = False, folder: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    return _load("outturns", minimal, folder, spark)


def load_report_forecasts(minimal: bool = False, folder: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    return _load("forecasts", minimal, folder, spark)
