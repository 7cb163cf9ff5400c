"""New releases as a stream: each micro-batch is checked and appended like a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.container import unknown_rows
from ..sources import schema


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows whose key the table lacks; a repeated batch appends nothing.

    Rows whose key is there with quite another value fail the batch, as they fail a
    container; those with nearly the same are left out with a warning.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  the table isn't there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = None
    if old is not None:
        fresh = unknown_rows(fresh, old.select(*keys, "value"))
    fresh.write.mode("append").parquet(path)


def ingest_outturns(spark: SparkSession, source: str, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Reads parquet files of releases as they appear and keeps the outturn table."""
    stream = spark.readStream.schema("date date, vintage_date date, variable string, frequency string, value double, metric string").parquet(source)
    keys = ["date", "vintage_date", "variable", "frequency", "metric"]

    def run(batch: DataFrame, _: int) -> None:
        checked = schema.with_distance(schema.validate(batch, schema.fields(False, ["metric"])))
        append_new(checked, path, keys)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
