"""Streaming ingest of the usage log: each run once, in spite of replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each_run(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Drop repeated run_ids that arrive within the watermark; state is bounded by it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id"])


def runs_per_window(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, command, runs) by event time."""
    w = F.window("ts", window)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "command").agg(F.count("*").alias("runs")).select(F.col("w.start").alias("start"), "command", "runs")


def ingest(stream: DataFrame, folder: str, checkpoint: str):
    """Append each run once to a Parquet folder, as far as the input has come."""
    writer = first_of_each_run(stream).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
