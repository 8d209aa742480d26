"""Streams: windowed counts with late data, and scores that accumulate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, by: str, value: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of tumbling windows; rows later than ``late`` behind the newest are left out of a stream."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, length), by)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("begin"), by, "n", "total")
    )


def confusion_into(path: str):
    """For foreachBatch: adds a batch's confusion counts to a folder, one subfolder a batch, so a repeat replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("decision", "predicted").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def accumulated(counts: DataFrame) -> DataFrame:
    return counts.groupBy("decision", "predicted").agg(F.sum("n").alias("n"))
