"""Structured Streaming wrappers: serial parsing of micro-batches, newest request of each session, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; works on batches and on streams (complete or update mode)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row")).select(key, "row.*")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Apply a batch operator to each micro-batch in turn; a batch that is run again overwrites its own folder."""

    def write(df: DataFrame, epoch: int) -> None:
        apply(df).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, under a watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
