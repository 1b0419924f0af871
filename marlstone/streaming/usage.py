"""The hourly trend over a stream of logs, and other streams that end in a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def trend(logs: DataFrame, late: str = "1 hour", span: str = "1 hour") -> DataFrame:
    """Calls and tokens by hour of a stream with a timestamp; an hour is final once the watermark has passed it."""
    stamped = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    grouped = stamped.groupBy(F.window("timestamp", span)).agg(F.count("id").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
    return grouped.select(F.date_format("window.start", "yyyy-MM-dd HH:00").alias("hour"), "calls", "tokens")


def distinct_logs(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Logs without repeats of an id within the watermark."""
    return logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])


def to_table(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Starts a stream that hands each batch to write and stops when all there is has been read."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
