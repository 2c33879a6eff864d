"""Streams of pipeline events."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; works on a stream (with a watermark) and on a table alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "n")


def live_until(events: DataFrame, ttl: datetime.timedelta, now: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """Keys with an event in the ``ttl`` before ``now`` (ISO text, read as the type of the time column), and when it was. Null times and keys count like any value."""
    start = F.lit(now).cast(dict(events.dtypes)[time]) - F.lit(ttl)
    return events.where(F.col(time) > start).groupBy(key).agg(F.max(time).alias("last_seen"))
