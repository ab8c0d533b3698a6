"""Streams of normalized events: dedup, day rollups, ingest of JSON-lines folders.

An addition of this engine; batch reading is the main way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import aggregates
from ..schema import USAGE_EVENT


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events from files of one JSON event a line, as they arrive."""
    return spark.readStream.schema(USAGE_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_millis("ts_ms"))


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """First arrival of each (harness, message_id) within the watermark; state ends with it."""
    return with_event_time(events).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["harness", "message_id"])


def rollup_stream(events: DataFrame, by: str = "model", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rollups of ``by`` per tumbling window; a window is final once the watermark has passed it."""
    timed = events if "event_time" in events.columns else with_event_time(events).withWatermark("event_time", late)
    grouped = timed.groupBy(F.window("event_time", width).alias("window"), F.col(by).alias("key")).agg(*aggregates())
    return grouped.select(F.col("window.start").alias("window_start"), "key", *[c for c in grouped.columns if c not in ("window", "key")])
