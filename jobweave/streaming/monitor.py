"""New postings as a stream: arriving batches against a snapshot of known keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watch(stream: DataFrame, known: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key isn't known, each key once within ``delay`` of event time.

    ``known`` is a static table; the anti join needs no state. State for
    repeated deliveries is bounded by the watermark.
    """
    fresh = stream.join(known.select(key).distinct(), key, "left_anti")
    return fresh.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, group: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows by time window and group; late rows count until the watermark passes."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), group).count()
