"""Drift of values per window, as a stream: an extension beyond batch parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_drift(events: DataFrame, time: str = "ts", by: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window start, by, n, mean, std): works on batch and streaming frames; rows later than `late` are dropped by a stream only."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    g = source.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))
