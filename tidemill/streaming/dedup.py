"""The batch rule "first of each key" on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose key wasn't seen within the watermark's delay; state is kept no longer."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """``(begin, end, keys, n)`` by tumbling window; rows later than the delay are left out."""
    held = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return held.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *keys, "n")
