"""Streams of records: first occurrences, duplicate counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_occurrences(stream: DataFrame, key: list[str], time_col: str, delay: str) -> DataFrame:
    """Each key's first record within the watermark's reach; state older than `delay` is dropped."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(key)


def windowed_duplicates(stream: DataFrame, key: list[str], time_col: str, delay: str, width: str) -> DataFrame:
    """Keys that occur more than once in an event-time window, with the count."""
    grouped = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width), *key).agg(F.count("*").alias("count"))
    return grouped.filter(F.col("count") > 1)
