"""Roll-ups over event time that run alike on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    held = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return held.withWatermark(ts, late) if held.isStreaming else held


def _rolled(events: DataFrame, window: Column, key: str, value: str) -> DataFrame:
    return events.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling(events: DataFrame, size: str, key: str, value: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """n and total a window and key; on a stream, rows later than `late` are left out."""
    return _rolled(_timed(events, ts, late), F.window(ts, size), key, value)


def sliding(events: DataFrame, size: str, slide: str, key: str, value: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return _rolled(_timed(events, ts, late), F.window(ts, size, slide), key, value)


def sessions(events: DataFrame, gap: str, key: str, value: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Runs of a key's rows that are less than `gap` apart."""
    return _rolled(_timed(events, ts, late), F.session_window(ts, gap), key, value)
