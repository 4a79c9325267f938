"""Spark-native analytics on panels of time series held in long form (series_id, ds, y)."""

__version__ = "0.1.0"
