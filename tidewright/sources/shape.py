"""Shaping of panels and generated panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_S = lambda: Window.partitionBy("series_id")


def generated(spark: SparkSession, kind: str, series: int = 5, rows: int = 200, start: str = "2021-01-01") -> DataFrame:
    """Panels of zeroes, of lines (the k-th has slope k) and of sines, made by the executors."""
    cells = spark.range(series * rows).select((F.col("id") % series + 1).alias("k"), F.floor(F.col("id") / series).cast("int").alias("t"))
    y = {"zeroes": F.lit(0.0), "linear": (F.col("k") * (F.col("t") + 1)).cast("double"), "sine": F.sin(F.col("k") * (F.col("t") + 1))}[kind]
    return cells.select(F.concat(F.lit("s"), "k").alias("series_id"), F.date_add(F.lit(start).cast("date"), F.col("t")).alias("ds"), y.alias("y"))


def first_valid(panel: DataFrame) -> DataFrame:
    return panel.where("y IS NOT NULL").groupBy("series_id").agg(F.min("ds").alias("ds"))


def without_leading_zeros(panel: DataFrame) -> DataFrame:
    """Zeros before a series' first other value become null, but its last row stays as it is."""
    w = _S().orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("ds").over(_S()) == F.col("ds")
    return panel.withColumn("y", F.when((F.coalesce(F.sum(F.abs("y")).over(w), F.lit(0.0)) > 0) | last, F.col("y"))).select("series_id", "ds", "y")


def future(panel: DataFrame, horizon: int) -> DataFrame:
    """The days that follow each series, numbered from 1."""
    return panel.groupBy("series_id").agg(F.max("ds").alias("_d")).select("series_id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "_d").select("series_id", "step", F.date_add("_d", F.col("step")).alias("ds"))
