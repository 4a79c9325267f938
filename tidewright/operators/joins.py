"""As-of and nearest-value joins within a series, by one sorted union instead of a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .impute import S


def as_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows (series_id, ds, y) with `value`: y of the last right row at or before ds."""
    both = left.select("series_id", "ds", "y", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v")).unionByName(right.select("series_id", "ds", F.lit(None).cast("double").alias("y"), F.lit(0).alias("_side"), F.col("y").alias("_v")))
    w = S().orderBy("ds", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("series_id", "ds", "y", "value")


def nearest_value(forecast: DataFrame, history: DataFrame, window: int | None = None) -> DataFrame:
    """Forecasts (series_id, step, forecast), each replaced by its series' nearest historic value,
    of the last `window` rows if that is given; of two as near the smaller."""
    if window:
        history = history.withColumn("_r", F.row_number().over(S().orderBy(F.col("ds").desc()))).where(F.col("_r") <= window).drop("_r")
    both = forecast.select("series_id", "step", F.col("forecast").alias("_v"), F.lit(None).cast("double").alias("_h")).unionByName(history.where("y IS NOT NULL").select("series_id", F.lit(None).cast("int").alias("step"), F.col("y").alias("_v"), F.col("y").alias("_h")).distinct())
    up, down = (S().orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("_v"), F.col("_v").desc()))
    below, above = F.last("_h", ignorenulls=True).over(up), F.last("_h", ignorenulls=True).over(down)
    held = both.withColumns({"_b": below, "_a": above}).where(F.col("step").isNotNull())
    near = F.when(F.col("_a").isNull() | (F.col("_v") - F.col("_b") <= F.col("_a") - F.col("_v")), F.col("_b")).otherwise(F.col("_a"))
    return held.select("series_id", "step", near.alias("forecast"))


def align_regressor(panel: DataFrame, regressor: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """The panel with the columns of a regressor (ds, ...) of its dates; where it has none, `fill`."""
    names = [c for c in regressor.columns if c != "ds"]
    joined = panel.join(regressor, "ds", "left")
    return joined.select("series_id", "ds", "y", *[F.coalesce(c, F.lit(fill)).alias(c) for c in names])


def on_dates(panel: DataFrame, splits: DataFrame, split: int, role: str) -> DataFrame:
    """The rows on the dates of a split table (split, role, ds): a semi join."""
    dates = splits.where((F.col("split") == split) & (F.col("role") == role))
    return panel.join(dates, "ds", "left_semi")


#: What a template is: two rows alike in these are the same.
TEMPLATE = ("model", "params", "transforms", "ensemble")


def untried(templates: DataFrame, known: DataFrame) -> DataFrame:
    """Templates that are not among the known ones, each once."""
    return templates.dropDuplicates(list(TEMPLATE)).join(known, list(TEMPLATE), "left_anti")


def in_both(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that both tables hold."""
    return a.select(*key).intersect(b.select(*key))


def with_extremes(results: DataFrame, per_series: DataFrame) -> DataFrame:
    """Results (id, ...) with the least and the greatest per-series error of each id, where it has any."""
    found = per_series.groupBy("id").agg(F.min("mae").alias("least_mae"), F.max("mae").alias("most_mae"))
    return results.join(found, "id", "left")


def events_of_market(points: DataFrame, gap: int = 14, share: float = 0.3) -> DataFrame:
    """Changepoints (series_id, ds) of all series put together where neighbours are at most `gap`
    days apart: start, end, points and series of each group that enough series agree on.

    Dates are few against points, so they are counted before the one window over all of them.
    """
    dates = points.groupBy("ds").agg(F.count("*").alias("points"))
    w = Window.orderBy("ds")
    new = F.coalesce((F.datediff("ds", F.lag("ds").over(w)) > gap).cast("int"), F.lit(1))
    grouped = dates.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("ds", "grp")
    total = points.agg(F.count_distinct("series_id").alias("_n")).withColumn("_k", F.lit(1))
    found = points.join(grouped, "ds").groupBy("grp").agg(F.min("ds").alias("start"), F.max("ds").alias("end"), F.count("*").alias("points"), F.count_distinct("series_id").alias("series"))
    held = found.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    return held.where(F.col("series") >= share * F.col("_n")).select("start", "end", "points", "series")
