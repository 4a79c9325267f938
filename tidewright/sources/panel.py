"""Panels of series in long form (series_id, ds, y): from tables, on a spine, split in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roll_up(df: DataFrame, series: Column, at: Column, value: Column) -> DataFrame:
    """One row a series and step, pre-aggregated before its only shuffle; NaN counts as missing."""
    return df.groupBy(series.alias("series_id"), at.alias("ds")).agg(F.round(value, 2).alias("y"))


def long_from_wide(df: DataFrame, ds: str) -> DataFrame:
    """A wide table (a column a series) in long form, dates first."""
    values = [c for c in df.columns if c != ds]
    return df.unpivot(ds, values, "series_id", "y").select("series_id", F.col(ds).alias("ds"), F.nanvl(F.col("y").cast("double"), F.lit(None)).alias("y"))


#: Ways to make one value of several of a series at a time, by name.
AGGREGATES = {
    "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max,
    "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
}


def wide_from_long(panel: DataFrame, series: list[str] | None = None, aggfunc="first", order: str | None = None) -> DataFrame:
    """A column for each series. Naming them spares a pass over the data; else their distinct
    names are collected, as a wide table has to fit its columns in a plan anyway.

    aggfunc: a name of `AGGREGATES` or a function of a column. `first` takes the first known value
    by `order`, a column that settles which that is. Rows without a name are the series 'First'.
    """
    held = panel.withColumn("series_id", F.coalesce("series_id", F.lit("First")))
    names = series or sorted(r[0] for r in held.select("series_id").distinct().collect())
    if order and aggfunc == "first":
        known = F.col("y").isNotNull()
        f = F.min_by(F.when(known, F.col("y")), F.when(known, F.col(order)))
    else:
        f = (AGGREGATES[aggfunc] if isinstance(aggfunc, str) else aggfunc)("y")
    return held.groupBy("ds").pivot("series_id", names).agg(f)


def regularise(panel: DataFrame, step: str = "1 day") -> DataFrame:
    """Every series on every step from the panel's first to its last; absent cells are null.

    The spine is made from the series' names alone, so only they and the cells are shuffled.
    """
    # The bounds are one row, so they meet the names in a broadcast and no job runs before the plan's.
    bounds = panel.agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi")).withColumn("_k", F.lit(1))
    names = panel.select("series_id").distinct().withColumn("_k", F.lit(1)).join(F.broadcast(bounds), "_k")
    spine = names.where("_lo IS NOT NULL").select("series_id", F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias("ds"))
    return spine.join(panel, ["series_id", "ds"], "left").select("series_id", "ds", "y")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return regularise(roll_up(o, F.col("o_orderpriority"), F.col("o_orderdate").cast("date"), F.sum("o_totalprice")))


def holdout(panel: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """History and the last `horizon` steps, the latter numbered from 1. Both come from one
    numbering from the end, so no count of a series is needed."""
    placed = panel.withColumn("_r", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ds").desc())))
    train = placed.where(F.col("_r") > horizon).drop("_r")
    test = placed.where(F.col("_r") <= horizon).withColumn("step", (horizon + 1 - F.col("_r")).cast("int")).drop("_r")
    return train, test


def train_test(panel: DataFrame, horizon: int, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """`holdout`, but too short a history is an error: it needs `least` times the horizon in rows."""
    n = panel.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if horizon * least > n - horizon:
        raise ValueError(f"{n} rows are too few for a horizon of {horizon}")
    return holdout(panel, horizon)
