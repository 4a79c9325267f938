"""Ensembles and model selection over long tables (model, series_id, step, forecast)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stack(forecasts: dict[str, DataFrame]) -> DataFrame:
    """Forecasts of several models as one table."""
    return reduce(DataFrame.unionByName, [f.select(F.lit(m).alias("model"), "series_id", "step", "forecast") for m, f in forecasts.items()])


def simple(models: DataFrame, how: str = "mean") -> DataFrame:
    f = F.avg("forecast") if how == "mean" else F.median("forecast")
    return models.groupBy("series_id", "step").agg(f.alias("forecast"))


def distance(models: DataFrame, near: str, far: str, steps: int) -> DataFrame:
    """The first steps from one model, the others from another."""
    return models.where(F.when(F.col("step") <= steps, F.col("model") == near).otherwise(F.col("model") == far)).select("series_id", "step", "forecast")


def errors(models: DataFrame, actual: DataFrame) -> DataFrame:
    return models.join(actual.select("series_id", "step", "y"), ["series_id", "step"]).withColumn("ae", F.abs(F.col("forecast") - F.col("y")))


def _best(errs: DataFrame, key: list[str]) -> DataFrame:
    """The model of least mean absolute error for each key; ties go to the first name."""
    mae = errs.groupBy(*key, "model").agg(F.round(F.avg("ae"), 6).alias("mae"))
    return mae.groupBy(*key).agg(F.min(F.struct("mae", "model")).alias("b")).select(*key, F.col("b.model").alias("model"))


def horizontal(models: DataFrame, errs: DataFrame) -> DataFrame:
    """Each series takes its best model."""
    return models.join(_best(errs, ["series_id"]), ["series_id", "model"]).select("series_id", "step", "model", "forecast")


def mosaic(models: DataFrame, errs: DataFrame) -> DataFrame:
    """Each step of each series takes its best model."""
    return models.join(_best(errs, ["series_id", "step"]), ["series_id", "step", "model"]).select("series_id", "step", "model", "forecast")


def score(errs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Metrics of each model, averaged over series, and the sum of their weighted ratios to the
    least one that is not 0; a lower score is better. Models are few, so one window holds them."""
    e = F.col("forecast") - F.col("y")
    per = errs.groupBy("model", "series_id").agg(F.avg("ae").alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (200 * F.avg(F.col("ae") / F.nullif(F.abs("forecast") + F.abs("y"), F.lit(0.0)))).alias("smape"))
    means = per.groupBy("model").agg(*[F.avg(m).alias(m) for m in ("mae", "rmse", "smape")])
    least = means.agg(*[F.min(F.when(F.col(m) != 0, F.col(m))).alias(f"_{m}") for m in weights])
    return means.join(F.broadcast(least)).select("model", "mae", "rmse", "smape", sum((w * F.coalesce(F.col(m) / F.col(f"_{m}"), F.lit(0.0)) for m, w in weights.items()), F.lit(0.0)).alias("score"))


def top_per_group(df: DataFrame, group: str, by: list[str], n: int) -> DataFrame:
    """The first n rows of a group in the order of `by`, numbered; Spark drops others before it shuffles."""
    w = Window.partitionBy(group).orderBy(*by)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def backward_splits(panel: DataFrame, horizon: int, n: int) -> DataFrame:
    """validation, series_id, train_rows, test_start, test_end: windows of `horizon` rows counted
    back from the end of each series, as one pass for all of them."""
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ds").desc()))
    held = panel.withColumn("_v", F.floor((back - 1) / horizon).cast("int")).withColumn("_n", F.count("*").over(Window.partitionBy("series_id")))
    return held.where(F.col("_v") < n).groupBy(F.col("_v").alias("validation"), "series_id").agg((F.first("_n") - (F.first("_v") + 1) * horizon).alias("train_rows"), F.min("ds").alias("test_start"), F.max("ds").alias("test_end"))


def weighted(models: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the models' forecasts; a missing one counts neither above nor below the line."""
    w = F.lit(0.0)
    for m, x in weights.items():
        w = F.when(F.col("model") == m, F.lit(float(x))).otherwise(w)
    held = models.where("forecast IS NOT NULL").withColumn("_w", w)
    return held.groupBy("series_id", "step").agg((F.sum(F.col("_w") * F.col("forecast")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("forecast"))


def midhinge(models: DataFrame) -> DataFrame:
    """The mean of the models' quartiles."""
    q = lambda p: F.percentile("forecast", F.lit(p))
    return models.groupBy("series_id", "step").agg(((q(0.25) + q(0.75)) / 2).alias("forecast"))


def mosaic_smoothed(models: DataFrame, errs: DataFrame, window: int = 3) -> DataFrame:
    """As `mosaic`, with errors averaged over the steps around before models are compared."""
    w = Window.partitionBy("series_id", "model").orderBy("step").rowsBetween(-(window // 2), window // 2)
    each = errs.groupBy("series_id", "model", "step").agg(F.avg("ae").alias("ae")).withColumn("a", F.round(F.avg("ae").over(w), 6))
    best = each.groupBy("series_id", "step").agg(F.min(F.struct("a", "model")).alias("b")).select("series_id", "step", F.col("b.model").alias("model"))
    return models.join(best, ["series_id", "step", "model"]).select("series_id", "step", "model", "forecast")


def limited(models: DataFrame, errs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Forecasts and errors of the n models that are best over all series; models are few."""
    mean = errs.groupBy("model", "series_id").agg(F.avg("ae").alias("a")).groupBy("model").agg(F.round(F.avg("a"), 6).alias("a"))
    keep = F.broadcast(mean.orderBy("a", "model").limit(n).select("model"))
    return models.join(keep, "model", "left_semi"), errs.join(keep, "model", "left_semi")


def unpredictability(errs: DataFrame) -> DataFrame:
    """series_id, score: how large all models' errors are against the series, from 0 (the least) to 1."""
    each = errs.groupBy("series_id").agg((F.avg("ae") / F.nullif(F.avg(F.abs("y")), F.lit(0.0))).alias("u")).withColumn("_k", F.lit(1))
    ends = each.agg(F.min("u").alias("lo"), F.max("u").alias("hi")).withColumn("_k", F.lit(1))
    return each.join(F.broadcast(ends), "_k").select("series_id", ((F.col("u") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("score"))
