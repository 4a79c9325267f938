"""Statistics of series and of groups of series, all with partial aggregation before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .impute import S, T


def weights(panel: DataFrame) -> DataFrame:
    """Series weights by statistic; the inverse of a mean of 0 is null."""
    return panel.groupBy("series_id").agg(F.avg("y").alias("mean"), F.median("y").alias("median"), F.min("y").alias("min"), F.max("y").alias("max"), (1 / F.nullif(F.avg("y"), F.lit(0.0))).alias("inverse_mean"))


def profile(panel: DataFrame) -> DataFrame:
    """Size, moments, quartiles, squared variation and demand interval, lag-1 correlation and
    share of unchanged steps of every series."""
    held = panel.withColumn("_p", F.lag("y").over(T()))
    q = lambda p: F.percentile("y", F.lit(p))
    mean = F.nullif(F.avg("y"), F.lit(0.0))
    return held.groupBy("series_id").agg(
        F.count("y").alias("n"),
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std"),
        F.min("y").alias("min"),
        q(0.25).alias("q25"),
        q(0.5).alias("median"),
        q(0.75).alias("q75"),
        F.max("y").alias("max"),
        F.pow(F.stddev_samp("y") / mean, F.lit(2.0)).alias("cv2"),
        F.pow(F.count("y") / F.nullif(F.count_if(F.col("y") != 0), F.lit(0)), F.lit(2.0)).alias("adi2"),
        (F.covar_pop("y", "_p") / F.nullif(F.stddev_pop(F.when(F.col("_p").isNotNull(), F.col("y"))) * F.stddev_pop("_p"), F.lit(0.0))).alias("autocorrelation"),
        F.avg((F.col("y") == F.col("_p")).cast("double")).alias("unchanged"),
    )


def trimmed_mean(panel: DataFrame, share: float = 0.2) -> DataFrame:
    """Mean without the ceil(share * n) smallest and as many largest values."""
    held = panel.where("y IS NOT NULL").withColumn("_r", F.row_number().over(S().orderBy("y"))).withColumn("_n", F.count("*").over(S()))
    cut = F.ceil(F.col("_n") * share)
    return held.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)).groupBy("series_id").agg(F.avg("y").alias("y"))


def mode(panel: DataFrame) -> DataFrame:
    """The most frequent value, of several the smallest; each value is counted before series meet."""
    counts = panel.where("y IS NOT NULL").groupBy("series_id", "y").agg(F.count("*").alias("_n"))
    return counts.groupBy("series_id").agg(F.max(F.struct("_n", (-F.col("y")).alias("v"))).alias("b")).select("series_id", (-F.col("b.v")).alias("y"))


def time_weighted_mean(panel: DataFrame) -> DataFrame:
    """Mean weighted by the days since the series began."""
    first = panel.groupBy("series_id").agg(F.min("ds").alias("_first"))
    w = F.datediff("ds", "_first").cast("double")
    return panel.where("y IS NOT NULL").join(first, "series_id").groupBy("series_id").agg((F.sum(w * F.col("y")) / F.nullif(F.sum(w), F.lit(0.0))).alias("y"))


def group_shares(totals: DataFrame, group: str, value: str) -> DataFrame:
    """Each row's share of its group's sum of absolute values."""
    return totals.withColumn("share", F.abs(value) / F.nullif(F.sum(F.abs(value)).over(Window.partitionBy(group)), F.lit(0.0)))


def reconcile_mean(bottom: DataFrame, top: DataFrame, shares: DataFrame) -> DataFrame:
    """Bottom forecasts moved half way towards their groups' own forecasts, by historic share.

    bottom: series_id, grp, step, forecast; top: grp, step, forecast; shares: series_id, share.
    """
    summed = bottom.groupBy("grp", "step").agg(F.sum("forecast").alias("_sum"))
    gap = top.join(summed, ["grp", "step"]).select("grp", "step", ((F.col("forecast") - F.col("_sum")) / 2).alias("_gap"))
    return bottom.join(gap, ["grp", "step"]).join(shares, "series_id").select("series_id", "step", (F.col("forecast") + F.col("share") * F.col("_gap")).alias("forecast"))
