"""Forecast metrics per series, all from one pass over the aligned steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .impute import S

#: The metrics in their order, and whether sums or the greatest of them matter where validations meet.
NAMES = (
    "smape", "mae", "rmse", "made", "mage", "mate", "matse", "underestimate", "mle", "overestimate", "imle", "spl", "containment", "contour", "maxe", "oda", "dwae", "mqae",
    "ewmae", "uwmse", "smoothness", "wasserstein", "dwd", "custom",
)


def scale_of(train: DataFrame, rows: int = 100) -> DataFrame:
    """series_id, scaler, last: the mean absolute step of the last rows and the last known value.

    A scaler of 0, or of a series without steps, becomes the greatest of the panel, or 1; a series
    without a value ends at 0. The panel's greatest is one row, broadcast.
    """
    back = F.row_number().over(S().orderBy(F.col("ds").desc()))
    tail = train.withColumn("_r", back).where(F.col("_r") <= rows)
    step = F.abs(F.col("y") - F.lead("y").over(S().orderBy("_r")))
    known = F.when(F.col("y").isNotNull(), F.col("_r"))
    each = tail.withColumn("_d", step).groupBy("series_id").agg(F.nullif(F.avg("_d"), F.lit(0.0)).alias("_s"), F.coalesce(F.min_by("y", known), F.lit(0.0)).alias("last")).withColumn("_k", F.lit(1))
    most = each.agg(F.max("_s").alias("_most")).withColumn("_k", F.lit(1))
    return each.join(F.broadcast(most), "_k").select("series_id", F.coalesce("_s", "_most", F.lit(1.0)).alias("scaler"), "last")


def align(forecast: DataFrame, actual: DataFrame, scale: DataFrame) -> DataFrame:
    """Steps of forecast and actual with the errors, steps and running sums that metrics need.

    A missing actual is carried forward in `ya` only where a sum runs over it as nothing.
    """
    w = S().orderBy("step")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = forecast.join(actual.select("series_id", "step", "y"), ["series_id", "step"]).join(scale, "series_id")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.when(F.col("step") == F.min("step").over(S()), F.col("last")))
    rows = rows.withColumns({"e": F.col("forecast") - F.col("y"), "da": F.col("y") - before("y"), "df": F.col("forecast") - before("forecast"), "h": F.count("*").over(S())})
    rows = rows.withColumns({"ae": F.abs("e"), "d2": F.col("df") - F.lag("df").over(w)})
    return rows.withColumns(
        {
            "ca": F.coalesce(F.sum("y").over(run), F.lit(0.0)), "cf": F.sum("forecast").over(run), "cda": F.coalesce(F.sum(F.abs("da")).over(run), F.lit(0.0)), "cdf": F.sum(F.abs("df")).over(run),
            "rank": F.row_number().over(S().orderBy(F.col("ae").asc_nulls_last(), "step")),
        }
    )


def _columns(interval: float, custom: Callable[[], Column] | None) -> dict[str, Column]:
    e, ae, p, y, f = F.col("e"), F.col("ae"), interval, F.col("y"), F.col("forecast")
    scaler, h = F.first("scaler"), F.first("h")
    up = F.when(y >= F.col("upper"), p * (y - F.col("upper"))).otherwise((1 - p) * (F.col("upper") - y))
    low = F.when(y >= F.col("lower"), (1 - p) * (y - F.col("lower"))).otherwise(p * (F.col("lower") - y))
    zero = F.lit(0.0)
    share = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("double")) / h
    known = F.count("y") > 0
    same_way = F.signum(f - F.col("last")) == F.signum(y - F.col("last"))
    keep = F.greatest(F.floor(F.col("h") * 0.85), F.lit(1))
    peak = F.greatest(F.lit(5.0), 0.1 * F.col("h"))
    u = F.when(F.col("step") == 1, peak).when(F.col("step") == F.col("h"), peak / 2).otherwise(1.0)
    mean0 = lambda c: F.avg(F.coalesce(c, zero))
    jump = F.when(F.first("h") < 3, F.avg(F.abs("df"))).otherwise(F.avg(F.abs("d2")))
    return {
        "smape": 200 * F.sum(F.coalesce(ae / F.nullif(F.abs(f) + F.abs(y), zero), zero)) / F.nullif(F.count("y"), F.lit(0)),
        "mae": F.avg(ae),
        "rmse": F.sqrt(F.avg(e * e)),
        "made": F.avg(F.abs(F.col("da") - F.col("df"))) / scaler,
        "mage": F.first("_mage"),
        "mate": F.abs(F.coalesce(F.sum(e), zero)),
        "matse": F.abs(F.coalesce(F.sum(e), zero)) / F.coalesce(F.nullif(F.sum(F.abs(y)), zero), F.lit(1.0)),
        "underestimate": F.sum(F.when(e <= 0, e).otherwise(0.0)),
        "mle": F.avg(F.when(e > 0, F.log1p(ae)).otherwise(ae)),
        "overestimate": F.sum(F.when(e > 0, e).otherwise(0.0)),
        "imle": F.avg(F.when(e < 0, F.log1p(ae)).otherwise(ae)),
        "spl": F.avg(up + low) / scaler,
        "containment": share(y.between(F.col("lower"), F.col("upper"))),
        "contour": share((F.col("da") >= 0) == (F.col("df") > 0)),
        "maxe": F.max(F.coalesce(ae, zero)),
        "oda": share(same_way),
        "dwae": F.sqrt(F.sum(F.coalesce(F.when(same_way, ae).otherwise(e * e + 1), zero)) / h / scaler + 1),
        "mqae": F.avg(F.when(F.col("rank") <= keep, ae)),
        "ewmae": mean0(ae * F.pow(F.lit(10.0), (F.col("step") - 1) / F.greatest(F.col("h") - 1, F.lit(1)))),
        "uwmse": mean0(ae * u * ae * u) / scaler,
        "smoothness": F.log1p(F.round(jump, 12)),
        "wasserstein": F.when(F.count("forecast") > 0, F.avg(F.abs(F.col("cf") - F.col("ca")))) / scaler,
        "dwd": F.when(F.count("forecast") > 0, F.avg(F.abs(F.col("cdf") - F.col("cda")))) / scaler,
        "custom": custom() if custom else F.lit(0.0),
    }


def evaluate(forecast: DataFrame, actual: DataFrame, train: DataFrame, interval: float = 0.9, custom: Callable[[], Column] | None = None) -> DataFrame:
    """Metrics of (series_id, step, forecast, lower, upper) against (series_id, step, y).

    A series without an actual has nulls or zeroes as each metric's definition says; custom: a
    function that gives an aggregate over y, forecast, lower, upper, e and step.
    """
    rows = align(forecast, actual, scale_of(train))
    # |sum over series| a step, then the mean over steps: one row for all, broadcast.
    total = rows.groupBy("step").agg(F.abs(F.coalesce(F.sum("e"), F.lit(0.0))).alias("m")).agg(F.avg("m").alias("_mage")).withColumn("_k", F.lit(1))
    rows = rows.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    return rows.groupBy("series_id").agg(*[c.alias(k) for k, c in _columns(interval, custom).items()])


def averaged(metrics: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Means of the metrics over series, or weighted ones: a null metric counts as nothing above
    the line while its weight stays below it."""
    names = [c for c in metrics.columns if c != "series_id"]
    if weights is None:
        return metrics.agg(*[F.avg(c).alias(c) for c in names])
    held = metrics.join(weights.select("series_id", F.col("weight").alias("_w")), "series_id", "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    return held.agg(*[(F.sum(F.coalesce(F.col(c) * F.col("_w"), F.lit(0.0))) / F.sum("_w")).alias(c) for c in names])


def per_step(forecast: DataFrame, actual: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted SMAPE of each step over all series."""
    rows = forecast.join(actual.select("series_id", "step", "y"), ["series_id", "step"]).join(weights.select("series_id", "weight"), "series_id")
    one = 200 * F.abs(F.col("forecast") - F.col("y")) / F.nullif(F.abs("forecast") + F.abs("y"), F.lit(0.0))
    return rows.groupBy("step").agg((F.sum(F.coalesce(one, F.lit(0.0)) * F.col("weight")) / F.sum("weight")).alias("smape"))


def clean_weights(panel: DataFrame, given: DataFrame) -> DataFrame:
    """series_id, weight for every series: what is given (as text or number) without its sign, else 1."""
    names = panel.select("series_id").distinct()
    w = F.abs(F.col("weight").cast("string").try_cast("double"))
    return names.join(given.select("series_id", w.alias("weight")), "series_id", "left").select("series_id", F.coalesce(F.nanvl("weight", F.lit(1.0)), F.lit(1.0)).alias("weight"))


# Helpers outside of the table


def extra(rows: DataFrame) -> DataFrame:
    """mda, medae, qae, msle-like and threshold losses of aligned rows (series_id, step, y, forecast, da, df, e, ae, h)."""
    return rows.groupBy("series_id").agg(
        (F.count_if(F.signum("da") == F.signum("df")) / F.first("h")).alias("mda"),
        F.percentile("ae", F.lit(0.5)).alias("medae"),
        F.percentile("ae", F.lit(0.9)).alias("qae"),
        F.avg(F.when(F.col("y") * 0.9 >= F.col("forecast"), 2 * F.col("ae")).otherwise(F.col("ae"))).alias("threshold_loss"),
        F.avg(F.abs(F.log1p(F.abs("forecast")) - F.log1p(F.abs("y")))).alias("mlvb"),
        F.coalesce(F.corr("step", "forecast"), F.lit(1.0)).alias("linearity"),
    )


def ranked_probability(ranks: DataFrame, key: list[str], place: str, p: str, happened: str) -> DataFrame:
    """Sum of squared differences of running probabilities and outcomes over ordered places, by key."""
    w = Window.partitionBy(*key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    held = ranks.withColumn("_g", F.sum(p).over(w) - F.sum(happened).over(w))
    return held.groupBy(*key).agg((F.sum(F.col("_g") * F.col("_g")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("rps"))


def histogram_distance(a: DataFrame, b: DataFrame, bins: int = 20) -> DataFrame:
    """Chi-squared distance of two samples (series_id, y) of each series over bins of their common range."""
    both = a.select("series_id", "y", F.lit(1.0).alias("_a"), F.lit(0.0).alias("_b")).unionByName(b.select("series_id", "y", F.lit(0.0).alias("_a"), F.lit(1.0).alias("_b"))).where("y IS NOT NULL")
    lo, hi = F.min("y").over(S()), F.max("y").over(S())
    held = both.withColumn("_bin", F.least(F.floor((F.col("y") - lo) * bins / F.nullif(hi - lo, F.lit(0.0))), F.lit(bins - 1)))
    share = held.groupBy("series_id", "_bin").agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    share = share.withColumns({"a": F.col("a") / F.sum("a").over(S()), "b": F.col("b") / F.sum("b").over(S())})
    d = F.col("a") - F.col("b")
    return share.groupBy("series_id").agg((F.sum(d * d / F.nullif(F.col("a") + F.col("b"), F.lit(0.0))) / 2).alias("distance"))
