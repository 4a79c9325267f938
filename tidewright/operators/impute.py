"""Filling of missing cells. Every method is one window over a series, sorted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Windows need a session, so they are made when they are asked for.
S = lambda: Window.partitionBy("series_id")
T = lambda: S().orderBy("ds")
BEFORE = lambda: T().rowsBetween(Window.unboundedPreceding, 0)
# The rows from here on, backwards: a frame that grows is run once over a series, one that shrinks
# would be run anew for each of its rows.
AFTER = lambda: S().orderBy(F.col("ds").desc()).rowsBetween(Window.unboundedPreceding, 0)

_last = lambda c="y": F.last(c, ignorenulls=True).over(BEFORE())
_next = lambda c="y": F.last(c, ignorenulls=True).over(AFTER())
_zero = lambda: F.lit(0.0)


def _edges() -> tuple[Column, Column, Column, Column]:
    """Row numbers and values of the known neighbours before and behind."""
    at = F.when(F.col("y").isNotNull(), F.col("_i"))
    return F.max(at).over(BEFORE()), F.min(at).over(AFTER()), _last(), _next()


def _interpolated() -> Column:
    """Between the known neighbours in proportion to the rows between; ends take the nearest."""
    i0, i1, y0, y1 = _edges()
    between = y0 + (y1 - y0) * (F.col("_i") - i0) / F.nullif(i1 - i0, F.lit(0))
    return F.coalesce("y", between, y0, y1, _zero())


def _nearest() -> Column:
    """The nearer known neighbour, the one before where both are as near."""
    i0, i1, y0, y1 = _edges()
    return F.coalesce("y", F.when(F.col("_i") - i0 <= i1 - F.col("_i"), y0).otherwise(y1), y0, y1, _zero())


def _rolling(rows: int) -> Column:
    return F.coalesce("y", F.avg("y").over(T().rowsBetween(1 - rows, 0)), _last(), _next(), _zero())


#: A series without any value becomes 0 (one: 1).
METHODS = {
    "ffill": lambda: F.coalesce(_last(), _next(), _zero()),
    "bfill": lambda: F.coalesce(_next(), _last(), _zero()),
    "zero": lambda: F.coalesce("y", _zero()),
    "one": lambda: F.coalesce("y", F.lit(1.0)),
    "mean": lambda: F.coalesce("y", F.avg("y").over(S()), _zero()),
    "median": lambda: F.coalesce("y", F.median("y").over(S()), _zero()),
    "ffill_mean_biased": lambda: F.coalesce("y", (F.coalesce(_last(), _next()) + F.avg("y").over(S())) / 2, _zero()),
    "rolling_mean": lambda: _rolling(10),
    "rolling_mean_24": lambda: _rolling(24),
    "interpolate": _interpolated,
    "time": _interpolated,  # the spine is regular, so time is in proportion to rows
    "nearest": _nearest,
    "previous": lambda: F.coalesce(_last(), _next(), _zero()),
}


def fake_date(panel: DataFrame, back: str = "bfill") -> DataFrame:
    """The known values of a series moved together to its end; the rows that this empties at the
    front are filled backwards (`bfill`), left null (`keepna`) or, up to the longest such gap of
    the whole panel, taken out of every series (`slice`)."""
    known = F.col("y").isNotNull()
    n = F.count("y").over(S())
    place = panel.withColumn("_b", F.row_number().over(S().orderBy(F.col("ds").desc())))
    value = panel.where(known).withColumn("_b", F.row_number().over(S().orderBy(F.col("ds").desc()))).select("series_id", "_b", F.col("y").alias("_v"))
    held = place.withColumn("_n", n).drop("y").join(value, ["series_id", "_b"], "left").withColumnRenamed("_v", "y")
    if back == "bfill":
        return held.withColumn("y", F.coalesce("y", _next(), _zero())).select("series_id", "ds", "y")
    if back == "slice":
        least = panel.groupBy("series_id").agg(F.count("y").alias("n")).agg(F.min("n").alias("_least")).withColumn("_k", F.lit(1))
        return held.withColumn("_k", F.lit(1)).join(F.broadcast(least), "_k").where(F.col("_b") <= F.col("_least")).select("series_id", "ds", "y")
    if back == "keepna":
        return held.select("series_id", "ds", "y")
    raise ValueError(back)


def impute(panel: DataFrame, method: str = "ffill") -> DataFrame:
    """The panel with its null cells filled; names may be written with spaces; a name that is not
    known gives the panel back as it is."""
    method = method.replace(" ", "_") if method else "none"
    if method == "fake_date":
        return fake_date(panel)
    if method in CURVES or method in MODELS:
        from . import impute_models

        return impute_models.fill(panel, method)
    if method not in METHODS:
        return panel
    held = panel.withColumn("_i", F.row_number().over(T())) if method in ("interpolate", "time", "nearest") else panel
    return held.withColumn("y", METHODS[method]()).select("series_id", "ds", "y")


#: Methods that fit a curve or a model to a series; see `impute_models`.
CURVES = ("quadratic", "cubic", "pchip", "akima", "polynomial", "spline")
MODELS = ("seasonal_linear", "datepart_regression", "seasonality_motif", "knn", "iterative")
