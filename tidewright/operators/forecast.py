"""Naive and motif forecasters: (series_id, step, forecast, lower, upper) from a filled panel."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .impute import S


def _steps(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def _widths(interval: float):
    q = lambda p: F.percentile("y", F.lit(p))
    return (q(interval) - q(0.5)).alias("up"), (q(0.5) - q(1 - interval)).alias("lo")


def _bounded(df: DataFrame, factor: float) -> DataFrame:
    return df.select("series_id", "step", "forecast", (F.col("forecast") - factor * F.col("lo")).alias("lower"), (F.col("forecast") + factor * F.col("up")).alias("upper"))


def last_value(panel: DataFrame, horizon: int, interval: float = 0.9) -> DataFrame:
    out = panel.groupBy("series_id").agg(F.max_by("y", "ds").alias("forecast"), *_widths(interval))
    return _bounded(_steps(out, horizon), 0.9)


def average_value(panel: DataFrame, horizon: int, how: str = "mean", interval: float = 0.9, window: int | None = None) -> DataFrame:
    """A statistic of the history (of its last `window` rows, if given) for all steps."""
    if window:
        panel = panel.withColumn("_r", F.row_number().over(S().orderBy(F.col("ds").desc()))).where(F.col("_r") <= window).drop("_r")
    w = F.datediff("ds", "_first").cast("double")
    if how in ("weighted_mean", "exp_weighted_mean"):
        panel = panel.withColumn("_first", F.min("ds").over(S()))
        w = w if how == "weighted_mean" else w * w
    q = lambda p: F.percentile("y", F.lit(p))
    f = {"mean": lambda: F.avg("y"), "median": lambda: F.median("y"), "midhinge": lambda: (q(0.25) + q(0.75)) / 2, "mode": lambda: F.mode("y", True)}.get(how, lambda: F.sum(w * F.col("y")) / F.nullif(F.sum(w), F.lit(0.0)))()
    return _bounded(_steps(panel.groupBy("series_id").agg(f.alias("forecast"), *_widths(interval)), horizon), 1.0)


def constant(panel: DataFrame, horizon: int, value: float = 0.0) -> DataFrame:
    out = panel.select("series_id").distinct().withColumn("forecast", F.lit(value))
    return _steps(out, horizon).select("series_id", "step", "forecast", F.col("forecast").alias("lower"), F.col("forecast").alias("upper"))


def seasonal_naive(panel: DataFrame, horizon: int, lag: int = 7, how: str = "lastvalue", interval: float = 0.9) -> DataFrame:
    """Each step takes the season's place it falls on: its last value, or mean or median of all."""
    back = F.row_number().over(S().orderBy(F.col("ds").desc()))
    place = panel.withColumn("_rn", back).withColumn("_b", (lag - 1 - F.pmod(F.col("_rn") - 1, F.lit(lag))).cast("int"))
    stat = {"lastvalue": F.min_by("y", "_rn"), "mean": F.avg("y"), "median": F.median("y")}[how]
    profile = place.groupBy("series_id", "_b").agg(stat.alias("forecast"))
    steps = profile.withColumn("step", F.explode(F.sequence(F.col("_b") + 1, F.greatest(F.lit(horizon), F.col("_b") + 1), F.lit(lag)))).where(F.col("step") <= horizon)
    widths = panel.groupBy("series_id").agg(*_widths(interval))
    return _bounded(steps.join(widths, "series_id"), 1.0)


def seasonal_naive_of_two(panel: DataFrame, horizon: int, lag: int = 7, lag2: int = 28, how: str = "lastvalue") -> DataFrame:
    """The mean of two seasonal naive forecasts; bounds as `inferred_normal`."""
    a, b = (seasonal_naive(panel, horizon, x, how).select("series_id", "step", F.col("forecast").alias(n)) for x, n in ((lag, "f1"), (lag2, "f2")))
    return inferred_normal(panel, a.join(b, ["series_id", "step"]).select("series_id", "step", ((F.col("f1") + F.col("f2")) / 2).alias("forecast")))


def inferred_normal(panel: DataFrame, point: DataFrame, interval: float = 0.9, n: int = 5) -> DataFrame:
    """Bounds of point forecasts from a normal posterior: the history's mean counts once, the
    forecast `n` times; they never cross the forecast."""
    z = NormalDist().inv_cdf(1 - (1 - interval) / 2)
    stats = panel.groupBy("series_id").agg(F.avg("y").alias("_m"), F.coalesce(F.nullif(F.stddev_samp("y"), F.lit(0.0)), F.lit(1.0)).alias("_s"))
    f, post = F.col("forecast"), (F.col("_m") + n * F.col("forecast")) / (1 + n)
    return point.join(stats, "series_id").select("series_id", "step", "forecast", F.least(f, post - z * F.col("_s")).alias("lower"), F.greatest(f, post + z * F.col("_s")).alias("upper"))


def historic_quantile(panel: DataFrame, point: DataFrame, interval: float = 0.9) -> DataFrame:
    """Bounds of point forecasts from the history's quantiles around its median."""
    return _bounded(point.join(panel.groupBy("series_id").agg(*_widths(interval)), "series_id"), 1.0)


def pct_change_bounds(panel: DataFrame, point: DataFrame, interval: float = 0.9) -> DataFrame:
    """Bounds of point forecasts that widen with the square root of the step, by the quantiles of
    the history's relative changes."""
    change = panel.withColumn("_c", F.col("y") / F.nullif(F.lag("y").over(S().orderBy("ds")), F.lit(0.0)) - 1)
    q = lambda p: F.coalesce(F.percentile("_c", F.lit(p)), F.lit(0.0))
    stats = change.groupBy("series_id").agg(q((1 - interval) / 2).alias("_l"), q(1 - (1 - interval) / 2).alias("_u"))
    f, grow = F.col("forecast"), F.sqrt(F.col("step").cast("double"))
    edges = (f + F.abs("forecast") * F.col("_l") * grow, f + F.abs("forecast") * F.col("_u") * grow)
    return point.join(stats, "series_id").select("series_id", "step", "forecast", F.least(f, *edges).alias("lower"), F.greatest(f, *edges).alias("upper"))


INTERVALS = {"historic_quantile": historic_quantile, "inferred_normal": inferred_normal, "variable_pct_change": pct_change_bounds}


def with_bounds(panel: DataFrame, point: DataFrame, interval: float = 0.9, method: str = "historic_quantile") -> DataFrame:
    """Point forecasts with bounds by the method of that name."""
    return INTERVALS[method](panel, point, interval)


#: Distances of two windows given as arrays a and b.
_fold = lambda a, b, f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
DISTANCES = {
    "mae": lambda a, b: _fold(a, b, lambda x, y: F.abs(x - y)),
    "cityblock": lambda a, b: _fold(a, b, lambda x, y: F.abs(x - y)),
    "mse": lambda a, b: _fold(a, b, lambda x, y: (x - y) * (x - y)),
    "euclidean": lambda a, b: F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y))),
    "minkowski": lambda a, b: F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y))),
    "chebyshev": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    "canberra": lambda a, b: _fold(a, b, lambda x, y: F.coalesce(F.abs(x - y) / F.nullif(F.abs(x) + F.abs(y), F.lit(0.0)), F.lit(0.0))),
    "braycurtis": lambda a, b: _fold(a, b, lambda x, y: F.abs(x - y)) / F.nullif(_fold(a, b, lambda x, y: F.abs(x + y)), F.lit(0.0)),
    "cosine": lambda a, b: 1 - _fold(a, b, lambda x, y: x * y) / F.nullif(F.sqrt(_fold(a, a, lambda x, y: x * y)) * F.sqrt(_fold(b, b, lambda x, y: x * y)), F.lit(0.0)),
}
#: How the paths behind the nearest windows become one forecast.
_q = lambda p: F.percentile("y", F.lit(p))
POINTS = {
    "mean": lambda: F.avg("y"),
    "median": lambda: F.median("y"),
    "midhinge": lambda: (_q(0.25) + _q(0.75)) / 2,
    "weighted_mean": lambda: F.coalesce(F.sum(F.col("y") * F.col("d")) / F.nullif(F.sum("d"), F.lit(0.0)), F.avg("y")),
    "inverse_distance": lambda: F.sum(F.col("y") / (F.col("d") + 1e-9)) / F.sum(1 / (F.col("d") + 1e-9)),
}


def _arrays(panel: DataFrame) -> DataFrame:
    """A series' values in the order of time as one array `v`."""
    return panel.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ds", "y"))), lambda x: x["y"]).alias("v"))


def _paths(series: DataFrame, horizon: int, window: int, k: int, distance: str) -> DataFrame:
    """series_id, step, y, d: what followed the k windows nearest to the last one.

    Only (distance, place) is made of each window, and the k least of them are taken within the
    series' row, so the series itself is never repeated.
    """
    n = F.size("v")
    held = series.withColumn("tail", F.slice("v", n - window + 1, F.lit(window)))
    places = F.when(n - window - horizon >= 1, F.sequence(F.lit(1), n - window - horizon + 1)).otherwise(F.array().cast("array<int>"))
    near = F.transform(places, lambda i: F.struct(F.round(DISTANCES[distance](F.slice("v", i, F.lit(window)), F.col("tail")), 6).alias("d"), i.alias("i")))
    best = F.slice(F.array_sort(near), F.lit(1), F.lit(k))
    path = F.transform(best, lambda x: F.struct(x["d"].alias("d"), F.slice("v", x["i"] + window, F.lit(horizon)).alias("p")))
    rows = held.select("series_id", F.explode(path).alias("x")).select("series_id", "x.d", F.posexplode("x.p").alias("step", "y"))
    return rows.withColumn("step", F.col("step") + 1)


def _from_paths(paths: DataFrame, point: str, interval: float) -> DataFrame:
    low, high = (1 - interval) / 2, 1 - (1 - interval) / 2
    return paths.groupBy("series_id", "step").agg(POINTS[point]().alias("forecast"), _q(low).alias("lower"), _q(high).alias("upper"))


def motif(panel: DataFrame, horizon: int, window: int = 14, k: int = 5, interval: float = 0.9, distance: str = "mae", point: str = "mean") -> DataFrame:
    """Each series from what followed its k windows nearest to its last one; bounds are quantiles
    of these paths. A series too short for a window and a path has no rows."""
    return _from_paths(_paths(_arrays(panel), horizon, window, k, distance), point, interval)


def sectional_motif(panel: DataFrame, horizon: int, window: int = 14, k: int = 5, interval: float = 0.9, distance: str = "mae", point: str = "mean") -> DataFrame:
    """As `motif`, but the same windows for all series: those of the least sum of distances.

    Series share their dates, so a window is its number from the end; each series' distances meet
    in a sum by window, and the k best windows are broadcast.
    """
    series = _arrays(panel)
    n = F.size("v")
    places = F.sequence(F.lit(1), n - window - horizon + 1)
    held = series.withColumn("tail", F.slice("v", n - window + 1, F.lit(window)))
    each = held.select("series_id", F.explode(F.transform(places, lambda i: F.struct((n - i).alias("back"), DISTANCES[distance](F.slice("v", i, F.lit(window)), F.col("tail")).alias("d")))).alias("x")).select("x.*")
    best = each.groupBy("back").agg(F.round(F.sum("d"), 4).alias("d")).orderBy("d", F.col("back").desc()).limit(k)
    rows = series.crossJoin(F.broadcast(best)).select("series_id", "d", F.posexplode(F.slice("v", n - F.col("back") + window, F.lit(horizon))).alias("step", "y"))
    return _from_paths(rows.withColumn("step", F.col("step") + 1), point, interval)


def dampen(forecast: DataFrame, phi: float = 0.98) -> DataFrame:
    """Steps between forecasts shrink by phi at each step after the second."""
    w = S().orderBy("step")
    change = (F.col("forecast") - F.lag("forecast").over(w)) * F.pow(F.lit(phi), F.col("step") - 2)
    held = forecast.withColumn("_c", F.coalesce(change, F.lit(0.0)))
    running = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("forecast", F.first("forecast").over(w) + running).drop("_c")


def event_risk(paths: DataFrame, limit: float, upper: bool = True) -> DataFrame:
    """Share of paths (series_id, step, path, value) at or beyond a limit."""
    hit = F.col("value") >= limit if upper else F.col("value") <= limit
    return paths.groupBy("series_id", "step").agg(F.avg(hit.cast("double")).alias("risk"))
