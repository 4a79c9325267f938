"""Constraints and adjustments of forecasts, and the risk that they cross a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forecast import DISTANCES, _arrays, dampen
from .impute import S, T


def _limit(method: str, value: float, upper: bool, window: int, threshold: float) -> Column:
    """A series' limit from its history (y, and `_r`, rows from the end)."""
    q = F.percentile("y", F.lit(value))
    sd = F.stddev_samp("y")
    sign = 1 if upper else -1
    tail = F.avg(F.when(F.col("_r") <= window, F.col("y")))
    if method == "quantile":
        return q
    if method == "stdev":
        return F.avg("y") + sign * value * sd
    if method == "stdev_min":
        return F.max("y") + value * sd if upper else F.min("y") - value * sd
    if method == "last_window":
        return tail * (1 + value)
    if method == "slope":
        return tail * (1 + threshold)
    if method in ("historic_diff", "historic_growth"):
        return F.min_by("y", "_r") + value * (F.max("_d") if upper else F.min("_d"))
    raise ValueError(method)


def constrain(forecast: DataFrame, train: DataFrame | None, method: str, value: float = 1.0, direction: str = "upper", regularization: float = 1.0, bounds: bool = True, window: int = 5, threshold: float = 0.0) -> DataFrame:
    """Forecasts (series_id, step, forecast, lower, upper) kept on one side of a limit, or moved
    `regularization` of the way to it where they are beyond.

    Limits: absolute, quantile, stdev, stdev_min, last_window (mean of the last rows, times 1 +
    value), slope (the same, growing to 1 + value at the last step), historic_diff (the last value
    and the history's greatest change over a horizon), historic_growth (the same change, growing
    with the logarithm of the step). dampening and round need no limit.
    """
    if method == "dampening":
        return dampen(forecast, value)
    names = [c for c in ("forecast", "lower", "upper") if c == "forecast" or bounds and c in forecast.columns]
    if method == "round":
        return forecast.withColumns({c: F.bround(c, int(value)) for c in names})
    upper = direction == "upper"
    horizon = F.max("step").over(S())
    held = forecast.withColumn("_h", horizon)
    if method == "absolute":
        held = held.withColumn("_lim", F.lit(float(value)))
    else:
        rows = train.withColumn("_r", F.row_number().over(S().orderBy(F.col("ds").desc())))
        if method.startswith("historic"):
            # The change over a horizon: the horizon is one number, taken from the forecasts.
            steps = forecast.groupBy("series_id").agg(F.max("step").alias("_n"))
            n = steps.agg(F.max("_n")).first()[0]
            rows = rows.withColumn("_d", F.col("y") - F.lag("y", n).over(T()))
        held = held.join(rows.groupBy("series_id").agg(_limit(method, value, upper, window, threshold).alias("_lim")), "series_id")
    limit = F.col("_lim")
    if method == "slope":
        limit = limit * F.pow(F.lit(1 + value), F.col("step") / F.col("_h"))
    beyond = (lambda x: x > limit) if upper else (lambda x: x < limit)
    out = held.withColumns({c: F.when(beyond(F.col(c)), F.col(c) + (limit - F.col(c)) * regularization).otherwise(F.col(c)) for c in names})
    return out.select(*forecast.columns)


def adjust(forecast: DataFrame, method: str, value: float = 0.0, first: int = 1, last: int | None = None, start: float = 0.0, end: float = 0.0, span: int = 7, series: list[str] | None = None) -> DataFrame:
    """Forecasts changed on some steps and series: percentage, additive, a ramp that is added or
    multiplied from `start` to `end`, or smoothing with an exponentially weighted mean."""
    step = F.col("step")
    on = (step >= first) & (step <= last if last else F.lit(True))
    on = on & F.col("series_id").isin(*series) if series else on
    names = [c for c in ("forecast", "lower", "upper") if c in forecast.columns]
    span_of = F.greatest((F.lit(last) if last else F.max("step").over(S())) - first, F.lit(1))
    ramp = start + (end - start) * (step - first) / span_of
    if method == "smoothing":
        keep = 1 - 2 / (span + 1)
        w = S().orderBy("step").rowsBetween(Window.unboundedPreceding, 0)

        def folded(c: str) -> Column:
            return F.aggregate(F.slice(F.collect_list(c).over(w), F.lit(2), F.greatest(step, F.lit(1))), F.first(c).over(w), lambda a, x: keep * a + (1 - keep) * x)

        return forecast.withColumns({c: F.when(on, folded(c)).otherwise(F.col(c)) for c in names})
    new = {"percentage": lambda c: c * (1 + value), "additive": lambda c: c + value, "ramp_additive": lambda c: c + ramp, "ramp_multiplicative": lambda c: c * ramp}[method]
    return forecast.withColumns({c: F.when(on, new(F.col(c))).otherwise(F.col(c)) for c in names})


def motif_paths(panel: DataFrame, horizon: int, window: int = 14, k: int = 10, distance: str = "mae") -> DataFrame:
    """series_id, step, path, value: what followed the k windows nearest to a series' last one; a
    path is named by its window's place."""
    series = _arrays(panel)
    n = F.size("v")
    held = series.withColumn("tail", F.slice("v", n - window + 1, F.lit(window)))
    near = F.transform(F.sequence(F.lit(1), n - window - horizon + 1), lambda i: F.struct(F.round(DISTANCES[distance](F.slice("v", i, F.lit(window)), F.col("tail")), 6).alias("d"), i.alias("i")))
    best = held.where(n >= window + horizon).select("series_id", F.explode(F.transform(F.slice(F.array_sort(near), F.lit(1), F.lit(k)), lambda x: F.struct(x["i"].alias("path"), F.slice("v", x["i"] + window, F.lit(horizon)).alias("p")))).alias("x"))
    return best.select("series_id", "x.path", F.posexplode("x.p").alias("step", "value")).select("series_id", (F.col("step") + 1).alias("step"), "path", "value")


def interval_paths(forecasts: dict[float, DataFrame]) -> DataFrame:
    """Result windows from bounds: each interval's lower and upper bound, and the point, is a path."""
    out = None
    for p, f in forecasts.items():
        rows = f.select("series_id", "step", F.explode(F.array(*[F.struct(F.lit(f"{c}-{p}").alias("path"), F.col(c).alias("value")) for c in ("lower", "upper", "forecast")])).alias("x")).select("series_id", "step", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def limits(history: DataFrame, lower=None, upper=None) -> DataFrame:
    """series_id, lower_limit, upper_limit: a share is the quantile of the history, another number
    is itself, and None is no limit."""

    def of(x) -> Column:
        return F.lit(None).cast("double") if x is None else F.percentile("y", F.lit(float(x))) if 0 <= x <= 1 else F.lit(float(x))

    return history.groupBy("series_id").agg(of(lower).alias("lower_limit"), of(upper).alias("upper_limit"))


def _crossed() -> tuple[Column, Column]:
    return (F.col("value") >= F.col("upper_limit")).cast("int"), (F.col("value") <= F.col("lower_limit")).cast("int")


def event_risk(paths: DataFrame, limit: DataFrame) -> DataFrame:
    """series_id, step, upper_risk, lower_risk: the shares of paths at or beyond the limits (a row a
    series, or a series and step)."""
    up, down = _crossed()
    joined = paths.join(limit, [c for c in ("series_id", "step") if c in limit.columns])
    return joined.groupBy("series_id", "step").agg(F.avg(up).alias("upper_risk"), F.avg(down).alias("lower_risk"))


def historic_risk(history: DataFrame, limit: DataFrame) -> DataFrame:
    """0 or 1 for each row of the history: whether it was at or beyond the limits."""
    up, down = _crossed()
    return history.withColumnRenamed("y", "value").join(limit, "series_id").select("series_id", "ds", up.alias("upper_risk"), down.alias("lower_risk"))


def slice_json(rows: DataFrame, where: Column, key: tuple[str, ...] = ("series_id", "step"), digits: int = 4) -> DataFrame:
    """The rows that a condition on dates, steps or series keeps, all but the key as one JSON text."""
    names = [c for c in rows.columns if c not in key]
    shown = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes if c in names]
    return rows.where(where).select(*key, F.to_json(F.struct(*shown)).alias("body"))
