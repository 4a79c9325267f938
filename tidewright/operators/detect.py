"""Anomaly scores, changepoints and the days they fall on."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SURVIVAL
from .impute import S, T

#: Least share of a tail that is not odd.
ALPHA = 0.05


def centred(rows: int) -> tuple[int, int]:
    """Frame of a centred window: of an even number, one more row lies behind than ahead."""
    ahead = (rows - 1) // 2
    return ahead + 1 - rows, ahead


def _score(method: str, rows: int) -> Column:
    y, s = F.col("y"), S()
    if method == "zscore":
        return F.abs(y - F.avg("y").over(s)) / F.nullif(F.stddev_samp("y").over(s), F.lit(0.0))
    if method == "rolling_zscore":
        w = T().rowsBetween(*centred(rows))
        return F.abs(y - F.avg("y").over(w)) / F.nullif(F.stddev_samp("y").over(w), F.lit(0.0))
    if method == "mad":  # the mean of the absolute deviations from the median
        return F.abs(y - F.col("_m")) / F.nullif(F.avg(F.abs(y - F.col("_m"))).over(s), F.lit(0.0))
    if method == "med_diff":
        return F.abs(F.col("_d")) / F.nullif(F.percentile(F.abs("_d"), F.lit(0.5)).over(s), F.lit(0.0))
    if method == "max_diff":
        return F.abs(F.col("_d")) / F.nullif(F.max(F.abs("_d")).over(s), F.lit(0.0))
    raise ValueError(method)


def anomalies(panel: DataFrame, method: str = "zscore", distribution: str = "norm", alpha: float = ALPHA, rows: int = 200, k: float = 1.5, quantiles: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """score and anomaly (-1 or 1) for every cell that is not null.

    zscore, rolling_zscore, mad, med_diff, max_diff: score is the survival of the distance under
    `distribution` with location 1; below `alpha` it is odd. iqr: beyond `k` times the range of the
    quantiles is odd, and the score is the survival of the distance to the nearer limit in such
    ranges. minmax: score is 1 less the absolute value's place between the least and the greatest.
    """
    held = panel.where("y IS NOT NULL")
    if method == "iqr":
        lo, hi = (F.percentile("y", F.lit(p)).over(S()) for p in quantiles)
        held = held.withColumns({"_lo": lo, "_hi": hi}).withColumn("_w", F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
        up, down = F.col("_hi") + k * F.col("_w"), F.col("_lo") - k * F.col("_w")
        score = SURVIVAL["norm"](F.least(F.abs(F.col("y") - up), F.abs(F.col("y") - down)) / F.col("_w"), F.lit(0.0))
        return held.select("series_id", "ds", score.alias("score"), F.when((F.col("y") >= up) | (F.col("y") <= down), -1).otherwise(1).alias("anomaly"))
    if method == "minmax":
        a = F.abs("y")
        lo, hi = F.min(a).over(S()), F.max(a).over(S())
        held = held.withColumn("score", 1 - (a - lo) / F.nullif(hi - lo, F.lit(0.0)))
        return held.select("series_id", "ds", "score", F.when(F.col("score") < alpha, -1).otherwise(1).alias("anomaly"))
    if method == "mad":
        held = held.withColumn("_m", F.median("y").over(S()))
    if method.endswith("_diff"):
        held = held.withColumn("_d", F.col("y") - F.lag("y").over(T()))
    held = held.withColumn("_z", _score(method, rows)).withColumn("score", SURVIVAL[distribution](F.coalesce("_z", F.lit(0.0)), F.lit(1.0)))
    return held.select("series_id", "ds", "score", F.when(F.col("score") < alpha, -1).otherwise(1).alias("anomaly"))


def anomalies_by_date(found: DataFrame, share: float = 0.5) -> DataFrame:
    """One verdict a date: odd where more than `share` of the series are; the mean score."""
    return found.groupBy("ds").agg(F.avg("score").alias("score"), F.when(F.avg((F.col("anomaly") == -1).cast("double")) > share, -1).otherwise(1).alias("anomaly"))


def remove_anomalies(panel: DataFrame, found: DataFrame) -> DataFrame:
    """The panel with odd cells null."""
    odd = found.where("anomaly = -1").select("series_id", "ds", F.lit(True).alias("_odd"))
    return panel.join(odd, ["series_id", "ds"], "left").select("series_id", "ds", F.when(F.col("_odd").isNull(), F.col("y")).alias("y"))


def outside_interval(panel: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cells outside of the bounds (series_id, ds, lower, upper) that a model gives them."""
    held = panel.where("y IS NOT NULL").join(bounds, ["series_id", "ds"])
    gap = F.greatest(F.col("y") - F.col("upper"), F.col("lower") - F.col("y"), F.lit(0.0))
    return held.select("series_id", "ds", gap.alias("score"), F.when(gap > 0, -1).otherwise(1).alias("anomaly"))


def level_differences(panel: DataFrame, window: int = 90, alpha: float = 2.5) -> DataFrame:
    """Mean behind less mean ahead of each row, and whether it exceeds alpha standard deviations."""
    back, ahead = F.avg("y").over(T().rowsBetween(1 - window, 0)), F.avg("y").over(T().rowsBetween(0, window - 1))
    out = panel.withColumn("diff", back - ahead)
    return out.select("series_id", "ds", "diff", (F.abs("diff") > alpha * F.stddev_samp("diff").over(S())).alias("shift"))


def nonparametric(errors: DataFrame, start: float = 2.5, limit: float = 12.0, step: float = 0.5, most: float = 0.25) -> DataFrame:
    """A threshold of its own for each series of values (series_id, ds, y): of the grid mean + z
    deviations, that by which leaving out what is above lowers mean and deviation most for the
    rows it costs. score is the value over the threshold.

    The grid is a fixed list, so each series has that many aggregates; nothing is compared by pairs.
    """
    zs = [start + i * step for i in range(int((limit - start) / step) + 1)]
    stats = errors.groupBy("series_id").agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"), F.count("y").alias("_n"))
    held = errors.join(stats, "series_id").where("y IS NOT NULL")
    cut = lambda z: F.col("_m") + z * F.col("_s")
    below = [x for i, z in enumerate(zs) for x in (F.avg(F.when(F.col("y") < cut(z), F.col("y"))).alias(f"m{i}"), F.stddev_pop(F.when(F.col("y") < cut(z), F.col("y"))).alias(f"s{i}"), F.count_if(F.col("y") >= cut(z)).alias(f"c{i}"))]
    rows = held.groupBy("series_id", "_m", "_s", "_n").agg(*below)
    gain = lambda i: F.when((F.col(f"c{i}") > 0) & (F.col(f"c{i}") <= most * F.col("_n")), ((F.col("_m") - F.col(f"m{i}")) / F.nullif(F.col("_m"), F.lit(0.0)) + (F.col("_s") - F.col(f"s{i}")) / F.nullif(F.col("_s"), F.lit(0.0))) / F.col(f"c{i}"))
    grid = F.array(*[F.struct(F.coalesce(gain(i), F.lit(-1.0)).alias("g"), F.lit(-z).alias("z")) for i, z in enumerate(zs)])
    best = F.array_max(grid)
    chosen = rows.select("series_id", F.when(best["g"] > 0, F.col("_m") - best["z"] * F.col("_s")).alias("_e"))
    out = held.select("series_id", "ds", "y").join(chosen, "series_id")
    return out.select("series_id", "ds", F.coalesce(F.col("y") / F.nullif(F.col("_e"), F.lit(0.0)), F.lit(0.0)).alias("score"), F.when(F.col("y") > F.col("_e"), -1).otherwise(1).alias("anomaly"))


# Changepoints


def cusum(panel: DataFrame, threshold: float = 5.0, drift: float = 0.0, distance: int = 5) -> DataFrame:
    """Rows (series_id, ds) where the sum of standardised deviations on one side since the last
    alarm exceeds the threshold; alarms are `distance` rows apart. A fold over the series' array."""
    stats = panel.groupBy("series_id").agg(F.avg("y").alias("_m"), F.nullif(F.stddev_pop("y"), F.lit(0.0)).alias("_s"), F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("v"))
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("i"), F.lit(-1000000).alias("last"), F.array().cast("array<int>").alias("at"))

    def step(a, x):
        z = (x["y"] - F.col("_m")) / F.col("_s")
        up, down = F.greatest(a["up"] + z - drift, F.lit(0.0)), F.greatest(a["down"] - z - drift, F.lit(0.0))
        hit = ((up > threshold) | (down > threshold)) & (a["i"] - a["last"] >= distance)
        return F.when(hit, F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), (a["i"] + 1).alias("i"), a["i"].alias("last"), F.concat(a["at"], F.array(a["i"])).alias("at"))).otherwise(
            F.struct(up.alias("up"), down.alias("down"), (a["i"] + 1).alias("i"), a["last"].alias("last"), a["at"].alias("at"))
        )

    found = stats.where("_s IS NOT NULL").select("series_id", "v", F.aggregate("v", zero, step, lambda a: a["at"]).alias("at"))
    return found.select("series_id", F.explode(F.transform("at", lambda i: F.get("v", i)["ds"])).alias("ds"))


def ewma_chart(panel: DataFrame, weight: float = 0.2, limit: float = 3.0, distance: int = 5) -> DataFrame:
    """Rows (series_id, ds) where the exponentially weighted mean leaves its control limits."""
    stats = panel.groupBy("series_id").agg(F.avg("y").alias("_m"), F.nullif(F.stddev_pop("y"), F.lit(0.0)).alias("_s"), F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("v"))
    zero = F.struct(F.lit(0.0).alias("e"), F.lit(0).alias("i"), F.lit(-1000000).alias("last"), F.array().cast("array<int>").alias("at"))
    width = limit * (weight / (2 - weight)) ** 0.5

    def step(a, x):
        e = (1 - weight) * a["e"] + weight * (x["y"] - F.col("_m")) / F.col("_s")
        hit = (F.abs(e) > width) & (a["i"] - a["last"] >= distance)
        return F.struct(e.alias("e"), (a["i"] + 1).alias("i"), F.when(hit, a["i"]).otherwise(a["last"]).alias("last"), F.when(hit, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"))

    found = stats.where("_s IS NOT NULL").select("series_id", "v", F.aggregate("v", zero, step, lambda a: a["at"]).alias("at"))
    return found.select("series_id", F.explode(F.transform("at", lambda i: F.get("v", i)["ds"])).alias("ds"))


def changepoint_ramps(dates: DataFrame, spacing: int = 60, end: int = 120) -> DataFrame:
    """Columns max(0, t - changepoint) for changepoints every `spacing` rows, the last one `end`
    rows before the end; dates are one table for all series. The number of columns follows from the
    number of dates, which is read for it."""
    n = dates.count()
    held = dates.select("ds", (F.row_number().over(Window.orderBy("ds")) - 1).alias("_t"))
    at = list(range(n - end, 0, -spacing))[::-1] or [n // 2]
    return held.select("ds", *[F.greatest(F.col("_t") - c, F.lit(0)).cast("double").alias(f"ramp{i}") for i, c in enumerate(at)])


# Recurring days


def holiday_keys(ds: Column) -> dict[str, Column]:
    """What a date is in calendars that repeat: day of the month, weekday of the month from its
    start and from its end."""
    week = F.floor((F.dayofmonth(ds) - 1) / 7) + 1
    from_end = F.floor((F.dayofmonth(F.last_day(ds)) - F.dayofmonth(ds)) / 7) + 1
    part = lambda *c: F.concat_ws("-", *[x.cast("string") for x in c])
    return {
        "dom": F.concat(F.lit("dom_"), part(F.month(ds), F.dayofmonth(ds))),
        "wkdom": F.concat(F.lit("wkdom_"), part(F.month(ds), week, F.weekday(ds))),
        "wkdeom": F.concat(F.lit("wkdeom_"), part(F.month(ds), from_end, F.weekday(ds))),
    }


def mine_holidays(found: DataFrame, threshold: float = 0.8, least: int = 2) -> DataFrame:
    """series_id, holiday, rate, n: calendar keys on which enough of a series' cells are odd."""
    keyed = found.select("series_id", "anomaly", F.explode(F.array(*holiday_keys(F.col("ds")).values())).alias("holiday"))
    rates = keyed.groupBy("series_id", "holiday").agg(F.avg((F.col("anomaly") == -1).cast("double")).alias("rate"), F.count_if(F.col("anomaly") == -1).alias("n"))
    return rates.where((F.col("rate") >= threshold) & (F.col("n") >= least))


def dates_to_holidays(dates: DataFrame, holidays: DataFrame, style: str = "long") -> DataFrame:
    """Dates (ds) with the holidays mined: a row each (`long`), or 0/1 by series (`flag`: all series'
    dates, `series_flag`: with series_id)."""
    keyed = dates.select("ds", F.explode(F.array(*holiday_keys(F.col("ds")).values())).alias("holiday"))
    long = keyed.join(F.broadcast(holidays.select("series_id", "holiday", "rate")), "holiday").select("series_id", "ds", "holiday", "rate")
    if style == "long":
        return long
    if style == "flag":
        return dates.join(long.select("ds", F.lit(1).alias("flag")).distinct(), "ds", "left").select("ds", F.coalesce("flag", F.lit(0)).alias("flag"))
    every = holidays.select("series_id").distinct().crossJoin(dates)
    hit = long.select("series_id", "ds", F.lit(1).alias("flag")).distinct()
    return every.join(hit, ["series_id", "ds"], "left").select("series_id", "ds", F.coalesce("flag", F.lit(0)).alias("flag"))


def calendar_of_anomalies(found: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar rows (ds, ...) and anomalies by series, whichever of the two a date is in."""
    return calendar.join(found.where("anomaly = -1").select("ds", "series_id", "score"), "ds", "full")
