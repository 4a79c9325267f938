"""Cleaning of panels, files in and out, calendars of steps, and generated panels with labels."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .panel import AGGREGATES, long_from_wide, regularise

_S = lambda: Window.partitionBy("series_id")
_BACK = lambda: F.row_number().over(_S().orderBy(F.col("ds").desc()))


def infer_frequency(panel: DataFrame) -> DataFrame:
    """One row, `frequency`: D, W, MS, QS, YS, H or the most frequent step in seconds. Only the
    distinct times meet in one window."""
    times = panel.select(F.col("ds").cast("timestamp").alias("t")).distinct()
    step = times.withColumn("s", F.unix_seconds("t") - F.unix_seconds(F.lag("t").over(Window.orderBy("t"))))
    s = F.mode("s", True)
    got = step.agg(s.alias("s"), F.bool_and(F.dayofmonth("t") == 1).alias("first"))
    day = 86400
    name = F.when(F.col("s") == 3600, "H").when(F.col("s") == day, "D").when(F.col("s") == 7 * day, "W")
    name = name.when(F.col("first") & F.col("s").between(28 * day, 31 * day), "MS").when(F.col("first") & F.col("s").between(89 * day, 92 * day), "QS").when(F.col("first") & F.col("s").between(365 * day, 366 * day), "YS")
    return got.select(F.coalesce(name, F.concat(F.col("s").cast("string"), F.lit("s"))).alias("frequency"))


def clean_up(panel: DataFrame, step: str = "1 day", grain: str | None = None, aggfunc: str = "first", prefill: str | None = None, tolerance: float = 0.999, newest: int | None = None, drop_last: int = 0) -> DataFrame:
    """A panel on a regular spine: rolled up to a grain if one is given, its newest steps kept, its
    last ones dropped, series with too few known values left out, and gaps prefilled if asked."""
    if grain:
        panel = panel.groupBy("series_id", F.date_trunc(grain, "ds").cast(dict(panel.dtypes)["ds"]).alias("ds")).agg(AGGREGATES[aggfunc]("y").alias("y"))
    held = regularise(panel, step).withColumn("_b", _BACK())
    if drop_last:
        held = held.where(F.col("_b") > drop_last)
    if newest:
        held = held.where(F.col("_b") <= newest + drop_last)
    known, rows = F.count("y").over(_S()), F.count("*").over(_S())
    held = held.withColumns({"_k": known, "_n": rows}).where(F.col("_k") >= F.floor(F.col("_n") * (1 - tolerance)))
    fill = {None: F.col("y"), "zero": F.coalesce("y", F.lit(0.0)), "mean": F.coalesce("y", F.avg("y").over(_S())), "median": F.coalesce("y", F.median("y").over(_S()))}[prefill]
    return held.withColumn("y", fill).select("series_id", "ds", "y")


def encode_labels(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A panel of text values as numbers from 1 in the order of the labels of a series, gaps filled
    forwards then backwards; and the labels: series_id, code, label."""
    text = F.nullif(F.trim("y"), F.lit(""))
    before = _S().orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    after = _S().orderBy(F.col("ds").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = panel.withColumn("_t", text)
    held = held.withColumn("_t", F.coalesce(F.last("_t", True).over(before), F.last("_t", True).over(after)))
    labels = held.where("_t IS NOT NULL").select("series_id", "_t").distinct().withColumn("code", F.row_number().over(_S().orderBy("_t")).cast("double"))
    coded = held.drop("y").join(labels, ["series_id", "_t"], "left").select("series_id", "ds", F.col("code").alias("y"))
    return coded, labels.select("series_id", "code", F.col("_t").alias("label"))


def decode_labels(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Numbers as the labels nearest to them, the first or last one beyond the ends."""
    most = labels.groupBy("series_id").agg(F.max("code").alias("_most"))
    code = F.greatest(F.least(F.bround("y", 0), F.col("_most")), F.lit(1.0))
    return values.join(most, "series_id").withColumn("code", code).join(labels, ["series_id", "code"]).select("series_id", "ds", F.col("label").alias("y"))


def subset(panel: DataFrame, weights: DataFrame, n: int, seed: int = 2020) -> DataFrame:
    """The rows of n series drawn without replacement, by weight: a draw is a hash of the name, so
    the same seed draws the same."""
    u = (F.pmod(F.xxhash64("series_id", F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 2)
    drawn = weights.select("series_id", F.pow(u, 1 / F.greatest("weight", F.lit(1e-9))).alias("_u")).orderBy(F.col("_u").desc(), "series_id").limit(n)
    return panel.join(F.broadcast(drawn.select("series_id")), "series_id", "left_semi")


def drop_leading_gaps(panel: DataFrame, share: float = 0.75, window: int = 7, most: float = 0.5) -> DataFrame:
    """Without the panel's first dates, as long as more than `share` of the series are missing and
    there are `window` such dates or more; nothing goes if that were over `most` of all dates."""
    dates = panel.groupBy("ds").agg(F.avg(F.col("y").isNull().cast("double")).alias("_g"))
    first = dates.agg(F.min(F.when(F.col("_g") <= share, F.col("ds"))).alias("_f"), F.count("*").alias("_n")).withColumn("_k", F.lit(1))
    lead = dates.withColumn("_k", F.lit(1)).join(F.broadcast(first), "_k").groupBy("_f", "_n").agg(F.count_if(F.col("ds") < F.col("_f")).alias("_lead")).withColumn("_k", F.lit(1))
    held = panel.withColumn("_k", F.lit(1)).join(F.broadcast(lead), "_k")
    cut = (F.col("_lead") >= window) & (F.col("_lead") <= most * F.col("_n"))
    return held.where(~cut | (F.col("ds") >= F.col("_f"))).select("series_id", "ds", "y")


def seasons(panel: DataFrame, lag: int = 7) -> DataFrame:
    """series_id, season, place, y: whole seasons counted back from the end; older rows go."""
    held = panel.withColumns({"_b": _BACK() - 1, "_n": F.count("*").over(_S())})
    whole = F.floor(F.col("_n") / lag)
    return held.where(F.col("_b") < whole * lag).select("series_id", (whole - 1 - F.floor(F.col("_b") / lag)).cast("int").alias("season"), (lag - 1 - F.pmod("_b", F.lit(lag))).cast("int").alias("place"), "y")


def future_steps(panel: DataFrame, horizon: int, grain: str = "day") -> DataFrame:
    """The `horizon` steps of a grain (day, week, month, quarter, year, hour) that follow each series."""
    size = {"quarter": "3 month"}.get(grain, f"1 {grain}").split()
    at = F.expr(f"_d + step * INTERVAL {size[0]} {size[1]}")
    last = panel.groupBy("series_id").agg(F.max("ds").alias("_d"))
    return last.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "_d").select("series_id", "step", at.cast(dict(panel.dtypes)["ds"]).alias("ds"))


def classify(profile: DataFrame, adi: float = 1.2, cv: float = 0.5, flat: float = 0.95) -> DataFrame:
    """The class of each series from its profile: later rules go before earlier ones."""
    c = F.when(F.col("unchanged") >= flat, "flat").when(F.col("autocorrelation") > 0.98, "smooth_drift").when((F.col("adi2") >= adi) & (F.col("cv2") >= cv), "lumpy").when(F.col("adi2") >= adi, "intermittent").when(F.col("cv2") >= cv, "erratic").otherwise("smooth")
    return profile.select("series_id", c.alias("profile"))


# Files


def read(spark: SparkSession, path: str, kind: str = "csv", shape: str = "long", ds: str = "ds", series_id: str = "series_id", y: str = "y") -> DataFrame:
    """A panel from CSV, JSON or Parquet files, in long or wide form."""
    df = spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.format(kind).load(path)
    if shape == "wide":
        return long_from_wide(df, ds)
    return df.select(F.col(series_id).cast("string").alias("series_id"), F.col(ds).alias("ds"), F.col(y).cast("double").alias("y"))


def write(panel: DataFrame, path: str, kind: str = "csv", shape: str = "long") -> None:
    """A panel as files, with a manifest of what they hold beside them (one row, path + `.manifest`)."""
    from .panel import wide_from_long

    df = wide_from_long(panel) if shape == "wide" else panel
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path))
    manifest = panel.agg(F.count("*").alias("rows"), F.count_distinct("series_id").alias("series"), F.min("ds").cast("string").alias("first"), F.max("ds").cast("string").alias("last"))
    manifest.withColumns({"kind": F.lit(kind), "shape": F.lit(shape)}).write.mode("overwrite").json(f"{path}.manifest")


def as_json(panel: DataFrame) -> DataFrame:
    """A row a date: its series as one JSON object."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("series_id", "y"))))
    return panel.where("y IS NOT NULL").groupBy("ds").agg(F.to_json(pairs).alias("body"))


# Generated panels


def _unit(*key) -> Column:
    """A number from 0 to 1 by a hash, so that a lost task draws the same again."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(name: str, seed: int) -> Column:
    """A standard normal from two uniform draws."""
    return F.sqrt(-2 * F.log(_unit("series_id", "t", F.lit(name), F.lit(seed)))) * F.cos(2 * F.pi() * _unit("series_id", "t", F.lit(name + "2"), F.lit(seed)))


def _grid(spark: SparkSession, series: int, rows: int, start: str) -> DataFrame:
    cells = spark.range(series * rows).select((F.col("id") % series).cast("int").alias("k"), F.floor(F.col("id") / series).cast("int").alias("t"))
    return cells.select(F.concat(F.lit("series_"), "k").alias("series_id"), "k", "t", F.date_add(F.lit(start).cast("date"), F.col("t")).alias("ds"))


def weekdays(spark: SparkSession, rows: int = 180, start: str = "2021-01-01", categorical: bool = True) -> DataFrame:
    """The name (or number, Monday as 0) of each day."""
    days = _grid(spark, 1, rows, start).select(F.lit("weekday").alias("series_id"), "ds")
    return days.select("series_id", "ds", (F.date_format("ds", "EEEE") if categorical else F.weekday("ds").cast("double")).alias("y"))


def noisy(spark: SparkSession, kind: str = "linear", series: int = 5, rows: int = 200, gaps: float = 0.1, noise: float = 0.1, seed: int = 123) -> DataFrame:
    """Lines or sines with noise, and a share of the dates missing in all series."""
    g = _grid(spark, series, rows, "2021-01-01")
    k, t = F.col("k") + 1, F.col("t") + 1
    y = (k * t).cast("double") if kind == "linear" else F.sin(k * t)
    gone = _unit("t", F.lit("gap"), F.lit(seed)) < gaps
    return g.select("series_id", "ds", F.when(~gone, y + noise * F.abs(_normal("noise", seed))).alias("y"))


def artificial(spark: SparkSession, rows: int = 300, seed: int = 1) -> DataFrame:
    """Edge cases by name: constant, all missing, one value, intermittent, steps, random walk,
    exponential growth, white noise, a lone spike."""
    g = _grid(spark, 1, rows, "2021-01-01").drop("series_id", "k")
    names = ("constant", "missing", "single", "intermittent", "steps", "walk", "growth", "noise", "spike")
    cells = g.select("t", "ds", F.explode(F.array(*map(F.lit, names))).alias("series_id"))
    z, t = _normal("cell", seed), F.col("t")
    walk = F.sum(z).over(Window.partitionBy("series_id").orderBy("t"))
    cases = {
        "constant": F.lit(7.0), "missing": F.lit(None).cast("double"), "single": F.when(t == 10, 3.0), "intermittent": F.when(_unit("t", F.lit(seed)) < 0.1, F.abs(z) * 10).otherwise(0.0),
        "steps": F.floor(t / 50).cast("double"), "walk": walk, "growth": F.exp(t / 60), "noise": z, "spike": F.when(t == rows // 2, 100.0).otherwise(z),
    }
    y = F.lit(None).cast("double")
    for name, c in cases.items():
        y = F.when(F.col("series_id") == name, c).otherwise(y)
    return cells.select("series_id", "ds", y.alias("y"))


def labelled(spark: SparkSession, series: int = 10, rows: int = 730, start: str = "2015-01-01", seed: int = 42, template: str | None = None) -> DataFrame:
    """Daily series whose parts are known: trend with changes, level shifts, year and week, yearly
    holidays, noise and anomalies as columns that sum up to y, with labels of shifts and anomalies.

    A template (JSON) sets the sizes of the parts; `template_of` gives the one that is used.
    """
    size = {**json.loads(template_of()), **(json.loads(template) if template else {})}
    g = _grid(spark, series, rows, start)
    of = lambda name: _unit("series_id", F.lit(name), F.lit(seed))
    t = F.col("t")
    turn, shift = F.floor(of("turn") * rows), F.floor(of("shift") * rows)
    odd = _unit("series_id", "t", F.lit("odd"), F.lit(seed)) < 0.005
    holiday = (F.dayofyear("ds") == F.floor(of("holiday") * 360) + 1).cast("double")
    parts = {
        "trend": size["trend"] * ((of("slope") - 0.5) * t / 365 + (of("slope2") - 0.5) * F.greatest(t - turn, F.lit(0)) / 365),
        "level": size["level"] * F.when(t >= shift, of("size") - 0.5).otherwise(0.0),
        "season": size["season"] * (F.sin(2 * F.pi() * (t / 365.25 + of("phase"))) + 0.5 * F.cos(2 * F.pi() * t / 7 + of("week"))),
        "holiday": size["holiday"] * holiday * (1 + of("big")),
        "anomaly": F.when(odd, size["anomaly"] * (_unit("series_id", "t", F.lit("odd2"), F.lit(seed)) - 0.5)).otherwise(0.0),
        "noise": size["noise"] * _normal("noise", seed),
    }
    out = g.withColumns({"base": 50 + 50 * of("base"), **parts}).withColumns({"is_anomaly": odd, "is_shift": t == shift})
    y = F.col("base") + sum((F.col(p) for p in parts), F.lit(0.0))
    return out.select("series_id", "ds", y.alias("y"), "base", *parts, "is_anomaly", "is_shift")


def template_of() -> str:
    return json.dumps({"trend": 20.0, "level": 30.0, "season": 8.0, "holiday": 15.0, "anomaly": 80.0, "noise": 2.0})


def tune(spark: SparkSession, target: DataFrame, rounds: int = 5, seed: int = 1) -> str:
    """The template, of some drawn ones, whose series are most like the target's: by the spread and
    the mean step of the series, one aggregation a draw."""
    import random

    def stats(p: DataFrame):
        d = p.withColumn("_d", F.abs(F.col("y") - F.lag("y").over(_S().orderBy("ds"))))
        return d.groupBy("series_id").agg(F.stddev_samp("y").alias("s"), F.avg("_d").alias("d")).agg(F.avg("s"), F.avg("d")).first()

    want, r, best = stats(target), random.Random(seed), None
    base = json.loads(template_of())
    for _ in range(rounds):
        made = {k: v * 10 ** r.uniform(-1, 1) for k, v in base.items()}
        got = stats(labelled(spark, 4, 365, seed=seed, template=json.dumps(made)))
        gap = sum(abs(a - b) / (abs(a) + 1e-9) for a, b in zip(want, got))
        if best is None or gap < best[0]:
            best = (gap, json.dumps(made))
    return best[1]
