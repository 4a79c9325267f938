"""Window features of a filled panel; each is one sort of a series, and frames are rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .impute import S, T


def lags(panel: DataFrame, n: int = 7) -> DataFrame:
    """The n values before each row as columns lag1 to lagN."""
    return panel.withColumns({f"lag{k}": F.lag("y", k).over(T()) for k in range(1, n + 1)})


def rolling(panel: DataFrame, window: int = 10) -> DataFrame:
    """Minimum, maximum, mean, median, 10 % and 90 % quantile and deviation of the last rows."""
    w = T().rowsBetween(1 - window, 0)
    q = lambda p: F.percentile("y", F.lit(p)).over(w)
    return panel.select(
        "series_id", "ds", F.min("y").over(w).alias("low"), F.max("y").over(w).alias("high"), F.avg("y").over(w).alias("mean"), q(0.5).alias("median"), q(0.1).alias("q10"), q(0.9).alias("q90"), F.stddev_samp("y").over(w).alias("std")
    )


def rolling_regression(panel: DataFrame, window: int = 10) -> DataFrame:
    """Slope and intercept over the last rows, against the row's number in its series; null on its first row."""
    w = T().rowsBetween(1 - window, 0)
    held = panel.withColumn("_x", (F.row_number().over(T()) - 1).cast("double"))
    return held.select("series_id", "ds", F.regr_slope("y", "_x").over(w).alias("slope"), F.regr_intercept("y", "_x").over(w).alias("intercept"))


def ewma(panel: DataFrame, span: int = 7) -> DataFrame:
    """Exponentially weighted mean with normalised weights.

    A row folds only the rows whose weight a double can tell from 0 beside the first one's, so
    its memory is bounded however long the series is.
    """
    keep = 1 - 2 / (span + 1)
    rows = math.ceil(math.log(1e-17) / math.log(keep))
    w = T().rowsBetween(-rows, 0)
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    step = lambda a, x: F.struct((a["n"] * keep + x).alias("n"), (a["d"] * keep + 1).alias("d"))
    held = panel.withColumn("_v", F.collect_list("y").over(w))
    return held.select("series_id", "ds", F.aggregate("_v", zero, step, lambda a: a["n"] / F.nullif(a["d"], F.lit(0.0))).alias("y"))


def cumulative_product(panel: DataFrame) -> DataFrame:
    """Running product, from logarithms and the number of negative factors; 0 stays 0."""
    w = T().rowsBetween(Window.unboundedPreceding, 0)
    size = F.exp(F.sum(F.log(F.abs(F.nullif("y", F.lit(0.0))))).over(w))
    sign = F.when(F.pmod(F.count_if(F.col("y") < 0).over(w), F.lit(2)) == 1, -1.0).otherwise(1.0)
    return panel.select("series_id", "ds", F.when(F.count_if(F.col("y") == 0).over(w) > 0, 0.0).otherwise(size * sign).alias("y"))


def rank_in_history(panel: DataFrame) -> DataFrame:
    """Percentile rank (equal values share the mean rank) of each series' last value in its history."""
    held = panel.withColumn("_last", F.max_by("y", "ds").over(S()))
    below, upto, n = F.count_if(F.col("y") < F.col("_last")), F.count_if(F.col("y") <= F.col("_last")), F.count("y")
    return held.groupBy("series_id").agg(((below + upto + (upto > below).cast("int")) * 50.0 / n).alias("rank"))


def last_window(panel: DataFrame, size: int = 10) -> DataFrame:
    """Each series' last `size` values as one array; only these rows are kept before they meet."""
    held = panel.withColumn("_r", F.row_number().over(S().orderBy(F.col("ds").desc()))).where(F.col("_r") <= size)
    return held.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ds", "y"))), lambda x: x["y"]).alias("window"))


def make_windows(panel: DataFrame, size: int, horizon: int, stride: int = 1, share: float = 1.0, normalise: bool = False, seed: int = 0) -> DataFrame:
    """Windows of `size` values (x) from every `stride`-th row and the `horizon` values behind them
    (target); a share of them by a hash; normalised by a window's least and greatest value."""
    ahead = F.collect_list("y").over(T().rowsBetween(0, size - 1))
    after = F.collect_list("y").over(T().rowsBetween(size, size + horizon - 1))
    held = panel.withColumns({"x": ahead, "target": after, "_i": F.row_number().over(T()) - 1})
    held = held.where((F.size("x") == size) & (F.size("target") == horizon) & (F.col("_i") % stride == 0))
    if share < 1:
        held = held.where(F.pmod(F.xxhash64("series_id", "ds", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))
    if normalise:
        lo, span = F.array_min("x"), F.nullif(F.array_max("x") - F.array_min("x"), F.lit(0.0))
        scaled = lambda c: F.transform(c, lambda v: F.coalesce((v - lo) / span, F.lit(0.0)))
        held = held.select("series_id", "ds", scaled("target").alias("target"), scaled("x").alias("x"))
    return held.select("series_id", "ds", "x", "target")


def moving_sum(panel: DataFrame, size: int) -> DataFrame:
    return panel.withColumn("y", F.sum("y").over(T().rowsBetween(1 - size, 0))).select("series_id", "ds", "y")


def forward_mean(panel: DataFrame, size: int) -> DataFrame:
    """Mean of a row and the `size` - 1 rows ahead."""
    return panel.withColumn("y", F.avg("y").over(T().rowsBetween(0, size - 1))).select("series_id", "ds", "y")


def features(panel: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    """`rolling` and more: short less long mean, running energy (in millions), count of values that
    are not 0, and the correlation with the row before, over the last rows."""
    w = T().rowsBetween(1 - long, 0)
    held = rolling(panel, long).join(panel, ["series_id", "ds"]).withColumn("_p", F.lag("y").over(T()))
    both = F.when(F.col("_p").isNotNull(), F.col("y"))
    spread = F.nullif(F.stddev_pop(both).over(w) * F.stddev_pop("_p").over(w), F.lit(0.0))
    corr = F.when(F.row_number().over(T()) > 3, F.covar_pop("y", "_p").over(w) / spread)
    return held.withColumns(
        {
            "macd": F.avg("y").over(T().rowsBetween(1 - short, 0)) - F.avg("y").over(w),
            "energy": F.sum(F.col("y") * F.col("y") / 1e6).over(T().rowsBetween(Window.unboundedPreceding, 0)),
            "nonzero": F.count_if(F.col("y") != 0).over(w),
            "autocorrelation": corr,
        }
    ).drop("_p")


def melt_intervals(forecast: DataFrame, interval: float) -> DataFrame:
    """A row a value: the point as 50%, the bounds under their quantile's name."""
    low, high = (f"{round(100 * p, 6)}%" for p in ((1 - interval) / 2, 1 - (1 - interval) / 2))
    cells = F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).alias("value")) for n, c in (("50%", "forecast"), (low, "lower"), (high, "upper"))])
    return forecast.select("series_id", "step", F.explode(cells).alias("x")).select("series_id", "step", "x.*")


def sum_components(frames: list[DataFrame]) -> DataFrame:
    """Aligned component tables (series_id, ds, y) added up."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("series_id", "ds").agg(F.sum("y").alias("y"))
