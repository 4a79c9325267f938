"""Transformers that run a numpy kernel over a series, or over all series of a batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as k
from .models import _days, _design
from .transforms import Transformer


def _schema(panel: DataFrame) -> str:
    return f"series_id string, ds {dict(panel.dtypes)['ds']}, y double"


def _each(panel: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        return rows.assign(y=f(k.filled(rows["y"].to_numpy(float)), _days(rows["ds"])))

    return panel.select("series_id", "ds", "y").groupBy("series_id").applyInPandas(run, _schema(panel))


def filter_of(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Transformer:
    """A filter of each series; its inverse gives values as they are."""
    return Transformer(lambda p: p.select("series_id").distinct(), lambda p, s: _each(p, f), lambda p, s, mode="forecast": p)


def fitted(fit: Callable[[np.ndarray, np.ndarray], np.ndarray], value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Transformer:
    """What a fitted curve of time gives is taken off, and added by the inverse, ahead as well.
    Parameters are one array a series."""

    def fit_all(panel: DataFrame) -> DataFrame:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("ds")
            return pd.DataFrame({"series_id": [rows["series_id"].iloc[0]], "_c": [fit(k.filled(rows["y"].to_numpy(float)), _days(rows["ds"])).tolist()]})

        return panel.select("series_id", "ds", "y").groupBy("series_id").applyInPandas(run, "series_id string, _c array<double>")

    def moved(p: DataFrame, s: DataFrame, sign: int) -> DataFrame:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return rows[["series_id", "ds"]].assign(y=rows["y"].to_numpy(float) + sign * value(np.array(rows["_c"].iloc[0], float), _days(rows["ds"])))

        return p.select("series_id", "ds", "y").join(s, "series_id").groupBy("series_id").applyInPandas(run, _schema(p))

    return Transformer(fit_all, lambda p, s: moved(p, s, -1), lambda p, s, mode="forecast": moved(p, s, 1))


def _sine_fit(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A sin(w t) + B cos(w t) + c at the strongest frequency, refined by golden section."""
    x = y - y.mean()
    f = np.abs(np.fft.rfft(x))
    w0 = 2 * np.pi * (int(f[1:].argmax()) + 1 if len(f) > 1 else 1) / max(len(y), 2)
    step = np.median(np.diff(t)) if len(t) > 1 else 1.0

    def of(w):
        d = np.column_stack((np.sin(w * t), np.cos(w * t), np.ones(len(t))))
        c = np.linalg.lstsq(d, y, rcond=None)[0]
        return ((y - d @ c) ** 2).sum(), c

    grid = np.linspace(0.5, 1.5, 41) * w0 / step
    w = min(grid, key=lambda v: of(v)[0])
    return np.array([w, *of(w)[1]])


def _ramp_fit(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.concatenate(([t[0], t[-1]], k.ridge(_design(t, t, 60, seasonal=False), y, 0.1)))


def _ramp_value(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    return _design(t, np.array(c[:2]), 60, seasonal=False) @ c[2:]


def _date_fit(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.concatenate(([t[0], t[-1]], k.ridge(_design(t, t, None), y, 0.1)))


def _date_value(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    return _design(t, np.array(c[:2]), None) @ c[2:]


def _harmonic_fit(y: np.ndarray, t: np.ndarray, n: int = 5) -> np.ndarray:
    """The n strongest harmonics around the regression line: origin, line, then w, a, b of each."""
    x = t - t[0]
    b, a = np.polyfit(x, y, 1) if len(y) > 1 else (0.0, y[0])
    f = np.fft.rfft(y - a - b * x)
    top = np.argsort(-np.abs(f[1:]))[:n] + 1
    parts = [(2 * np.pi * i / len(y), 2 * f[i].real / len(y), -2 * f[i].imag / len(y)) for i in top]
    return np.concatenate(([t[0], a, b], *parts))


def _harmonic_value(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    x = t - c[0]
    out = c[1] + c[2] * x
    for w, a, b in c[3:].reshape(-1, 3):
        out = out + a * np.cos(w * x) + b * np.sin(w * x)
    return out


def _power(lam: float, y: np.ndarray) -> np.ndarray:
    up, down = np.maximum(y, 0), np.maximum(-y, 0)
    a = np.log1p(up) if abs(lam) < 1e-8 else ((up + 1) ** lam - 1) / lam
    b = -np.log1p(down) if abs(lam - 2) < 1e-8 else -((down + 1) ** (2 - lam) - 1) / (2 - lam)
    return np.where(y >= 0, a, b)


def _power_back(lam: float, z: np.ndarray) -> np.ndarray:
    a = np.expm1(np.maximum(z, 0)) if abs(lam) < 1e-8 else np.maximum(np.maximum(z, 0) * lam + 1, 1e-12) ** (1 / lam) - 1
    b = -np.expm1(-np.minimum(z, 0)) if abs(lam - 2) < 1e-8 else 1 - np.maximum(1 - np.minimum(z, 0) * (2 - lam), 1e-12) ** (1 / (2 - lam))
    return np.where(z >= 0, a, b)


def _mapped(fit, forward, back) -> Transformer:
    """Values through a function with an array of parameters a series, and its inverse."""

    def fit_all(panel: DataFrame) -> DataFrame:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"series_id": [rows["series_id"].iloc[0]], "_c": [fit(rows["y"].dropna().to_numpy(float)).tolist()]})

        return panel.select("series_id", "y").groupBy("series_id").applyInPandas(run, "series_id string, _c array<double>")

    def through(p: DataFrame, s: DataFrame, f) -> DataFrame:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return rows[["series_id", "ds"]].assign(y=f(np.array(rows["_c"].iloc[0], float), rows["y"].to_numpy(float)))

        return p.select("series_id", "ds", "y").join(s, "series_id").groupBy("series_id").applyInPandas(run, _schema(p))

    return Transformer(fit_all, lambda p, s: through(p, s, forward), lambda p, s, mode="forecast": through(p, s, back))


def _yeo_johnson_fit(y: np.ndarray) -> np.ndarray:
    """The power of greatest likelihood, of standardised values, from a grid."""
    m, s = (y.mean(), y.std() or 1.0) if len(y) else (0.0, 1.0)
    z = (y - m) / s
    like = lambda l: -0.5 * len(z) * np.log(max(_power(l, z).var(), 1e-12)) + (l - 1) * (np.sign(z) * np.log1p(np.abs(z))).sum()  # noqa: E731, E741
    lam = max(np.linspace(-2, 4, 61), key=like) if len(z) else 1.0
    w = _power(lam, z)
    return np.array([lam, m, s, w.mean() if len(w) else 0.0, (w.std() or 1.0) if len(w) else 1.0])


def power() -> Transformer:
    return _mapped(_yeo_johnson_fit, lambda c, y: (_power(c[0], (y - c[1]) / c[2]) - c[3]) / c[4], lambda c, z: _power_back(c[0], z * c[4] + c[3]) * c[2] + c[1])


def quantile(n: int = 100) -> Transformer:
    """Values as their place among n quantiles of the series, from 0 to 1."""

    def forward(c, y):
        grid = np.linspace(0, 1, len(c))
        return 0.5 * (np.interp(y, c, grid) - np.interp(-y, -c[::-1], -grid[::-1]))

    return _mapped(lambda y: np.quantile(y, np.linspace(0, 1, min(n, max(len(y), 2)))) if len(y) else np.zeros(2), forward, lambda c, z: np.interp(z, np.linspace(0, 1, len(c)), c))


def across(fit: Callable[[np.ndarray], np.ndarray], names: str) -> Transformer:
    """A linear change of the series of a date into as many components: fitted on the matrix of all
    series of one group, with the pseudo-inverse as its way back.

    Parameters are one row: the series' names, means and the matrix. The dates' vectors are made by
    one aggregation, so the matrix is applied without any group's memory growing with time; only
    the fit takes the covariance's rows, which are series by series.
    """

    def vectors(p: DataFrame) -> DataFrame:
        return p.groupBy("ds").agg(F.sort_array(F.collect_list(F.struct("series_id", "y"))).alias("v"))

    def fit_all(panel: DataFrame) -> DataFrame:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            wide = rows.pivot_table(index="ds", columns="series_id", values="y", aggfunc="first").sort_index()
            x = np.column_stack([k.filled(wide[c].to_numpy(float)) for c in wide.columns])
            w = fit(x - x.mean(0))
            return pd.DataFrame({"_m": [x.mean(0).tolist()], "_w": [w.tolist()], "_b": [np.linalg.pinv(w).tolist()], "_names": [list(wide.columns)]})

        return panel.select("series_id", "ds", "y").withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "_m array<double>, _w array<array<double>>, _b array<array<double>>, _names array<string>")

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def apply(p: DataFrame, s: DataFrame) -> DataFrame:
        held = vectors(p).crossJoin(F.broadcast(s))
        x = F.zip_with(F.transform("v", lambda e: e["y"]), F.col("_m"), lambda a, b: a - b)
        made = held.withColumn("_x", x).select("ds", F.posexplode(F.transform("_w", lambda row: dot(row, F.col("_x")))).alias("_i", "y"))
        return made.select(F.format_string(names + "%03d", F.col("_i")).alias("series_id"), "ds", "y")

    def invert(p: DataFrame, s: DataFrame, mode: str = "forecast") -> DataFrame:
        held = vectors(p).crossJoin(F.broadcast(s)).withColumn("_x", F.transform("v", lambda e: e["y"]))
        back = F.zip_with(F.transform("_b", lambda row: dot(row, F.col("_x"))), F.col("_m"), lambda a, b: a + b)
        return held.select("ds", F.explode(F.arrays_zip(F.col("_names").alias("n"), back.alias("y"))).alias("z")).select(F.col("z.n").alias("series_id"), "ds", F.col("z.y").alias("y"))

    return Transformer(fit_all, apply, invert)


def _pca(x: np.ndarray) -> np.ndarray:
    v = np.linalg.svd(x, full_matrices=False)[2]
    return v * np.where(v.sum(1, keepdims=True) < 0, -1, 1)


def _ica(x: np.ndarray) -> np.ndarray:
    """Independent components by symmetric fixed-point steps with tanh, of whitened series."""
    w, e = np.linalg.eigh(np.cov(x.T) + 1e-9 * np.eye(x.shape[1]))
    white = (e / np.sqrt(np.maximum(w, 1e-9))) @ e.T
    z = x @ white
    b = np.linalg.qr(np.random.default_rng(0).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(200):
        g = np.tanh(z @ b.T)
        new = g.T @ z / len(z) - np.diag((1 - g * g).mean(0)) @ b
        u, _, v = np.linalg.svd(new)
        if np.abs(np.abs(np.diag(u @ v @ b.T)) - 1).max() < 1e-6:
            b = u @ v
            break
        b = u @ v
    return b @ white


def _btcd(x: np.ndarray) -> np.ndarray:
    """The most and least predictable combinations, from a regression on the step before."""
    now, before = x[1:], x[:-1]
    fit = before @ np.linalg.lstsq(before, now, rcond=None)[0]
    w, v = np.linalg.eig(np.linalg.solve(now.T @ now + 1e-6 * np.trace(now.T @ now) * np.eye(x.shape[1]), fit.T @ fit))
    return v.real[:, np.argsort(w.real)].T


def theta_lines(thetas: tuple = (0.0, 2.0)) -> Transformer:
    """Each series as its regression line bent by each theta; the inverse solves for the series."""
    day = lambda: F.datediff("ds", F.lit("1970-01-01").cast("date")).cast("double")

    def fit(p: DataFrame) -> DataFrame:
        held = p.withColumn("_x", day())
        return held.groupBy("series_id").agg(F.regr_slope("y", "_x").alias("_b"), F.regr_intercept("y", "_x").alias("_a"))

    def apply(p: DataFrame, s: DataFrame) -> DataFrame:
        line = F.col("_a") + F.col("_b") * day()
        return p.join(s, "series_id").select(F.explode(F.array(*[F.struct(F.concat("series_id", F.lit(f"|theta{i}")).alias("series_id"), "ds", (line + t * (F.col("y") - line)).alias("y")) for i, t in enumerate(thetas)])).alias("z")).select("z.*")

    def invert(p: DataFrame, s: DataFrame, mode: str = "forecast") -> DataFrame:
        name, i = F.substring_index("series_id", "|theta", 1), F.substring_index("series_id", "|theta", -1).cast("int")
        held = p.select(name.alias("series_id"), "ds", F.get(F.array(*map(F.lit, thetas)), i).alias("_t"), "y").join(s, "series_id")
        line = F.col("_a") + F.col("_b") * day()
        bent = F.sum(F.col("_t") * (F.col("y") - line)) / F.nullif(F.sum(F.col("_t") * F.col("_t")), F.lit(0.0))
        return held.withColumn("_l", line).groupBy("series_id", "ds").agg((F.first("_l") + bent).alias("y"))

    return Transformer(fit, apply, invert)


def center_split(fill: str = "ffill") -> Transformer:
    """Magnitude (with zeroes filled) and occurrence as two series; the inverse multiplies them."""
    from .impute import impute

    def apply(p: DataFrame, s: DataFrame) -> DataFrame:
        size = impute(p.withColumn("y", F.nullif("y", F.lit(0.0))), fill).withColumn("series_id", F.concat("series_id", F.lit("|size")))
        there = p.select(F.concat("series_id", F.lit("|there")).alias("series_id"), "ds", (F.col("y") != 0).cast("double").alias("y"))
        return size.unionByName(there)

    return Transformer(lambda p: p.select("series_id").distinct(), apply, lambda p, s, mode="forecast": _product_of(p))


def mean_ratio(window: int = 10, least: float = 1e-10) -> Transformer:
    """The rolling mean and the value's ratio to it as two series; the inverse multiplies them."""

    def apply(p: DataFrame, s: DataFrame) -> DataFrame:
        w = Window.partitionBy("series_id").orderBy("ds").rowsBetween(1 - window, 0)
        m = F.when(F.abs(F.avg("y").over(w)) < least, F.lit(least)).otherwise(F.avg("y").over(w))
        held = p.withColumn("_m", m)
        return held.select(F.concat("series_id", F.lit("|mean")).alias("series_id"), "ds", F.col("_m").alias("y")).unionByName(held.select(F.concat("series_id", F.lit("|ratio")).alias("series_id"), "ds", (F.col("y") / F.col("_m")).alias("y")))

    return Transformer(lambda p: p.select("series_id").distinct(), apply, lambda p, s, mode="forecast": _product_of(p))


def _product_of(p: DataFrame) -> DataFrame:
    """Two parts of each series multiplied; `there` counts from a half on."""
    name, part = F.substring_index("series_id", "|", 1), F.substring_index("series_id", "|", -1)
    y = F.when(part == "there", F.greatest(F.least("y", F.lit(1.0)), F.lit(0.0))).otherwise(F.col("y"))
    return p.select(name.alias("series_id"), "ds", y.alias("y")).groupBy("series_id", "ds").agg(F.try_element_at(F.collect_list("y"), F.lit(1)).alias("a"), F.try_element_at(F.collect_list("y"), F.lit(2)).alias("b")).select("series_id", "ds", (F.col("a") * F.col("b")).alias("y"))


def rescale(factor: int = 3, mode: str = "downscale", how: str = "mean") -> Transformer:
    """Blocks of `factor` rows, counted from the end, as one (their mean, or their last row); or as
    many rows on a straight line between two. The inverse of one is the other."""
    s_ = lambda: Window.partitionBy("series_id").orderBy("ds")

    def down(p: DataFrame) -> DataFrame:
        back = F.floor((F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ds").desc())) - 1) / factor)
        y = F.avg("y") if how == "mean" else F.max_by("y", "ds")
        return p.withColumn("_b", back).groupBy("series_id", "_b").agg(F.max("ds").alias("ds"), y.alias("y")).select("series_id", "ds", "y")

    def up(p: DataFrame) -> DataFrame:
        held = p.withColumns({"_p": F.lag("y").over(s_()), "_d": F.lag("ds").over(s_())})
        days = F.datediff("ds", "_d")
        part = F.explode(F.when(F.col("_d").isNull(), F.array(F.lit(factor))).otherwise(F.sequence(F.lit(1), F.lit(factor))))
        rows = held.withColumn("_n", days).select("series_id", "ds", "y", "_p", "_n", part.alias("_k"))
        at = F.when(F.col("_p").isNull(), F.col("ds")).otherwise(F.date_sub("ds", (F.col("_n") - F.floor(F.col("_n") * F.col("_k") / factor)).cast("int")))
        return rows.select("series_id", at.alias("ds"), F.when(F.col("_p").isNull(), F.col("y")).otherwise(F.col("_p") + (F.col("y") - F.col("_p")) * F.col("_k") / factor).alias("y"))

    a, b = (down, up) if mode == "downscale" else (up, down)
    return Transformer(lambda p: p.select("series_id").distinct(), lambda p, s: a(p), lambda p, s, m="forecast": b(p))


def diff_smoother(k_: float = 2.0) -> Transformer:
    """Steps beyond k deviations of those of their sign are cut there, and summed up again back from
    the last row."""

    def apply(p: DataFrame, s: DataFrame) -> DataFrame:
        w, g = Window.partitionBy("series_id").orderBy("ds"), Window.partitionBy("series_id")
        d = p.withColumn("_d", F.lead("y").over(w) - F.col("y"))
        up, down = (k_ * F.sqrt(F.avg(F.when(c, F.col("_d") * F.col("_d"))).over(g)) for c in (F.col("_d") > 0, F.col("_d") < 0))
        cut = F.when(F.col("_d") > 0, F.least("_d", up)).otherwise(F.greatest("_d", -down))
        held = d.withColumns({"_c": F.coalesce(cut, F.lit(0.0)), "_last": F.max_by("y", "ds").over(g)})
        after = F.sum("_c").over(Window.partitionBy("series_id").orderBy(F.col("ds").desc()).rowsBetween(Window.unboundedPreceding, 0))
        return held.select("series_id", "ds", (F.col("_last") - after).alias("y"))

    return Transformer(lambda p: p.select("series_id").distinct(), apply, lambda p, s, mode="forecast": p)


def local_linear_trend(share: float = 0.1) -> Transformer:
    """A centred rolling regression taken off; the inverse adds the last rows' line ahead."""
    day = lambda: F.datediff("ds", F.lit("1970-01-01").cast("date")).cast("double")

    def fit(p: DataFrame) -> DataFrame:
        g = Window.partitionBy("series_id")
        held = p.withColumns({"_x": day(), "_n": F.count("*").over(g), "_r": F.row_number().over(g.orderBy(F.col("ds").desc()))})
        tail = held.where(F.col("_r") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(2)))
        return tail.groupBy("series_id").agg(F.coalesce(F.regr_slope("y", "_x"), F.lit(0.0)).alias("_b"), F.coalesce(F.regr_intercept("y", "_x"), F.avg("y")).alias("_a"))

    def off(p: DataFrame, s: DataFrame) -> DataFrame:
        w = Window.partitionBy("series_id").orderBy("ds").rowsBetween(-15, 15)
        held = p.withColumn("_x", day())
        line = F.regr_slope("y", "_x").over(w) * F.col("_x") + F.regr_intercept("y", "_x").over(w)
        return held.select("series_id", "ds", (F.col("y") - F.coalesce(line, F.avg("y").over(w))).alias("y"))

    ahead = lambda p, s, mode="forecast": p.join(s, "series_id").select("series_id", "ds", (F.col("y") + F.col("_a") + F.col("_b") * day()).alias("y"))
    return Transformer(fit, off, ahead)


def _regression_filter(y: np.ndarray, t: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    x = _design(t, t, 90)
    line = x @ k.ridge(x, y, 0.1)
    rest = y - line
    return line + np.clip(rest, -sigma * rest.std(), sigma * rest.std())


def _g726(y: np.ndarray, t: np.ndarray, bits: int = 4, rate: float = 0.96, alpha: float = 0.92) -> np.ndarray:
    """Adaptive differences: each value's step from the prediction is cut to one of a few levels
    whose size follows the steps before."""
    out, guess = np.empty_like(y), y[0] if len(y) else 0.0
    size, half = max(np.abs(np.diff(y)).mean() if len(y) > 1 else 1.0, 1e-9), 2 ** (bits - 1)
    before = guess
    for i, v in enumerate(y):
        level = np.clip(np.round((v - guess) / size), -half, half - 1)
        out[i] = guess + level * size
        size = max(rate * size + (1 - rate) * abs(level) * size * 2, 1e-9)
        guess, before = out[i] + (1 - alpha) * (out[i] - before), out[i]
    return out


TRANSFORMERS: dict[str, Callable[..., Transformer]] = {
    "hp_filter": lambda lamb=1600.0, part="trend": filter_of(lambda y, t: k.hp_filter(y, lamb) if part == "trend" else y - k.hp_filter(y, lamb)),
    "bk_filter": lambda low=6, high=32, width=12: filter_of(lambda y, t: k.bk_filter(y, low, high, width)),
    "bk_bandpass": lambda low=6, high=32, width=1: filter_of(lambda y, t: y - k.filled(k.bk_filter(y, low, high, width))),
    "cf_filter": lambda low=6, high=32: filter_of(lambda y, t: k.cf_filter(y, low, high)),
    "stl": lambda part="trend", seasonal=7: filter_of(lambda y, t: k.stl(y, seasonal)[("trend", "seasonal", "rest").index(part)]),
    "seasonal_decompose": lambda part="trend", seasonal=7: filter_of(lambda y, t: k.filled(k.decompose(y, seasonal)[("trend", "seasonal", "rest").index(part)])),
    "savgol": lambda width=9, degree=2: filter_of(lambda y, t: k.savgol(y, width, degree)),
    "wiener": lambda width=5: filter_of(lambda y, t: k.wiener(y, width)),
    "hilbert": lambda: filter_of(lambda y, t: k.hilbert(y)),
    "butter": lambda order=3, cutoff=0.2: filter_of(lambda y, t: k.both_ways(y, *k.butter(order, cutoff))),
    "fir": lambda numtaps=64, cutoff=0.1, window="hamming": filter_of(lambda y, t: k.fir(y, k.fir_taps(numtaps, cutoff, window))),
    "fft_filter": lambda cutoff=0.1, reverse=False: filter_of(lambda y, t: k.fft_filter(y, cutoff, reverse)),
    "kalman_smoothing": lambda noise=0.1, r=1.0: filter_of(lambda y, t: k.kalman(y, *k.local_trend(noise), r)[0]),
    "regression_filter": lambda sigma=2.0: filter_of(lambda y, t: _regression_filter(y, t, sigma)),
    "g726": lambda bits=4: filter_of(lambda y, t: _g726(y, t, bits)),
    "l1_trend": lambda lam=1.0: filter_of(lambda y, t: k.l1_trend(y[-600:], lam) if len(y) <= 600 else np.concatenate((y[:-600], k.l1_trend(y[-600:], lam)))),
    "sine_trend": lambda: fitted(_sine_fit, lambda c, t: c[1] * np.sin(c[0] * t) + c[2] * np.cos(c[0] * t) + c[3]),
    "changepoint_detrend": lambda: fitted(_ramp_fit, _ramp_value),
    "datepart_regression": lambda: fitted(_date_fit, _date_value),
    "fft_decomposition": lambda n=5: fitted(lambda y, t: _harmonic_fit(y, t, n), _harmonic_value),
    "power": power,
    "quantile": quantile,
    "pca": lambda: across(_pca, "pc"),
    "fast_ica": lambda: across(_ica, "ic"),
    "btcd": lambda: across(_btcd, "bt"),
    "cointegration": lambda: across(lambda x: k.johansen(x)[1].T, "co"),
    "theta": theta_lines,
    "center_split": center_split,
    "mean_ratio": mean_ratio,
    "rescale": rescale,
    "diff_smoother": diff_smoother,
    "local_linear_trend": local_linear_trend,
}
