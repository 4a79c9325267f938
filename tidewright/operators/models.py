"""Forecast models by name: numpy kernels over one series, or over a batch of series together.

A series is one group of rows, so what a task holds is bounded by the longest series (or by the
series of a batch); the kernels run in Arrow-fed pandas groups. A model that fails on a group
leaves a row that says so and no forecast, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forecast as native
from . import kernels as k
from . import lineage
from .regressors import regressor

SCHEMA = "series_id string, step int, forecast double, lower double, upper double, exception string"

# Univariate models: f(y, t, h, **params) gives the forecast and its deviation (a number or a value
# a step; None: that of the history's steps). t is days since 1970.


def _design(t: np.ndarray, t0: np.ndarray, spacing: float | None = 180, end: float = 120, seasonal: bool = True) -> np.ndarray:
    parts = [np.ones((len(t), 1)), ((t - t0[0]) / 365.25)[:, None]]
    if spacing:
        parts.append(k.ramps(t, t0[0], t0[-1], spacing, end))
    if seasonal:
        parts.append(k.calendar(t))
    return np.hstack(parts)


def _future(t: np.ndarray, h: int) -> np.ndarray:
    step = np.median(np.diff(t)) if len(t) > 1 else 1.0
    return t[-1] + step * np.arange(1, h + 1)


def linear(y, t, h, spacing=180, lam=0.01, phi=1.0, seasonal=True, **_):
    """Ridge on trend, its changes and the calendar; the deviation grows with the leverage of the
    future rows. phi damps what the trend adds."""
    new = _future(t, h)
    x, z = _design(t, t, spacing, seasonal=seasonal), _design(new, t, spacing, seasonal=seasonal)
    c = k.ridge(x, y, lam)
    sigma = np.sqrt(((y - x @ c) ** 2).sum() / max(len(y) - x.shape[1], 1))
    inv = np.linalg.pinv(x.T @ x + lam * np.eye(x.shape[1]))
    out = z @ c
    if phi != 1.0:
        rows = 1 + (k.ramps(new, t[0], t[-1], spacing).shape[1] if spacing else 0)
        trend = z[:, 1 : 1 + rows] @ c[1 : 1 + rows]
        steps = np.diff(trend, prepend=x[-1, 1 : 1 + rows] @ c[1 : 1 + rows])
        out = out - trend + trend[0] - steps[0] + np.cumsum(steps * phi ** np.arange(1, h + 1))
    return out, sigma * np.sqrt(1 + np.einsum("ij,jk,ik->i", z, inv, z))


def gls(y, t, h, spacing=None, constant=True, **_):
    new, o = _future(t, h), t[0]
    x, z = ((np.column_stack([np.ones(len(v))] * constant + [v - o])) for v in (t, new))
    if spacing:
        x, z = np.hstack((x, k.ramps(t, o, t[-1], spacing))), np.hstack((z, k.ramps(new, o, t[-1], spacing)))
    c = np.linalg.lstsq(x, y, rcond=None)[0]
    return z @ c, float(np.std(y - x @ c))


def glm(y, t, h, family="Gaussian", **_):
    """A linear trend in the logarithm for Poisson and Gamma (fitted by reweighting), else plain."""
    if family == "Gaussian" or y.min() < 0:
        return gls(y, t, h)
    x, z = (np.column_stack((np.ones(len(v)), (v - t[0]) / max(t[-1] - t[0], 1))) for v in (t, _future(t, h)))
    mu = np.maximum(y, 0.1 * max(y.mean(), 1e-6))
    for _ in range(25):
        w = mu if family == "Poisson" else np.ones(len(y))
        work = np.log(mu) + (y - mu) / mu
        c = np.linalg.lstsq(x * np.sqrt(w)[:, None], work * np.sqrt(w), rcond=None)[0]
        mu = np.exp(np.clip(x @ c, -30, 30))
    return np.exp(np.clip(z @ c, -30, 30)), float(np.std(y - mu))


def ets(y, t, h, trend=True, seasonal=7, damped=0.98, **_):
    return k.smoothing(y, h, trend, seasonal, damped)


def arima(y, t, h, p=7, d=1, q=1, **_):
    out, sigma = k.arima(y, h, p, d, q)
    return out, sigma * np.sqrt(np.arange(1, h + 1))


def ardl(y, t, h, lags=7, lam=1e-3, **_):
    """Lags and the calendar, regressed on together and continued step by step."""
    new = _future(t, h)
    cal, ahead = k.calendar(t), k.calendar(new)
    x, now = k.lagged(y, lags)
    m = regressor("Ridge", lam=lam).fit(np.hstack((x, cal[lags:])), now[:, None])
    rows = y.tolist()
    for i in range(h):
        v = np.concatenate((rows[: -lags - 1 : -1], ahead[i]))[None]
        rows.append(float(m.predict(v)[0, 0]))
    return np.array(rows[len(y) :]), float(np.std(now - m.predict(np.hstack((x, cal[lags:])))[:, 0]))


def arch(y, t, h, **_):
    mean, sd = k.garch(y, h)
    return np.full(h, mean), sd


def kalman(y, t, h, noise=0.1, seasonal=7, **_):
    """A local trend and a season of dummies; the observation's noise is tuned by likelihood."""
    scale = y.std() or 1.0
    z = (y - y.mean()) / scale
    f, q, o = k.local_trend(noise / 10)
    if seasonal:
        s = np.vstack((-np.ones(seasonal - 1), np.eye(seasonal - 2, seasonal - 1)))
        f = np.block([[f, np.zeros((2, seasonal - 1))], [np.zeros((seasonal - 1, 2)), s]])
        q = np.diag([*np.diag(q), noise / 20, *np.zeros(seasonal - 2)])
        o = np.concatenate((o, [1.0], np.zeros(seasonal - 2)))
    best = max((k.kalman(z[-400:], f, q, o, r, 0, False)[3], r) for r in (0.05, 0.2, 0.5, 1.0))[1]
    _, out, sd, _ = k.kalman(z, f, q, o, best, h, False)
    return out * scale + y.mean(), sd * scale


def theta(y, t, h, period=7, **_):
    return k.theta(y, h, period), None


def fft(y, t, h, n_harmonics=10, detrend="linear", **_):
    whole = k.harmonics(y, n_harmonics, h, detrend)
    return whole[len(y) :], float(np.std(y - whole[: len(y)]))


def window_regression(y, t, h, window=14, regression_model="Ridge", model_params=None, **_):
    """The last `window` values on the next `h`, all of them at once."""
    n = len(y) - window - h + 1
    if n < 5:
        raise ValueError("the series is too short for its windows")
    at = np.arange(n)[:, None]
    x, out = y[at + np.arange(window)], y[at + window + np.arange(h)]
    base = x[:, -1:]
    m = regressor(regression_model, **(model_params or {})).fit(x - base, out - base)
    tail = y[-window:][None]
    rest = (out - base) - m.predict(x - base)
    return m.predict(tail - tail[:, -1:])[0] + tail[0, -1], rest.std(axis=0)


def rolling_features(y: np.ndarray) -> np.ndarray:
    """Features of each row from it and the rows before: lags, rolling statistics, their differences."""
    s = pd.Series(y)
    parts = [s.shift(i) for i in range(7)] + [s.rolling(7, 1).mean(), s.rolling(30, 1).mean(), s.rolling(7, 1).std(), s.rolling(28, 1).max(), s.rolling(28, 1).min(), s.rolling(7, 1).mean() - s.rolling(30, 1).mean(), s.ewm(span=7).mean()]
    return pd.concat(parts, axis=1).bfill().fillna(0.0).to_numpy()


def rolling_regression(y, t, h, regression_model="RandomForest", model_params=None, history=400, **_):
    """Rolling features and the calendar on the next value's step, continued one step at a time."""
    y = y[-history:]
    t = t[-len(y) :]
    cal, new = k.calendar(t), k.calendar(_future(t, h))
    x = np.hstack((rolling_features(y)[:-1], cal[1:]))
    m = regressor(regression_model, **(model_params or ({"trees": 10} if regression_model == "RandomForest" else {}))).fit(x, np.diff(y)[:, None])
    rows = y.copy()
    for i in range(h):
        v = np.concatenate((rolling_features(rows[-60:])[-1], new[i]))[None]
        rows = np.append(rows, rows[-1] + m.predict(v)[0, 0])
    return rows[len(y) :], None


def datepart_regression(y, t, h, regression_model="DecisionTree", model_params=None, **_):
    """The calendar alone."""
    day = lambda v: np.column_stack((k.calendar(v), (v + 3) % 7, v))
    m = regressor(regression_model, **(model_params or {})).fit(day(t), y[:, None])
    return m.predict(day(_future(t, h)))[:, 0], float(np.std(y - m.predict(day(t))[:, 0]))


def preprocessing_regression(y, t, h, window=14, regression_model="Ridge", model_params=None, **_):
    """Windows of the values and of their smoothed selves on the next values."""
    smooth = k.savgol(y, 9, 2)
    n = len(y) - window - h + 1
    at = np.arange(n)[:, None] + np.arange(window)
    base = y[at[:, -1:]]
    x, out = np.hstack((y[at] - base, smooth[at] - base)), y[np.arange(n)[:, None] + window + np.arange(h)] - base
    m = regressor(regression_model, **(model_params or {})).fit(x, out)
    tail = np.concatenate((y[-window:], smooth[-window:]))[None] - y[-1]
    return m.predict(tail)[0] + y[-1], (out - m.predict(x)).std(axis=0)


def gaussian_process(y, t, h, history=300, kernel="rbf", **_):
    y, t = y[-history:], t[-history:]
    m, s = y.mean(), y.std() or 1.0
    x = lambda v: np.column_stack((k.fourier(v, 7, 3), (v - t[0])[:, None] / 30))
    out, sd = k.gaussian_process(x(t), (y - m) / s, x(_future(t, h)), 0.3, 0.2, kernel)
    return out * s + m, sd * s


def bayesian(y, t, h, **_):
    x = _design(t, t)
    m = regressor("BayesianRidge").fit(x, y[:, None])
    z = _design(_future(t, h), t)
    return m.predict(z)[:, 0], m.interval(z, 1.0)[:, 0]


def seasonality_motif(y, t, h, kk=10, **_):
    """The values on the k past dates nearest to each future one in the calendar's features."""
    cal, new = k.calendar(t), k.calendar(_future(t, h))
    d = np.abs(new[:, None] - cal[None]).sum(-1)
    near = np.argsort(d, axis=1, kind="stable")[:, :kk]
    return y[near].mean(1), y[near].std(1)


def ball_tree_regression(y, t, h, kk=10, **_):
    """What followed the rows whose rolling features are nearest to the last one's."""
    x = rolling_features(y)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)
    d = np.abs(z[: len(y) - h] - z[-1]).sum(1)
    near = np.argsort(d, kind="stable")[:kk]
    paths = y[near[:, None] + 1 + np.arange(h)] - y[near][:, None]
    return y[-1] + paths.mean(0), paths.std(0)


def motif_simulation(y, t, h, phrase=5, kk=20, **_):
    """Continuations, as relative steps, of the past phrases with the same signs and like sizes as
    the last one."""
    step = np.diff(y) / np.where(y[:-1] != 0, np.abs(y[:-1]), 1.0)
    n = len(step) - phrase - h + 1
    if n < 1:
        return np.full(h, y[-1]), None
    at = np.arange(n)[:, None]
    past, tail = step[at + np.arange(phrase)], step[-phrase:]
    d = np.abs(past - tail).sum(1) + 10.0 * (np.sign(past) != np.sign(tail)).sum(1)
    near = np.argsort(d, kind="stable")[:kk]
    paths = y[-1] + np.cumsum(step[near[:, None] + phrase + np.arange(h)], axis=1) * abs(y[-1] or 1.0)
    return np.median(paths, axis=0), paths.std(0)


def components(y, t, h, **_):
    """Trend, season and rest apart (as Cassandra does): anomalies are cut, a ridge takes season and
    trend changes, an autoregression what they leave."""
    m, s = np.median(y), np.std(y) or 1.0
    cut = np.clip(y, m - 4 * s, m + 4 * s)
    x, z = _design(t, t, 90), _design(_future(t, h), t, 90)
    c = k.ridge(x, cut, 0.1)
    rest = cut - x @ c
    more, _ = k.arima(rest, h, 3, 0, 0)
    return z @ c + more, float(rest.std())


UNIVARIATE: dict[str, Callable] = {
    "BasicLinearModel": linear, "GLS": gls, "GLM": glm, "ETS": ets, "ARIMA": arima, "ARDL": ardl, "ARCH": arch, "KalmanStateSpace": kalman, "UnobservedComponents": kalman, "Theta": theta,
    "FFT": fft, "WindowRegression": window_regression, "RollingRegression": rolling_regression, "DatepartRegression": datepart_regression, "PreprocessingRegression": preprocessing_regression,
    "VectorizedMultiOutputGPR": gaussian_process, "BayesianMultiOutputRegression": bayesian, "SeasonalityMotif": seasonality_motif, "BallTreeRegressionMotif": ball_tree_regression,
    "MotifSimulation": motif_simulation, "Cassandra": components,
}

# Models of several series together: f(y: rows by series, t, h, **params) gives rows by series.


def _global_regression(y, t, h, regression_model="Ridge", model_params=None, window=14, **_):
    """One model for all series: windows of all of them, scaled by their own size, on the next step."""
    s = np.where(np.abs(y).mean(0) > 0, np.abs(y).mean(0), 1.0)
    z = y / s
    cal, new = k.calendar(t), k.calendar(_future(t, h))
    x, now = [], []
    for j in range(y.shape[1]):
        a, b = k.lagged(z[:, j], window)
        x.append(np.hstack((a - a[:, :1], cal[window:])))
        now.append(b - a[:, 0])
    m = regressor(regression_model, **(model_params or {})).fit(np.vstack(x), np.concatenate(now)[:, None])
    rows = z.copy()
    for i in range(h):
        a = rows[: -window - 1 : -1].T
        rows = np.vstack((rows, a[:, 0] + m.predict(np.hstack((a - a[:, :1], np.tile(new[i], (len(a), 1)))))[:, 0]))
    return rows[len(y) :] * s


def _pooled_motif(y, t, h, window=14, kk=10, **_):
    """What followed the nearest windows of any series, each window on its own scale."""
    n = len(y) - window - h + 1
    at = np.arange(n)[:, None]
    past = np.concatenate([y[at + np.arange(window), j] for j in range(y.shape[1])])
    after = np.concatenate([y[at + window + np.arange(h), j] for j in range(y.shape[1])])
    m, s = past.mean(1, keepdims=True), np.where(past.std(1, keepdims=True) > 0, past.std(1, keepdims=True), 1.0)
    past, after = (past - m) / s, (after - m) / s
    out = np.empty((h, y.shape[1]))
    for j in range(y.shape[1]):
        tail = y[-window:, j]
        mj, sj = tail.mean(), tail.std() or 1.0
        near = np.argsort(np.abs(past - (tail - mj) / sj).sum(1), kind="stable")[:kk]
        out[:, j] = after[near].mean(0) * sj + mj
    return out


MULTIVARIATE: dict[str, Callable] = {
    "VAR": lambda y, t, h, p=7, **_: k.var(y, h, p),
    "RRVAR": lambda y, t, h, p=7, rank=2, **_: k.var(y, h, p, rank=rank),
    "VECM": lambda y, t, h, rank=1, p=7, **_: k.vecm(y, h, rank, p),
    "VARMAX": lambda y, t, h, **_: k.var(y, h, 1),
    "DynamicFactor": lambda y, t, h, rank=1, **_: k.factorised(y, h, rank, 2),
    "DynamicFactorMQ": lambda y, t, h, rank=2, **_: k.factorised(y, h, rank, 7),
    "TMF": lambda y, t, h, rank=2, **_: k.factorised(y, h, rank, 14),
    "LATC": lambda y, t, h, **_: k.matrix_autoregression(y, h, 7, 10),
    "MAR": lambda y, t, h, season=7, **_: k.matrix_autoregression(y, h, season),
    "DMD": lambda y, t, h, rank=0.5, **_: k.dmd(y, h, rank),
    "NVAR": lambda y, t, h, kk=2, **_: k.nvar(y, h, kk),
    "TVVAR": lambda y, t, h, **_: _global_regression(y, t, h, "Ridge", {"lam": 5.0}, 28),
    "MultivariateRegression": _global_regression,
    "BallTreeMultivariateMotif": _pooled_motif,
    "MultivariateMotif": _pooled_motif,
}


def _days(ds: pd.Series) -> np.ndarray:
    return (pd.to_datetime(ds).to_numpy().astype("datetime64[D]")).astype(np.int64).astype(float)


def _rows(name, out, sd, interval, y) -> pd.DataFrame:
    h = len(out)
    z = NormalDist().inv_cdf(1 - (1 - interval) / 2)
    if sd is None:
        sd = (np.std(np.diff(y)) if len(y) > 1 else 0.0) * np.sqrt(np.arange(1, h + 1)) / 2
    sd = np.broadcast_to(np.asarray(sd, float), (h,))
    return pd.DataFrame({"series_id": name, "step": np.arange(1, h + 1, dtype=np.int32), "forecast": out, "lower": out - z * sd, "upper": out + z * sd, "exception": None})


def _failed(name, e: Exception) -> pd.DataFrame:
    return pd.DataFrame({"series_id": [name], "step": np.array([0], np.int32), "forecast": [None], "lower": [None], "upper": [None], "exception": [f"{type(e).__name__}: {e}"[:300]]})


def fit_predict(panel: DataFrame, horizon: int, model: str, interval: float = 0.9, batches: int = 1, **params) -> DataFrame:
    """series_id, step, forecast, lower, upper, exception of a model of `UNIVARIATE` or `MULTIVARIATE`.

    Gaps are closed by straight lines. Models of several series take those of a batch (a hash of
    the name modulo `batches`), so their memory is bounded by the number of batches asked for.
    """
    if model in UNIVARIATE:
        f = UNIVARIATE[model]

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("ds")
            name, y = rows["series_id"].iloc[0], k.filled(rows["y"].to_numpy(float))
            try:
                return _rows(name, *f(y, _days(rows["ds"]), horizon, **params), interval, y)
            except Exception as e:  # a model's failure is a result
                return _failed(name, e)

        return panel.select("series_id", "ds", "y").groupBy("series_id").applyInPandas(one, SCHEMA)
    f = MULTIVARIATE[model]

    def several(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="ds", columns="series_id", values="y", aggfunc="first", dropna=False).sort_index()
        y = np.column_stack([k.filled(wide[c].to_numpy(float)) for c in wide.columns])
        try:
            out = f(y, _days(pd.Series(wide.index)), horizon, **params)
            return pd.concat([_rows(c, out[:, i], None, interval, y[:, i]) for i, c in enumerate(wide.columns)])
        except Exception as e:
            return pd.concat([_failed(c, e) for c in wide.columns])

    keyed = panel.select("series_id", "ds", "y").withColumn("_batch", F.pmod(F.xxhash64("series_id"), F.lit(batches)))
    return keyed.groupBy("_batch").applyInPandas(several, SCHEMA)


_NATIVE: dict[str, Callable[..., DataFrame]] = {
    "ConstantNaive": native.constant, "ZeroesNaive": native.constant, "LastValueNaive": native.last_value, "AverageValueNaive": native.average_value, "SeasonalNaive": native.seasonal_naive,
    "Motif": native.motif, "UnivariateMotif": native.motif, "MetricMotif": native.motif, "SectionalMotif": native.sectional_motif,
}


def names() -> list[str]:
    """All models there are."""
    return sorted({*_NATIVE, *UNIVARIATE, *MULTIVARIATE, "PreprocessingExperts", "MLEnsemble"})


def predict(panel: DataFrame, horizon: int, model: str, **params) -> DataFrame:
    """series_id, step, forecast, lower, upper of any model by name, from its parameters."""
    if model in _NATIVE:
        return _NATIVE[model](panel, horizon, **params)
    if model == "PreprocessingExperts":
        return experts(panel, horizon, **params)
    if model == "MLEnsemble":
        return stacked(panel, horizon, **params)
    return fit_predict(panel, horizon, model, **params).where("exception IS NULL").drop("exception")


def model_forecast(panel: DataFrame, horizon: int, model: str, params: dict | None = None, transforms: dict | None = None, no_negatives: bool = False, constraint: dict | None = None, step: str = "1 day", cut=None) -> DataFrame:
    """One model behind a pipeline of transformations: fill and transform, fit, forecast, invert,
    then without negatives and within a constraint, if asked. series_id, step, ds and the bounds.

    The three values of a step are inverted as three panels, the point first. cut: what the tables
    between the steps go through, to be written instead of computed by each reader; who gives one
    gives a panel that has been through it.
    """
    from .risk import constrain
    from .transforms import Pipeline

    if cut is None:
        cut, panel = lineage.cut, lineage.cut(panel)
    pipe = Pipeline.of(transforms or {})
    pipe.cut = cut
    made = pipe.fit_apply(panel)
    raw = cut(predict(made, horizon, model, **(params or {})))
    last = panel.groupBy("series_id").agg(F.max("ds").alias("_last"))
    dated = raw.join(last, "series_id").withColumn("ds", F.expr(f"_last + step * INTERVAL {step}").cast(dict(panel.dtypes)["ds"]))
    out = dated.select("series_id", "ds", "step")
    for c in ("forecast", "lower", "upper"):
        back = pipe.invert(dated.select("series_id", "ds", F.col(c).alias("y"))).withColumnRenamed("y", c)
        out = out.join(back, ["series_id", "ds"])
    if no_negatives:
        out = out.withColumns({c: F.greatest(c, F.lit(0.0)) for c in ("forecast", "lower", "upper")})
    return constrain(out, panel, **constraint) if constraint else out


def experts(panel: DataFrame, horizon: int, model: str = "DatepartRegression", steps: tuple = ("clip_outliers", "seasonal_difference"), how: str = "median", **params) -> DataFrame:
    """The same model behind each beginning of a pipeline, put together by step."""
    out, panel = None, lineage.cut(panel)
    for n in range(len(steps) + 1):
        said = {"fillna": "ffill", "transformations": {str(i): s for i, s in enumerate(steps[:n])}}
        one = lineage.cut(model_forecast(panel, horizon, model, params, said, cut=lineage.cut).select("series_id", "step", "forecast", "lower", "upper"))
        out = one if out is None else out.unionByName(one)
    f = F.median if how == "median" else F.avg
    return out.groupBy("series_id", "step").agg(*[f(c).alias(c) for c in ("forecast", "lower", "upper")])


def stacked(panel: DataFrame, horizon: int, models: tuple = ("SeasonalNaive", "GLS", "FFT"), **_) -> DataFrame:
    """Forecasts of several models, weighted by least squares without negatives on the last
    `horizon` rows, which they did not see."""
    from ..sources.panel import holdout

    train, test = holdout(panel, horizon)

    def all_of(rows):
        out = None
        for m in models:
            one = predict(rows, horizon, m).select("series_id", "step", F.lit(m).alias("model"), "forecast")
            out = one if out is None else out.unionByName(one)
        return out.groupBy("series_id", "step").pivot("model", list(models)).agg(F.first("forecast"))

    past, new = all_of(train).join(test.select("series_id", "step", "y"), ["series_id", "step"]), all_of(panel).withColumn("y", F.lit(None).cast("double"))
    both = past.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        old, now = rows[~rows["new"]], rows[rows["new"]].sort_values("step")
        x, y = old[list(models)].to_numpy(float), old["y"].to_numpy(float)
        ok = np.isfinite(x).all(1) & np.isfinite(y)
        w = np.full(len(models), 1 / len(models))
        if ok.sum() > len(models):
            a = np.clip(np.linalg.lstsq(x[ok].T @ x[ok] + 1e-6 * np.trace(x[ok].T @ x[ok]) * np.eye(len(models)), x[ok].T @ y[ok], rcond=None)[0], 0, None)
            w = a / a.sum() if a.sum() > 0 else w
        out = now[list(models)].to_numpy(float) @ w
        return _rows(rows["series_id"].iloc[0], out, float(np.nanstd(y - x @ w)), 0.9, y).drop(columns="exception")

    return both.groupBy("series_id").applyInPandas(weigh, SCHEMA.rsplit(",", 1)[0])


def back_forecast(panel: DataFrame, model: str, chunks: int = 4, **params) -> DataFrame:
    """series_id, ds, forecast, lower, upper over the history in `chunks` parts of equal rows, each
    from the rows before it; the first one has none before it and is forecast backwards from what
    follows. One grouped pass a part, each over its own slice."""
    held = panel.withColumns({"_i": F.row_number().over(native.S().orderBy("ds")), "_n": F.count("*").over(native.S())})
    held = held.withColumn("_c", F.least(F.floor((F.col("_i") - 1) * chunks / F.col("_n")), F.lit(chunks - 1)).cast("int"))
    f = UNIVARIATE[model]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        y, t, c = k.filled(rows["y"].to_numpy(float)), _days(rows["ds"]), rows["_c"].to_numpy()
        out = np.full((3, len(y)), np.nan)
        for j in range(chunks):
            now = np.flatnonzero(c == j)
            if not len(now):
                continue
            try:
                old = slice(now[-1] + 1, None) if j == 0 else slice(0, now[0])
                yy, tt = (y[old][::-1], t[old]) if j == 0 else (y[old], t[old])
                r = _rows("", *f(yy, tt, len(now), **params), 0.9, yy)
                part = r[["forecast", "lower", "upper"]].to_numpy(float).T
                out[:, now] = part[:, ::-1] if j == 0 else part
            except Exception:
                continue
        return pd.DataFrame({"series_id": rows["series_id"], "ds": rows["ds"], **{n: k.filled(v) for n, v in zip(("forecast", "lower", "upper"), out)}})

    return held.drop("_i", "_n").groupBy("series_id").applyInPandas(run, f"series_id string, ds {dict(panel.dtypes)['ds']}, forecast double, lower double, upper double")
