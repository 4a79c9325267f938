"""Filling of gaps by curves through a series' known values, and by models of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .models import _days, _design
from .regressors import regressor


def _hermite(x, y, slope, new):
    at = np.clip(np.searchsorted(x, new, side="right") - 1, 0, len(x) - 2)
    h = x[at + 1] - x[at]
    s = (new - x[at]) / h
    return (1 + 2 * s) * (1 - s) ** 2 * y[at] + s * (1 - s) ** 2 * h * slope[at] + s * s * (3 - 2 * s) * y[at + 1] + s * s * (s - 1) * h * slope[at + 1]


def _pchip(x, y, new):
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(d[:-1] * d[1:] > 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
    return _hermite(x, y, np.concatenate(([d[0]], inner, [d[-1]])), new)


def _akima(x, y, new):
    d = np.diff(y) / np.diff(x)
    m = np.concatenate(([3 * d[0] - 2 * d[1], 2 * d[0] - d[1]], d, [2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]])) if len(d) > 1 else np.repeat(d, 5)
    a, b = np.abs(m[3:] - m[2:-1]), np.abs(m[1:-2] - m[:-3])
    slope = np.where(a + b > 1e-12, (a * m[1:-2] + b * m[2:-1]) / np.where(a + b > 1e-12, a + b, 1), (m[1:-2] + m[2:-1]) / 2)
    return _hermite(x, y, slope[: len(x)], new)


def _cubic(x, y, new):
    """The natural cubic spline."""
    n, h = len(x), np.diff(x)
    c = np.zeros(n)
    diag, rhs = np.ones(n), np.zeros(n)
    diag[1:-1] = 2 * (h[:-1] + h[1:])
    rhs[1:-1] = 3 * (np.diff(y)[1:] / h[1:] - np.diff(y)[:-1] / h[:-1])
    up = np.concatenate(([0.0], h[1:]))
    for i in range(1, n - 1):  # elimination in three bands
        f = (h[i - 1] if i > 1 else 0.0) / diag[i - 1]
        diag[i] -= f * up[i - 1]
        rhs[i] -= f * rhs[i - 1]
    for i in range(n - 2, 0, -1):
        c[i] = (rhs[i] - up[i] * c[i + 1]) / diag[i]
    b = np.diff(y) / h - h * (2 * c[:-1] + c[1:]) / 3
    d = np.diff(c) / (3 * h)
    at = np.clip(np.searchsorted(x, new, side="right") - 1, 0, n - 2)
    s = new - x[at]
    return y[at] + s * (b[at] + s * (c[at] + s * d[at]))


def _local(x, y, new, degree):
    """A polynomial through the nearest known values."""
    out = np.empty(len(new))
    for i, v in enumerate(new):
        a = min(max(np.searchsorted(x, v) - (degree + 1) // 2, 0), max(len(x) - degree - 1, 0))
        at = slice(a, a + degree + 1)
        out[i] = np.polyval(np.polyfit(x[at] - v, y[at], min(degree, len(x[at]) - 1)), 0.0)
    return out


CURVES = {"pchip": _pchip, "akima": _akima, "cubic": _cubic, "spline": _cubic, "quadratic": lambda x, y, new: _local(x, y, new, 2), "polynomial": lambda x, y, new: _local(x, y, new, 3)}


def curve(y: np.ndarray, name: str) -> np.ndarray:
    """Inside the known values the curve, beyond them the nearest one."""
    ok = ~np.isnan(y)
    out = k.filled(y)
    if ok.sum() < 4:
        return out
    x = np.flatnonzero(ok).astype(float)
    gaps = np.flatnonzero(~ok & (np.arange(len(y)) > x[0]) & (np.arange(len(y)) < x[-1]))
    out[gaps] = CURVES[name](x, y[ok], gaps.astype(float))
    return out


def _modelled(y: np.ndarray, t: np.ndarray, name: str) -> np.ndarray:
    ok = ~np.isnan(y)
    out = k.filled(y)
    if ok.sum() < 10 or ok.all():
        return out
    if name == "seasonal_linear":
        x = _design(t, t, 180)
        out[~ok] = x[~ok] @ k.ridge(x[ok], y[ok], 0.01)
    elif name == "datepart_regression":
        x = np.column_stack((k.calendar(t), t))
        out[~ok] = regressor("RandomForest", trees=10).fit(x[ok], y[ok][:, None]).predict(x[~ok])[:, 0]
    else:  # seasonality_motif: the three known dates nearest in the calendar
        cal = k.calendar(t)
        d = np.abs(cal[~ok][:, None] - cal[ok][None]).sum(-1)
        out[~ok] = y[ok][np.argsort(d, axis=1, kind="stable")[:, :3]].mean(1)
    return out


def _together(y: np.ndarray, name: str, rounds: int = 5) -> np.ndarray:
    """knn: gaps from the five dates nearest in the other series; iterative: each series regressed
    on the others in turn until the rounds are over."""
    ok = ~np.isnan(y)
    out = np.column_stack([k.filled(c) for c in y.T])
    if y.shape[1] < 2:
        return out
    s = np.where(out.std(0) > 0, out.std(0), 1.0)
    if name == "knn":
        z = (out - out.mean(0)) / s
        for j in range(y.shape[1]):
            gaps, known = np.flatnonzero(~ok[:, j]), np.flatnonzero(ok[:, j])
            other = np.delete(z, j, axis=1)
            for at in range(0, len(gaps), 256):  # a block of rows at a time
                g = gaps[at : at + 256]
                d = ((other[g][:, None] - other[known][None]) ** 2).sum(-1) if len(known) else None
                if d is not None:
                    out[g, j] = y[known, j][np.argsort(d, axis=1, kind="stable")[:, :5]].mean(1)
        return out
    for _ in range(rounds):
        for j in range(y.shape[1]):
            if ok[:, j].sum() > y.shape[1] + 2 and not ok[:, j].all():
                other = np.delete(out, j, axis=1)
                m = regressor("BayesianRidge").fit(other[ok[:, j]], y[ok[:, j], j][:, None])
                out[~ok[:, j], j] = m.predict(other[~ok[:, j]])[:, 0]
    return out


def fill(panel: DataFrame, method: str, batches: int = 1) -> DataFrame:
    """The panel with gaps filled by a curve or model of each series; knn and iterative take the
    series of a batch (a hash of the name) together."""
    slim = panel.select("series_id", "ds", "y")
    if method in ("knn", "iterative"):

        def several(rows: pd.DataFrame) -> pd.DataFrame:
            wide = rows.pivot_table(index="ds", columns="series_id", values="y", aggfunc="first", dropna=False).sort_index()
            wide[:] = _together(wide.to_numpy(float), method)
            return wide.reset_index().melt("ds", var_name="series_id", value_name="y")[["series_id", "ds", "y"]]

        return slim.withColumn("_batch", F.pmod(F.xxhash64("series_id"), F.lit(batches))).groupBy("_batch").applyInPandas(several, f"series_id string, ds {dict(panel.dtypes)['ds']}, y double")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        y = rows["y"].to_numpy(float)
        return rows.assign(y=curve(y, method) if method in CURVES else _modelled(y, _days(rows["ds"]), method))

    return slim.groupBy("series_id").applyInPandas(one, f"series_id string, ds {dict(panel.dtypes)['ds']}, y double")
