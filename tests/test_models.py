"""Every model, filter and fitted transformer on series whose course is known."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import kernels, models, transform_models, transforms
from tidewright.operators.impute_models import CURVES, curve
from tidewright.operators.regressors import BACKENDS, regressor

N, H = 300, 14
T = np.arange(N + H)
NOISE = np.random.default_rng(7).normal(size=(N + H, 3)) * 0.3
WAVES = np.column_stack([50 + 0.02 * T + 5 * np.sin(2 * np.pi * T / 7), 30 + 4 * np.cos(2 * np.pi * T / 7), 80 - 0.01 * T + 6 * np.sin(2 * np.pi * T / 7 + 1)]) + NOISE


@pytest.fixture(scope="module")
def panel(spark):
    rows = pd.DataFrame({"series_id": np.repeat(["a", "b", "c"], N), "ds": np.tile(pd.date_range("2020-01-01", periods=N).date, 3), "y": WAVES[:N].T.ravel()})
    return spark.createDataFrame(rows, "series_id string, ds date, y double").cache()


# Levels of trend or spread alone know no season, nor do the lowest harmonics.
PLAIN = {"GLS", "GLM", "ARCH", "VARMAX", "DynamicFactor", "MotifSimulation", "FFT"}


@pytest.mark.parametrize("name", sorted({*models.UNIVARIATE, *models.MULTIVARIATE}))
def test_model(name):
    t = T[:N] + 18262.0
    if name in models.UNIVARIATE:
        made = [models.UNIVARIATE[name](WAVES[:N, j], t, H) for j in range(3)]
        got = np.column_stack([m[0] for m in made])
        assert all(m[1] is None or np.all(np.asarray(m[1]) >= 0) for m in made)
    else:
        got = models.MULTIVARIATE[name](WAVES[:N], t, H)
    flat = np.abs(WAVES[N:] - WAVES[:N].mean(0)).mean()
    assert got.shape == (H, 3) and np.abs(got - WAVES[N:]).mean() < (1.3 if name in PLAIN else 0.65) * flat


@pytest.mark.parametrize("name", ["BasicLinearModel", "VAR"])
def test_model_in_spark(panel, name):
    out = models.fit_predict(panel, H, name).toPandas()
    assert out["exception"].isna().all() and len(out) == 3 * H and (out["lower"] <= out["upper"]).all()
    got = out.pivot(index="step", columns="series_id", values="forecast").to_numpy()
    assert np.abs(got - WAVES[N:]).mean() < 1.0


def test_failures_are_rows(spark, panel):
    short = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], "series_id string, i int, y double").select("series_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("ds"), "y")
    out = models.fit_predict(panel.unionByName(short), H, "WindowRegression").toPandas()
    assert out[out["series_id"] == "x"]["exception"].iloc[0].startswith("ValueError") and len(out) == 3 * H + 1


@pytest.mark.parametrize("name", sorted(BACKENDS))
def test_regressor_learns(name):
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (300, 4))
    y = np.column_stack((2 * x[:, 0] - x[:, 1], x[:, 2])) + 0.05 * r.normal(size=(300, 2))
    m = regressor(name).fit(x[:200], y[:200])
    assert ((m.predict(x[200:]) - y[200:]) ** 2).mean() < 0.5 * y[200:].var()


@pytest.mark.parametrize("name", sorted(CURVES))
def test_curves_keep_known_values(name):
    y = np.sin(np.arange(60) / 5)
    holes = y.copy()
    holes[[3, 10, 11, 12, 30, 45]] = np.nan
    out = curve(holes, name)
    assert np.allclose(out[~np.isnan(holes)], y[~np.isnan(holes)]) and np.abs(out - y).max() < 0.05


@pytest.mark.parametrize("name", ["hp_filter", "seasonal_decompose"])
def test_filters_are_smoother(panel, name):
    out = transforms.transform(panel, name).orderBy("series_id", "ds").toPandas()
    y = out[out["series_id"] == "a"]["y"].to_numpy(float)
    assert np.abs(np.diff(y, 2)).mean() < np.abs(np.diff(WAVES[:N, 0], 2)).mean()


@pytest.mark.parametrize("f", [kernels.savgol, kernels.wiener, kernels.cf_filter, lambda y: kernels.fft_filter(y), lambda y: kernels.fir(y, kernels.fir_taps(64, 0.1)), lambda y: kernels.both_ways(y, *kernels.butter(3, 0.2)), lambda y: kernels.stl(y)[0], lambda y: kernels.kalman(y, *kernels.local_trend(), 1.0)[0]])
def test_filters(f):
    y = WAVES[:N, 0]
    assert f(y).shape == y.shape and np.abs(np.diff(f(y), 2)).mean() < np.abs(np.diff(y, 2)).mean()


def test_fitted_curves_go_on(panel):
    """What is taken off the history is added to a forecast of nothing."""
    ahead = panel.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(1), F.lit(H))).alias("k")).select("series_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k") + N - 1).alias("ds"), F.lit(0.0).alias("y"))
    for name in ("sine_trend", "datepart_regression"):
        t = transforms.transformer(name)
        out = t.invert(ahead, t.fit(panel), "forecast").orderBy("series_id", "ds").toPandas()["y"].to_numpy().reshape(3, H).T
        assert np.abs(out - WAVES[N:]).mean() < 2.5, name


def test_back_forecast_covers_history(panel):
    out = models.back_forecast(panel, "BasicLinearModel").toPandas()
    assert len(out) == 3 * N and out["forecast"].notna().all()


def test_kernels():
    r = np.random.default_rng(3)
    step = np.concatenate((np.zeros(50), np.full(60, 5.0), np.zeros(40))) + 0.1 * r.normal(size=150)
    assert kernels.pelt(step, 10) == [50, 110]
    d = np.diff(np.eye(200), 2, axis=0)
    assert np.allclose(kernels.hp_filter(WAVES[:200, 0], 50.0), np.linalg.solve(np.eye(200) + 50 * d.T @ d, WAVES[:200, 0]))
    assert kernels.online_changes(step)[50:54].max() > 0.5
    x = r.normal(size=(500, 4))
    assert np.allclose(kernels.ledoit_wolf(x), np.eye(4), atol=0.15)
    s = np.array([[1, 1], [1, 0], [0, 1]], float)
    y = kernels.reconcile(s, np.array([[10.0, 4.0, 5.0]]), np.eye(3))[0]
    assert y[0] == pytest.approx(y[1] + y[2]) and np.allclose(y, [29 / 3, 13 / 3, 16 / 3])


def test_all_are_registered():
    assert {*transform_models.TRANSFORMERS}.isdisjoint(transforms.TRANSFORMERS) and len(models.names()) >= 45
