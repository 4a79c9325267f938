"""Registered queries of forecast models, filters and fitted transformers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalog import _SEASON, _W, FILLED, HORIZON, SPLIT, _filled, _r, _register, _split
from tidewright.operators import forecast, models, transforms
from tidewright.operators.impute import CURVES, MODELS, impute
from tidewright.sources import panel as source

_train = lambda s, d: _split(s, d)[0]
_STEP = "CAST(step AS INTEGER) AS step"

# Native forecasters with SQL
_POINT = f"{SPLIT}, {_SEASON}, q AS (SELECT series_id, step, lastvalue AS fc FROM p JOIN steps ON (step - 1) % 7 = b)"
_q = lambda s, d: forecast.seasonal_naive(_train(s, d), HORIZON).select("series_id", "step", "forecast")
_register("interval_historic_quantile", lambda s, d: forecast.with_bounds(_train(s, d), _q(s, d)), f"WITH {_POINT} SELECT series_id, {_STEP}, {_r('fc', 'forecast')}, {_r('fc - lo', 'lower')}, {_r('fc + up', 'upper')} FROM q JOIN wd USING (series_id)")
_register(
    "interval_inferred_normal",
    lambda s, d: forecast.with_bounds(_train(s, d), _q(s, d), method="inferred_normal"),
    f"WITH {_POINT}, m AS (SELECT series_id, AVG(y) AS m, STDDEV_SAMP(y) AS s FROM train GROUP BY 1) SELECT series_id, {_STEP}, {_r('fc', 'forecast')}, {_r('LEAST(fc, (m + 5 * fc) / 6 - 1.6448536269514722 * s)', 'lower')}, {_r('GREATEST(fc, (m + 5 * fc) / 6 + 1.6448536269514722 * s)', 'upper')} FROM q JOIN m USING (series_id)",
)
_register(
    "interval_pct_change",
    lambda s, d: forecast.with_bounds(_train(s, d), _q(s, d), method="variable_pct_change"),
    f"""WITH {_POINT}, c AS (SELECT series_id, quantile_cont(c, 0.05) AS l, quantile_cont(c, 0.95) AS u FROM (SELECT series_id, y / NULLIF(LAG(y) OVER ({_W}), 0) - 1 AS c FROM train) GROUP BY 1)
SELECT series_id, {_STEP}, {_r('fc', 'forecast')}, {_r('LEAST(fc, fc + ABS(fc) * l * SQRT(step), fc + ABS(fc) * u * SQRT(step))', 'lower')}, {_r('GREATEST(fc, fc + ABS(fc) * l * SQRT(step), fc + ABS(fc) * u * SQRT(step))', 'upper')} FROM q JOIN c USING (series_id)""",
)
_FD = "fd AS (SELECT series_id, MIN(ds) AS f FROM train GROUP BY 1)"
_SPLIT_DS = SPLIT
for _how, _sql in (
    ("midhinge", "(quantile_cont(y, 0.25) + quantile_cont(y, 0.75)) / 2"),
    ("weighted_mean", "SUM((ds - f)::DOUBLE * y) / SUM((ds - f)::DOUBLE)"),
    ("exp_weighted_mean", "SUM(POW(ds - f, 2) * y) / SUM(POW(ds - f, 2))"),
):
    _register(f"forecast_average_{_how}", lambda s, d, h=_how: forecast.average_value(_train(s, d), HORIZON, h), f"WITH {_SPLIT_DS}, {_FD} SELECT series_id, {_STEP}, {_r('fc', 'forecast')}, {_r('fc - lo', 'lower')}, {_r('fc + up', 'upper')} FROM (SELECT series_id, {_sql} AS fc FROM train JOIN fd USING (series_id) GROUP BY 1) JOIN wd USING (series_id), steps")
_register(
    "forecast_average_window",
    lambda s, d: forecast.average_value(_train(s, d), HORIZON, window=30),
    f"WITH {SPLIT}, w30 AS (SELECT series_id, AVG(y) AS fc, quantile_cont(y, 0.9) - quantile_cont(y, 0.5) AS up, quantile_cont(y, 0.5) - quantile_cont(y, 0.1) AS lo FROM train WHERE rn <= 30 GROUP BY 1) SELECT series_id, {_STEP}, {_r('fc', 'forecast')}, {_r('fc - lo', 'lower')}, {_r('fc + up', 'upper')} FROM w30, steps",
)
_SEASON28 = _SEASON.replace("b AS (", "b2 AS (").replace("FROM b ", "FROM b2 ").replace("p AS (SELECT", "p2 AS (SELECT").replace("6 - (rn - 1) % 7", "27 - (rn - 1) % 28")
_register(
    "forecast_seasonal_of_two",
    lambda s, d: forecast.seasonal_naive_of_two(_train(s, d), HORIZON).select("series_id", "step", "forecast"),
    f"WITH {SPLIT}, {_SEASON}, {_SEASON28} SELECT p.series_id, {_STEP}, {_r('(p.lastvalue + p2.lastvalue) / 2', 'forecast')} FROM steps JOIN p ON (step - 1) % 7 = p.b JOIN p2 ON (step - 1) % 28 = p2.b AND p.series_id = p2.series_id",
)
_A, _B = "v[i + j]", "v[len(v) - 13 + j]"
_SUM = lambda x: f"list_sum(list_transform(range(14), lambda j: {x}))"
_DIST = {
    "mse": _SUM(f"POW({_A} - {_B}, 2)"), "euclidean": f"SQRT({_SUM(f'POW({_A} - {_B}, 2)')})", "chebyshev": f"list_max(list_transform(range(14), lambda j: ABS({_A} - {_B})))",
    "canberra": _SUM(f"COALESCE(ABS({_A} - {_B}) / NULLIF(ABS({_A}) + ABS({_B}), 0), 0)"), "braycurtis": f"{_SUM(f'ABS({_A} - {_B})')} / NULLIF({_SUM(f'ABS({_A} + {_B})')}, 0)",
    "cosine": f"1 - {_SUM(f'{_A} * {_B}')} / NULLIF(SQRT({_SUM(f'{_A} * {_A}')}) * SQRT({_SUM(f'{_B} * {_B}')}), 0)",
}
_MOTIF = lambda dist: f"""{SPLIT}, a AS (SELECT series_id, LIST(y ORDER BY ds) AS v FROM train GROUP BY 1), w AS (SELECT series_id, v, i, ROUND({dist}, 6) AS d
FROM (SELECT series_id, v, UNNEST(range(1, len(v) - 14 - {HORIZON} + 2)) AS i FROM a)), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY d, i) AS r FROM w),
pt AS (SELECT series_id, step, d, v[i + 13 + step] AS y FROM r, steps WHERE r <= 5)"""  # noqa: E731
_OUT = lambda f: f"SELECT series_id, {_STEP}, {_r(f, 'forecast')}, {_r('quantile_cont(y, 0.05)', 'lower')}, {_r('quantile_cont(y, 0.95)', 'upper')} FROM pt GROUP BY 1, 2"
for _d, _sql in _DIST.items():
    _register(f"forecast_motif_{_d}", lambda s, d, x=_d: forecast.motif(_train(s, d), HORIZON, distance=x), f"WITH {_MOTIF(_sql)} {_OUT('AVG(y)')}")
_MAE = _SUM(f"ABS({_A} - {_B})")
for _p, _f in (("median", "MEDIAN(y)"), ("midhinge", "(quantile_cont(y, 0.25) + quantile_cont(y, 0.75)) / 2"), ("weighted_mean", "COALESCE(SUM(y * d) / NULLIF(SUM(d), 0), AVG(y))"), ("inverse_distance", "SUM(y / (d + 1e-9)) / SUM(1 / (d + 1e-9))")):
    _register(f"forecast_motif_point_{_p}", lambda s, d, x=_p: forecast.motif(_train(s, d), HORIZON, point=x), f"WITH {_MOTIF(_MAE)} {_OUT(_f)}")
_register(
    "forecast_sectional_motif",
    lambda s, d: forecast.sectional_motif(_train(s, d), HORIZON),
    f"""WITH {SPLIT}, a AS (SELECT series_id, LIST(y ORDER BY ds) AS v FROM train GROUP BY 1), w AS (SELECT series_id, len(v) - i AS back, {_MAE} AS d FROM (SELECT series_id, v, UNNEST(range(1, len(v) - 14 - {HORIZON} + 2)) AS i FROM a)),
bk AS (SELECT back FROM w GROUP BY back ORDER BY ROUND(SUM(d), 4), back DESC LIMIT 5), pt AS (SELECT series_id, step, v[len(v) - back + 13 + step] AS y FROM a, bk, steps) {_OUT('AVG(y)')}""",
)
_register("join_nearest_value_in_window", lambda s, d: __import__("tidewright.operators.joins", fromlist=["x"]).nearest_value(forecast.seasonal_naive(_train(s, d), HORIZON, how="mean"), _train(s, d), 60),
    f"WITH {SPLIT}, {_SEASON}, q AS (SELECT series_id, CAST(step AS INTEGER) AS step, mean AS fc FROM p JOIN steps ON (step - 1) % 7 = b) SELECT q.series_id, step, {_r('ARG_MIN(train.y, ABS(train.y - fc))', 'forecast')} FROM q JOIN train ON q.series_id = train.series_id AND train.rn <= 60 GROUP BY 1, 2")

# Models in numpy; tests hold them against known series
for _name in sorted({*models.UNIVARIATE, *models.MULTIVARIATE}):
    _sql = None
    if _name == "GLS":
        _x = "(ds - DATE '1970-01-01')::DOUBLE"
        _sql = f"WITH {SPLIT}, g AS (SELECT series_id, REGR_SLOPE(y, {_x}) AS b, REGR_INTERCEPT(y, {_x}) AS a, MAX({_x}) AS e FROM train GROUP BY 1) SELECT series_id, {_STEP}, {_r('a + b * (e + step)', 'forecast', 2)} FROM g, steps"
    _cols = ("series_id", "step", "forecast") if _name == "GLS" else ("series_id", "step", "forecast", "lower", "upper")
    _register(f"model_{_name}", lambda s, d, n=_name, c=_cols: models.predict(_train(s, d), HORIZON, n).select(*c), _sql, 2)
_register("model_PreprocessingExperts", lambda s, d: models.predict(_train(s, d), HORIZON, "PreprocessingExperts"))
_register("model_MLEnsemble", lambda s, d: models.predict(_train(s, d), HORIZON, "MLEnsemble"))
_register(
    "model_pipeline",
    lambda s, d: models.model_forecast(_train(s, d), HORIZON, "LastValueNaive", transforms={"fillna": "ffill", "transformations": {"0": "seasonal_difference"}}, no_negatives=True).select("series_id", "step", "forecast"),
    f"WITH {SPLIT}, {_SEASON} SELECT series_id, {_STEP}, {_r('GREATEST(lastvalue, 0)', 'forecast')} FROM p JOIN steps ON (step - 1) % 7 = b",
)
_register("model_back_forecast", lambda s, d: models.back_forecast(_train(s, d), "BasicLinearModel"))
for _back in ("LinearRegression", "ElasticNet", "KNN", "RandomForest", "ExtraTrees", "Boosting", "MLP"):
    _register(f"regression_{_back}", lambda s, d, b=_back: models.fit_predict(_train(s, d), HORIZON, "DatepartRegression", regression_model=b).drop("exception"))

# Filters and fitted transformers
from tidewright.operators import transform_models as _tm  # noqa: E402

for _name in sorted(_tm.TRANSFORMERS):
    _register(f"filter_{_name}", lambda s, d, n=_name: transforms.transform(_filled(s, d), n))


def _and_back(s, d, name, **params):
    panel, t = _filled(s, d), transforms.transformer(name, **params)
    found = t.fit(panel)
    return t.invert(t.apply(panel, found), found, "original")


for _name in ("sine_trend", "changepoint_detrend", "datepart_regression", "fft_decomposition", "power", "quantile", "pca", "fast_ica", "btcd", "theta", "center_split", "mean_ratio"):
    _register(f"round_trip_{_name}", lambda s, d, n=_name: _and_back(s, d, n), f"WITH {FILLED} SELECT series_id, ds, {_r('y', 'y', 2)} FROM f", 2)
_register(
    "filter_rescale_blocks",
    lambda s, d: transforms.transform(_filled(s, d), "rescale", factor=5, mode="downscale"),
    f"WITH {FILLED} SELECT series_id, MAX(ds) AS ds, {_r('AVG(y)', 'y')} FROM (SELECT *, (ROW_NUMBER() OVER ({_W} DESC) - 1) // 5 AS b FROM f) GROUP BY series_id, b",
)
for _m in (*CURVES, *MODELS):
    _register(f"impute_{_m}", lambda s, d, m=_m: impute(source.orders_daily(s, d), m))
_register("impute_of_known_is_known", lambda s, d: source.orders_daily(s, d).join(impute(source.orders_daily(s, d), "cubic").withColumnRenamed("y", "f"), ["series_id", "ds"]).where("y IS NOT NULL").select("series_id", "ds", F.col("f").alias("y")), f"WITH {FILLED} SELECT series_id, ds, {_r('y', 'y')} FROM panel WHERE y IS NOT NULL")
