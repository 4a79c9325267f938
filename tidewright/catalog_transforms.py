"""Registered queries of transformers, both ways, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalog import _P, _W, FILLED, HORIZON, SPLIT, _filled, _r, _register, _split
from tidewright.operators import transforms

_DAYS = "(ds - DATE '1970-01-01')::DOUBLE"
_MIN, _SD = f"MIN(y) {_P}", f"STDDEV_SAMP(y) {_P}"
_Q = lambda p: f"quantile_cont(y, {p}) {_P}"
_Z = f"COALESCE(NULLIF(y, 0), MIN(NULLIF(ABS(y), 0)) {_P}, 0.1)"
_ZL = "COALESCE(NULLIF(y, 0), least)"
_UP = f"(y + GREATEST(1 - {_MIN}, 0))"
_G = f"(y - {_Q(0.5)}) / NULLIF(3 * d, 0)"
_PLAIN = {
    "none": "y",
    "standard": f"(y - AVG(y) {_P}) / STDDEV_POP(y) {_P}",
    "min_max": f"(y - {_MIN}) / (MAX(y) {_P} - {_MIN})",
    "max_abs": f"y / MAX(ABS(y)) {_P}",
    "robust": f"(y - {_Q(0.5)}) / ({_Q(0.75)} - {_Q(0.25)})",
    "positive_shift": _UP,
    "log": f"LN({_UP})",
    "clip_outliers": f"GREATEST(LEAST(y, AVG(y) {_P} + 4 * {_SD}), AVG(y) {_P} - 4 * {_SD})",
    "difference": f"COALESCE(y - LAG(y) OVER ({_W}), LEAD(y) OVER ({_W}) - y)",
    "cumsum": f"SUM(y) OVER ({_W} ROWS UNBOUNDED PRECEDING)",
    "rolling_mean": f"AVG(y) OVER ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    "center_last": f"y / COALESCE(NULLIF(FIRST_VALUE(y) OVER ({_W} DESC), 0), 1)",
    "shift_first": f"y - FIRST_VALUE(y) OVER ({_W})",
    "detrend": f"y - (REGR_SLOPE(y, {_DAYS}) {_P} * {_DAYS} + REGR_INTERCEPT(y, {_DAYS}) {_P})",
    "detrend_through_origin": f"y - SUM(y * {_DAYS}) {_P} / SUM({_DAYS} * {_DAYS}) {_P} * {_DAYS}",
    "intermittent": f"SIGN(y - {_Q(0.5)})",
    "align_last": "y",
    "align_last_diff": "y",
}
for _name, _sql in _PLAIN.items():
    _register(f"transform_{_name}", lambda s, d, n=_name: transforms.transform(_filled(s, d), n), f"WITH {FILLED} SELECT series_id, ds, {_r(_sql, 'y')} FROM f")
_register("transform_round", lambda s, d: transforms.transform(_filled(s, d), "round", decimals=-3, on_transform=True), f"WITH {FILLED} SELECT series_id, ds, {_r('round_even(y / 1000, 0) * 1000', 'y')} FROM f")
_register("transform_pct_change", lambda s, d: transforms.transform(_filled(s, d), "pct_change"), f"WITH {FILLED}, z AS (SELECT series_id, ds, {_Z} AS z FROM f) SELECT series_id, ds, {_r(f'COALESCE(z / LAG(z) OVER ({_W}) - 1, 0)', 'y')} FROM z")
_register(
    "transform_remove_outliers",
    lambda s, d: transforms.transform(_filled(s, d), "remove_outliers", k=2.0),
    f"WITH {FILLED} SELECT series_id, ds, {_r(f'CASE WHEN y BETWEEN AVG(y) {_P} - 2 * {_SD} AND AVG(y) {_P} + 2 * {_SD} THEN y END', 'y')} FROM f",
)
_register(
    "transform_rolling_mean_centred",
    lambda s, d: transforms.transform(_filled(s, d), "rolling_mean", window=9, center=True),
    f"WITH {FILLED} SELECT series_id, ds, {_r(f'AVG(y) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)', 'y')} FROM f",
)
_register(
    "transform_rolling_mean_geometric",
    lambda s, d: transforms.transform(_filled(s, d), "rolling_mean", geometric=True),
    f"WITH {FILLED} SELECT series_id, ds, {_r(f'EXP(AVG(CASE WHEN y > 0 THEN LN(y) END) OVER ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))', 'y')} FROM f",
)
_EDGES = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
for _how, _v in (("center", "(e[a] + e[a + 1]) / 2"), ("lower", "e[a]"), ("upper", "e[a + 1]")):
    _register(
        f"transform_discretize_{_how}",
        lambda s, d, h=_how: transforms.transform(_filled(s, d), "discretize", how=h),
        f"WITH {FILLED}, e AS (SELECT series_id, quantile_cont(y, {_EDGES}) AS e FROM f GROUP BY 1), b AS (SELECT series_id, ds, e, GREATEST(LEAST(len(list_filter(e, lambda x: x <= y)), 10), 1) AS a FROM f JOIN e USING (series_id)) SELECT series_id, ds, {_r(_v, 'y')} FROM b",
    )
_MAD = f"m AS (SELECT series_id, MEDIAN(y) AS m FROM f GROUP BY 1), s AS (SELECT series_id, m, 3 * MEDIAN(ABS(y - m)) AS s FROM f JOIN m USING (series_id) GROUP BY 1, 2), x AS (SELECT series_id, ds, (y - m) / s AS x FROM f JOIN s USING (series_id))"
_register("transform_mu_law", lambda s, d: transforms.transform(_filled(s, d), "mu_law"), f"WITH {FILLED}, {_MAD} SELECT series_id, ds, {_r('SIGN(x) * LN(1 + 255 * ABS(x)) / LN(256)', 'y')} FROM x")
_register("transform_a_law", lambda s, d: transforms.transform(_filled(s, d), "a_law"), f"WITH {FILLED}, {_MAD} SELECT series_id, ds, {_r('SIGN(x) * CASE WHEN ABS(x) < 1 / 87.6 THEN 87.6 * ABS(x) ELSE 1 + LN(87.6 * ABS(x)) END / (1 + LN(87.6))', 'y')} FROM x")
for _lag in (7, 12, 28):
    for _how, _f in (("last", "ARG_MIN(y, rn)"), ("mean", "AVG(y)"), ("median", "MEDIAN(y)")):
        _register(
            f"transform_seasonal_difference_{_lag}_{_how}",
            lambda s, d, lag=_lag, h=_how: transforms.transform(_filled(s, d), "seasonal_difference", lag=lag, how=h),
            f"WITH {FILLED}, b AS (SELECT *, ROW_NUMBER() OVER ({_W} DESC) AS rn, (ROW_NUMBER() OVER ({_W} DESC) - 1) % {_lag} AS b FROM f), p AS (SELECT series_id, b, {_f} AS p FROM b GROUP BY 1, 2) SELECT series_id, ds, {_r('y - p', 'y')} FROM b JOIN p USING (series_id, b)",
        )
_register(
    "transform_mean_difference",
    lambda s, d: transforms.transform(_filled(s, d), "mean_difference"),
    f"WITH {FILLED}, a AS (SELECT ds, COALESCE(LAG(AVG(y)) OVER (ORDER BY ds), 0) AS p FROM f GROUP BY ds) SELECT series_id, f.ds, {_r('y - p', 'y')} FROM f JOIN a ON f.ds = a.ds",
)
_register(
    "transform_replace_constant",
    lambda s, d: transforms.transform(_filled(s, d).withColumn("y", F.when(F.dayofmonth("ds") == 7, 0.0).otherwise(F.col("y"))), "replace_constant", fill="ffill"),
    f"WITH {FILLED}, z AS (SELECT series_id, ds, CASE WHEN day(ds) = 7 THEN NULL ELSE NULLIF(y, 0) END AS y FROM f) SELECT series_id, ds, {_r(f'COALESCE(LAST_VALUE(y IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FIRST_VALUE(y IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)', 'y')} FROM z",
)
_SHIFT = f"""g AS (SELECT *, AVG(y) OVER ({_W} ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) - AVG(y) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 89 FOLLOWING) AS d, ROW_NUMBER() OVER ({_W}) AS i FROM f),
c AS (SELECT * FROM (SELECT *, STDDEV_SAMP(d) {_P} AS sd FROM g) WHERE ABS(d) > 2.5 * sd), n AS (SELECT *, CASE WHEN i - LAG(i) OVER ({_W}) <= 3 THEN 0 ELSE 1 END AS nw FROM c), gr AS (SELECT *, SUM(nw) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS gp FROM n),
t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, gp ORDER BY ABS(d) DESC, i) AS r FROM gr) WHERE r = 1), k AS (SELECT series_id, ds, d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ABS(d) DESC, ds) AS r2 FROM t) WHERE r2 <= 20)"""
_register(
    "transform_level_shift",
    lambda s, d: transforms.transform(_filled(s, d), "level_shift"),
    f"WITH {FILLED}, {_SHIFT} SELECT f.series_id, f.ds, {_r('f.y - SUM(COALESCE(k.d, 0)) OVER (PARTITION BY f.series_id ORDER BY f.ds DESC ROWS UNBOUNDED PRECEDING)', 'y')} FROM f LEFT JOIN k ON f.series_id = k.series_id AND f.ds = k.ds",
)

# What is applied to a history and inverted gives the history again.
_BOTH_WAYS = ["none", "standard", "min_max", "max_abs", "robust", "positive_shift", "log", "detrend", "detrend_through_origin", "center_last", "shift_first", "seasonal_difference", "mean_difference", "mu_law", "a_law", "difference", "cumsum", "pct_change", "level_shift"]


def _and_back(s, d, name):
    panel, t = _filled(s, d), transforms.transformer(name)
    found = t.fit(panel)
    return t.invert(t.apply(panel, found), found, "original")


for _name in _BOTH_WAYS:
    _register(f"round_trip_{_name}", lambda s, d, n=_name: _and_back(s, d, n), f"WITH {FILLED} SELECT series_id, ds, {_r('y', 'y', 2)} FROM f", 2)

# Fitted on the train rows, applied to all of them, and the held-out rows inverted as a forecast.
_TEST = f"WITH {FILLED} SELECT series_id, ds, {{0}} FROM (SELECT *, ROW_NUMBER() OVER ({_W} DESC) AS rn FROM f) WHERE rn <= {HORIZON}"


def _ahead(s, d, name):
    panel, t = _filled(s, d), transforms.transformer(name)
    train, test = _split(s, d)
    found = t.fit(train)
    held = t.apply(panel if name in ("difference", "cumsum", "pct_change") else test, found)
    return t.invert(held.join(test.select("series_id", "ds"), ["series_id", "ds"], "left_semi"), found, "forecast")


for _name in ["standard", "min_max", "max_abs", "robust", "log", "detrend", "center_last", "shift_first", "seasonal_difference", "mu_law", "difference", "cumsum", "pct_change"]:
    _register(f"inverse_of_{_name}", lambda s, d, n=_name: _ahead(s, d, n), _TEST.format(_r("y", "y", 2)), 2)


def _aligned(s, d, **how):
    train, test = _split(s, d)
    t = transforms.transformer("align_last", **how)
    return t.invert(test.select("series_id", "ds", "y"), t.fit(train), "forecast")


_LASTS = f"WITH {SPLIT}, a AS (SELECT series_id, ARG_MAX(y, ds) AS c FROM train GROUP BY 1), h AS (SELECT series_id, ds, y FROM n WHERE rn <= {HORIZON})"
_register("inverse_of_align_last", _aligned, f"{_LASTS} SELECT series_id, ds, {_r(f'y + c - FIRST_VALUE(y) OVER ({_W})', 'y')} FROM h JOIN a USING (series_id)")
_register("inverse_of_align_last_ratio", lambda s, d: _aligned(s, d, strength=0.5, multiplicative=True), f"{_LASTS} SELECT series_id, ds, {_r(f'y * (1 + (c / FIRST_VALUE(y) OVER ({_W}) - 1) * 0.5)', 'y')} FROM h JOIN a USING (series_id)")
_PIPELINE = {"fillna": "ffill", "transformations": {"0": "clip_outliers", "2": "standard", "1": "seasonal_difference", "10": "difference"}, "transformation_params": {"0": {"k": 9.0}}}


def _piped(s, d):
    p = transforms.Pipeline.of(_PIPELINE)
    from tidewright.sources import panel as source

    return p.invert(p.fit_apply(source.orders_daily(s, d)), "original")


_register("round_trip_pipeline", _piped, f"WITH {FILLED} SELECT series_id, ds, {_r(f'GREATEST(LEAST(y, AVG(y) {_P} + 9 * {_SD}), AVG(y) {_P} - 9 * {_SD})', 'y', 2)} FROM f", 2)
for _method, _n in (("HalfMax", "CEIL(n / 2.0)"), ("2ForecastLength", "56"), ("0.2", "CEIL(n * 0.2)"), ("-100", "n - 100")):
    _register(f"slice_{_method.lower().replace('.', '_').replace('-', 'less_')}", lambda s, d, m=_method: transforms.context_slice(_filled(s, d), m, HORIZON), f"WITH {FILLED} SELECT series_id, ds, {_r('y', 'y')} FROM (SELECT *, ROW_NUMBER() OVER ({_W} DESC) AS rn, COUNT(*) {_P} AS n FROM f) WHERE rn <= {_n}")
