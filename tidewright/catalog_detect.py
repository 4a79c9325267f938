"""Registered queries of detection, risk, constraints and scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalog import _P, _SEASON, _W, FILLED, HORIZON, SPLIT, _filled, _r, _register, _split
from tidewright.functions import scalar
from tidewright.operators import detect, forecast, joins, risk
from tidewright.sources import panel as source

_T = "(1 / (1 + 0.3275911 * ABS({0}) / SQRT(2)))"


def _sf(x: str) -> str:
    """The same approximation of the normal survival, as SQL."""
    t = _T.format(x)
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(0.5 * (1 - SIGN({x}) * (1 - {poly} * EXP(-({x}) * ({x}) / 2))))"


_FLAG = "CAST(CASE WHEN {0} THEN -1 ELSE 1 END AS INTEGER) AS anomaly"
_ABS = {
    "zscore": (f"ABS(y - AVG(y) {_P}) / STDDEV_SAMP(y) {_P}", "f"),
    "rolling_zscore": (f"ABS(y - AVG(y) OVER w) / NULLIF(STDDEV_SAMP(y) OVER w, 0)", f"f WINDOW w AS ({_W} ROWS BETWEEN 100 PRECEDING AND 99 FOLLOWING)"),
    "mad": (f"ABS(y - m) / AVG(ABS(y - m)) {_P}", f"(SELECT *, MEDIAN(y) {_P} AS m FROM f)"),
    "med_diff": (f"ABS(d) / NULLIF(MEDIAN(ABS(d)) {_P}, 0)", f"(SELECT *, y - LAG(y) OVER ({_W}) AS d FROM f)"),
    "max_diff": (f"ABS(d) / MAX(ABS(d)) {_P}", f"(SELECT *, y - LAG(y) OVER ({_W}) AS d FROM f)"),
}
for _m, (_z, _from) in _ABS.items():
    _register(f"anomaly_{_m}", lambda s, d, m=_m: detect.anomalies(_filled(s, d), m), f"WITH {FILLED}, z AS (SELECT series_id, ds, COALESCE({_z}, 0) - 1 AS z FROM {_from}) SELECT series_id, ds, {_r(_sf('z'), 'score')}, {_FLAG.format(_sf('z') + ' < 0.05')} FROM z")
for _dist, _f in (("laplace", "CASE WHEN z >= 0 THEN 0.5 * EXP(-z) ELSE 1 - 0.5 * EXP(z) END"), ("cauchy", "0.5 - ATAN(z) / PI()"), ("uniform", "LEAST(GREATEST(1 - z, 0), 1)"), ("gamma", "CASE WHEN z > -1 THEN EXP(-z - 1) ELSE 1 END")):
    _register(f"anomaly_zscore_{_dist}", lambda s, d, x=_dist: detect.anomalies(_filled(s, d), "zscore", x), f"WITH {FILLED}, z AS (SELECT series_id, ds, {_ABS['zscore'][0]} - 1 AS z FROM f) SELECT series_id, ds, {_r(_f, 'score')}, {_FLAG.format(_f + ' < 0.05')} FROM z")
_IQR = f"b AS (SELECT *, quantile_cont(y, 0.75) {_P} AS hi, quantile_cont(y, 0.25) {_P} AS lo FROM f), c AS (SELECT *, hi - lo AS w, hi + 1.5 * (hi - lo) AS u, lo - 1.5 * (hi - lo) AS l FROM b), z AS (SELECT *, LEAST(ABS(y - u), ABS(y - l)) / w AS z FROM c)"
_register("anomaly_iqr", lambda s, d: detect.anomalies(_filled(s, d), "iqr"), f"WITH {FILLED}, {_IQR} SELECT series_id, ds, {_r(_sf('z'), 'score')}, {_FLAG.format('y >= u OR y <= l')} FROM z")
_register("anomaly_minmax", lambda s, d: detect.anomalies(_filled(s, d), "minmax"), f"WITH {FILLED}, z AS (SELECT series_id, ds, 1 - (ABS(y) - MIN(ABS(y)) {_P}) / (MAX(ABS(y)) {_P} - MIN(ABS(y)) {_P}) AS z FROM f) SELECT series_id, ds, {_r('z', 'score')}, {_FLAG.format('z < 0.05')} FROM z")
_ODD = f"odd AS (SELECT series_id, ds, y, {_sf('z')} AS score, {_FLAG.format(_sf('z') + ' < 0.05')} FROM (SELECT *, {_ABS['zscore'][0]} - 1 AS z FROM f))"
_register("anomaly_by_date", lambda s, d: detect.anomalies_by_date(detect.anomalies(_filled(s, d))), f"WITH {FILLED}, {_ODD} SELECT ds, {_r('AVG(score)', 'score')}, {_FLAG.format('AVG((anomaly = -1)::INT) > 0.5')} FROM odd GROUP BY ds")
_register("anomaly_removed", lambda s, d: detect.remove_anomalies(_filled(s, d), detect.anomalies(_filled(s, d))), f"WITH {FILLED}, {_ODD} SELECT series_id, ds, {_r('CASE WHEN anomaly = 1 THEN y END', 'y')} FROM odd")
_register(
    "level_shift_differences",
    lambda s, d: detect.level_differences(_filled(s, d)),
    f"""WITH {FILLED}, g AS (SELECT *, AVG(y) OVER ({_W} ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) - AVG(y) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 89 FOLLOWING) AS g FROM f)
SELECT series_id, ds, {_r('g', 'diff')}, ABS(g) > 2.5 * STDDEV_SAMP(g) {_P} AS shift FROM g""",
)
_register(
    "anomaly_nonparametric",
    lambda s, d: detect.nonparametric(_filled(s, d), start=0.5, limit=3.0),
    f"""WITH {FILLED}, st AS (SELECT series_id, AVG(y) AS m, STDDEV_POP(y) AS s, COUNT(y) AS n FROM f GROUP BY 1), z AS (SELECT 0.5 + 0.5 * k AS z FROM range(6) t(k)),
g AS (SELECT f.series_id, z, m, s, n, AVG(y) FILTER (y < m + z * s) AS mb, STDDEV_POP(y) FILTER (y < m + z * s) AS sb, COUNT(*) FILTER (y >= m + z * s) AS c FROM f JOIN st USING (series_id), z GROUP BY ALL),
e AS (SELECT series_id, ARG_MAX(m + z * s, {{'g': g, 'z': -z}}) FILTER (g > 0) AS e FROM (SELECT *, ((m - mb) / m + (s - sb) / s) / c AS g FROM g WHERE c > 0 AND c <= 0.25 * n) GROUP BY 1)
SELECT f.series_id, ds, {_r('COALESCE(y / e, 0)', 'score')}, {_FLAG.format('y > e')} FROM f LEFT JOIN e USING (series_id)""",
)
_KEYS = "'dom_' || month(ds) || '-' || day(ds) AS dom, 'wkdom_' || month(ds) || '-' || ((day(ds) - 1) // 7 + 1) || '-' || (isodow(ds) - 1) AS wkdom, 'wkdeom_' || month(ds) || '-' || ((day(last_day(ds)) - day(ds)) // 7 + 1) || '-' || (isodow(ds) - 1) AS wkdeom"
_KEYED = f"kd AS (SELECT series_id, ds, anomaly, UNNEST([dom, wkdom, wkdeom]) AS holiday FROM (SELECT *, {_KEYS} FROM odd)), hd AS (SELECT series_id, holiday, AVG((anomaly = -1)::INT) AS rate, COUNT(*) FILTER (anomaly = -1) AS n FROM kd GROUP BY 1, 2 HAVING rate >= 0.1 AND n >= 1)"
_mined = lambda s, d: detect.mine_holidays(detect.anomalies(_filled(s, d)), threshold=0.1, least=1)
_register("holidays_mined", _mined, f"WITH {FILLED}, {_ODD}, {_KEYED} SELECT series_id, holiday, {_r('rate', 'rate')}, n FROM hd")
_dates = lambda s, d: _filled(s, d).select("ds").distinct()
_ON = f"dd AS (SELECT DISTINCT ds FROM f), dk AS (SELECT ds, UNNEST([dom, wkdom, wkdeom]) AS holiday FROM (SELECT *, {_KEYS} FROM dd)), lg AS (SELECT series_id, ds, holiday, rate FROM dk JOIN hd USING (holiday))"
_HOL = f"WITH {FILLED}, {_ODD}, {_KEYED}, {_ON}"
_register("holidays_on_dates", lambda s, d: detect.dates_to_holidays(_dates(s, d), _mined(s, d)), f"{_HOL} SELECT series_id, ds, holiday, {_r('rate', 'rate')} FROM lg")
_register("holidays_flag", lambda s, d: detect.dates_to_holidays(_dates(s, d), _mined(s, d), "flag"), f"{_HOL} SELECT ds, CAST(ds IN (SELECT ds FROM lg) AS INTEGER) AS flag FROM dd")
_register("holidays_series_flag", lambda s, d: detect.dates_to_holidays(_dates(s, d), _mined(s, d), "series_flag"), f"{_HOL} SELECT s.series_id, dd.ds, CAST(EXISTS (SELECT 1 FROM lg WHERE lg.series_id = s.series_id AND lg.ds = dd.ds) AS INTEGER) AS flag FROM (SELECT DISTINCT series_id FROM hd) s, dd")
_register(
    "calendar_and_anomalies",
    lambda s, d: detect.calendar_of_anomalies(detect.anomalies(_filled(s, d)), _dates(s, d).withColumn("month", F.month("ds"))),
    f"WITH {FILLED}, {_ODD}, dd AS (SELECT DISTINCT ds FROM f) SELECT COALESCE(dd.ds, o.ds) AS ds, CAST(month(dd.ds) AS INTEGER) AS month, o.series_id, {_r('o.score', 'score')} FROM dd FULL JOIN (SELECT * FROM odd WHERE anomaly = -1) o ON dd.ds = o.ds",
)
_register("changepoints_cusum", lambda s, d: detect.cusum(_filled(s, d), threshold=8.0))
_register("changepoints_ewma", lambda s, d: detect.ewma_chart(_filled(s, d)))
_register(
    "changepoint_ramps",
    lambda s, d: detect.changepoint_ramps(_dates(s, d), 400, 300).select("ds", "ramp0", "ramp1"),
    f"WITH {FILLED}, t AS (SELECT ds, ROW_NUMBER() OVER (ORDER BY ds) - 1 AS t, COUNT(*) OVER () AS n FROM (SELECT DISTINCT ds FROM f)), c AS (SELECT *, (n - 300) - 400 * ((n - 301) // 400) AS c0 FROM t) SELECT ds, GREATEST(t - c0, 0)::DOUBLE AS ramp0, GREATEST(t - c0 - 400, 0)::DOUBLE AS ramp1 FROM c",
)
_register(
    "market_events",
    lambda s, d: joins.events_of_market(detect.anomalies(_filled(s, d)).where("anomaly = -1").select("series_id", "ds"), 3, 0.2),
    f"""WITH {FILLED}, {_ODD}, pt AS (SELECT series_id, ds FROM odd WHERE anomaly = -1), nd AS (SELECT ds, CASE WHEN ds - LAG(ds) OVER (ORDER BY ds) <= 3 THEN 0 ELSE 1 END AS nw FROM (SELECT DISTINCT ds FROM pt)),
gd AS (SELECT ds, SUM(nw) OVER (ORDER BY ds ROWS UNBOUNDED PRECEDING) AS g FROM nd) SELECT MIN(pt.ds) AS start, MAX(pt.ds) AS "end", COUNT(*) AS points, COUNT(DISTINCT series_id) AS series FROM pt JOIN gd USING (ds) GROUP BY g HAVING COUNT(DISTINCT series_id) >= 0.2 * (SELECT COUNT(DISTINCT series_id) FROM pt)""",
)

# Constraints and risk, on the seasonal naive forecast
_fc = lambda s, d: forecast.seasonal_naive(_split(s, d)[0], HORIZON)
_Q = f"{SPLIT}, {_SEASON}, q AS (SELECT series_id, step, lastvalue AS fc FROM p JOIN steps ON (step - 1) % 7 = b)"
_LIM = {
    "quantile": (dict(value=0.4, direction="upper"), "quantile_cont(y, 0.4)", "up"),
    "stdev": (dict(value=0.1, direction="upper", regularization=0.5), "AVG(y) + 0.1 * STDDEV_SAMP(y)", "half"),
    "stdev_min": (dict(value=0.1, direction="lower"), "MIN(y) - 0.1 * STDDEV_SAMP(y)", "low"),
    "absolute": (dict(value=150000.0, direction="upper"), "150000.0", "up"),
    "last_window": (dict(value=-0.1, direction="upper", window=5), "AVG(y) FILTER (rn <= 5) * 0.9", "up"),
}
_CUT = {"up": "LEAST(fc, lim)", "low": "GREATEST(fc, lim)", "half": "CASE WHEN fc > lim THEN fc + (lim - fc) * 0.5 ELSE fc END"}
for _m, (_kw, _lim, _c) in _LIM.items():
    _register(f"constraint_{_m}", lambda s, d, m=_m, kw=_kw: risk.constrain(_fc(s, d), _split(s, d)[0], m, **kw).select("series_id", "step", "forecast"), f"WITH {_Q}, lm AS (SELECT series_id, {_lim} AS lim FROM train GROUP BY 1) SELECT series_id, CAST(step AS INTEGER) AS step, {_r(_CUT[_c], 'forecast')} FROM q JOIN lm USING (series_id)")
_register(
    "constraint_slope",
    lambda s, d: risk.constrain(_fc(s, d), _split(s, d)[0], "slope", value=0.05, direction="upper", window=10, threshold=0.02).select("series_id", "step", "forecast"),
    f"WITH {_Q}, lm AS (SELECT series_id, AVG(y) FILTER (rn <= 10) * 1.02 AS lim FROM train GROUP BY 1) SELECT series_id, CAST(step AS INTEGER) AS step, {_r(f'LEAST(fc, lim * POW(1.05, step / {HORIZON}.0))', 'forecast')} FROM q JOIN lm USING (series_id)",
)
_register(
    "constraint_historic_diff",
    lambda s, d: risk.constrain(_fc(s, d), _split(s, d)[0], "historic_diff", value=0.3, direction="upper").select("series_id", "step", "forecast"),
    f"WITH {_Q}, hd AS (SELECT series_id, ARG_MIN(y, rn) + 0.3 * MAX(y - y0) AS lim FROM (SELECT *, LAG(y, {HORIZON}) OVER ({_W}) AS y0 FROM train) GROUP BY 1) SELECT series_id, CAST(step AS INTEGER) AS step, {_r('LEAST(fc, lim)', 'forecast')} FROM q JOIN hd USING (series_id)",
)
_register("constraint_round", lambda s, d: risk.constrain(_fc(s, d), None, "round", value=-3).select("series_id", "step", "forecast"), f"WITH {_Q} SELECT series_id, CAST(step AS INTEGER) AS step, {_r('round_even(fc / 1000, 0) * 1000', 'forecast')} FROM q")
_ADJ = {
    "percentage": (dict(value=0.1, first=5, last=10), "fc * CASE WHEN step BETWEEN 5 AND 10 THEN 1.1 ELSE 1 END"),
    "additive": (dict(value=1000.0), "fc + 1000"),
    "ramp_additive": (dict(start=0.0, end=2700.0), f"fc + 2700.0 * (step - 1) / {HORIZON - 1}"),
    "ramp_multiplicative": (dict(start=1.0, end=1.27), f"fc * (1 + 0.27 * (step - 1) / {HORIZON - 1})"),
}
for _m, (_kw, _sql) in _ADJ.items():
    _register(f"adjustment_{_m}", lambda s, d, m=_m, kw=_kw: risk.adjust(_fc(s, d), m, **kw).select("series_id", "step", "forecast"), f"WITH {_Q} SELECT series_id, CAST(step AS INTEGER) AS step, {_r(_sql, 'forecast')} FROM q")
_register(
    "adjustment_smoothing",
    lambda s, d: risk.adjust(_fc(s, d), "smoothing", span=3).select("series_id", "step", "forecast"),
    f"WITH RECURSIVE {_Q}, sm AS (SELECT series_id, CAST(1 AS BIGINT) AS step, fc AS e FROM q WHERE step = 1 UNION ALL SELECT q.series_id, q.step, 0.5 * sm.e + 0.5 * q.fc FROM sm JOIN q ON q.series_id = sm.series_id AND q.step = sm.step + 1) SELECT series_id, CAST(step AS INTEGER) AS step, {_r('e', 'forecast')} FROM sm",
)
_MOTIF = f"""a AS (SELECT series_id, LIST(y ORDER BY ds) AS v FROM train GROUP BY 1), w AS (SELECT series_id, v, i, ROUND(list_sum(list_transform(range(14), lambda j: ABS(v[i + j] - v[len(v) - 13 + j]))), 6) AS d
FROM (SELECT series_id, v, UNNEST(range(1, len(v) - 14 - {HORIZON} + 2)) AS i FROM a)), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY d, i) AS r FROM w),
pa AS (SELECT series_id, step, i AS path, v[i + 13 + step] AS value FROM r, steps WHERE r <= 10)"""


def _risk(s, d):
    train, _ = _split(s, d)
    return risk.event_risk(risk.motif_paths(train, HORIZON, k=10), risk.limits(train, lower=0.2, upper=0.8))


_LIMITS = "li AS (SELECT series_id, quantile_cont(y, 0.2) AS lo, quantile_cont(y, 0.8) AS hi FROM train GROUP BY 1)"
_RISK = f"WITH {SPLIT}, {_MOTIF}, {_LIMITS}, rk AS (SELECT series_id, CAST(step AS INTEGER) AS step, AVG((value >= hi)::INT) AS upper_risk, AVG((value <= lo)::INT) AS lower_risk FROM pa JOIN li USING (series_id) GROUP BY 1, 2)"
_register("event_risk", _risk, f"{_RISK} SELECT series_id, step, {_r('upper_risk', 'upper_risk')}, {_r('lower_risk', 'lower_risk')} FROM rk")
_register("event_risk_result_windows", lambda s, d: risk.motif_paths(_split(s, d)[0], HORIZON, k=10), f"WITH {SPLIT}, {_MOTIF} SELECT series_id, CAST(step AS INTEGER) AS step, CAST(path AS INTEGER) AS path, {_r('value', 'value')} FROM pa")
_register("event_risk_limits", lambda s, d: risk.limits(_split(s, d)[0], lower=0.2, upper=0.8), f"WITH {SPLIT}, {_LIMITS} SELECT series_id, {_r('lo', 'lower_limit')}, {_r('hi', 'upper_limit')} FROM li")
_register("event_risk_historic", lambda s, d: risk.historic_risk(_split(s, d)[0], risk.limits(_split(s, d)[0], lower=0.2, upper=0.8)), f"WITH {SPLIT}, {_LIMITS} SELECT series_id, ds, CAST(y >= hi AS INTEGER) AS upper_risk, CAST(y <= lo AS INTEGER) AS lower_risk FROM train JOIN li USING (series_id)")
_register("event_risk_query", lambda s, d: risk.slice_json(_risk(s, d), F.col("step").between(3, 5)), f"{_RISK} SELECT series_id, step, to_json({{'upper_risk': ROUND(upper_risk, 4) + 0.0, 'lower_risk': ROUND(lower_risk, 4) + 0.0}})::VARCHAR AS body FROM rk WHERE step BETWEEN 3 AND 5")

# Scalar functions
_cell = lambda s, d: source.table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 3000).alias("x"))
_register("scalar_mu_law", lambda s, d: _cell(s, d).select("c_custkey", scalar.mu_law(F.col("x")).alias("y")), f"SELECT c_custkey, {_r('SIGN(x) * LN(1 + 255 * ABS(x)) / LN(256)', 'y')} FROM (SELECT c_custkey, c_acctbal / 3000 AS x FROM customer)")
# A companded double holds fewer digits than x, so what comes back is read to the cent, as balances
# are (a thirtieth of the last digit shown), before it is rounded: one in thirty lies on a border.
_back = lambda x: scalar.scaled_round(F.round(x * 3000, 2) / 3000, 4)
_register("scalar_companding_round_trip", lambda s, d: _cell(s, d).select("c_custkey", _back(scalar.mu_law_back(scalar.mu_law(F.col("x")))).alias("mu"), _back(scalar.a_law_back(scalar.a_law(F.col("x")))).alias("a")), f"SELECT c_custkey, {_r('c_acctbal / 3000', 'mu')}, {_r('c_acctbal / 3000', 'a')} FROM customer")
_register("scalar_survival", lambda s, d: _cell(s, d).select("c_custkey", scalar.normal_survival(F.col("x")).alias("p")), f"SELECT c_custkey, {_r(_sf('x'), 'p')} FROM (SELECT c_custkey, c_acctbal / 3000 AS x FROM customer)")
_register("scalar_growth", lambda s, d: s.range(1, 29).select(F.col("id").cast("int").alias("step"), scalar.growth(F.col("id"), 28, 0.5).alias("rate")), f"SELECT CAST(k AS INTEGER) AS step, {_r('POW(1.5, k / 28.0) - 1', 'rate')} FROM range(1, 29) t(k)")
_register("scalar_decay", lambda s, d: s.range(0, 30).select(F.col("id").cast("int").alias("back"), scalar.decay(F.col("id"), span=7).alias("by_span"), scalar.decay(F.col("id"), halflife=5).alias("by_half")), f"SELECT CAST(k AS INTEGER) AS back, {_r('POW(0.75, k)', 'by_span')}, {_r('POW(0.5, k / 5.0)', 'by_half')} FROM range(0, 30) t(k)")
_register("scalar_model_id", lambda s, d: source.table(s, d, "part").select("p_partkey", scalar.model_id(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("id")), "SELECT p_partkey, md5(regexp_replace(p_name || p_brand || p_type, '\\s', '', 'g')) AS id FROM part")
_register(
    "scalar_frequency_seconds",
    lambda s, d: s.createDataFrame([(x,) for x in ("15min", "2H", "D", "W", "30S", "7D")], "f string").select("f", scalar.frequency_seconds(F.col("f")).alias("seconds")),
    "SELECT * FROM (VALUES ('15min', 900::BIGINT), ('2H', 7200), ('D', 86400), ('W', 604800), ('30S', 30), ('7D', 604800)) t(f, seconds)",
)
