"""Registered queries of cleaning, calendars, generated panels, aggregates and windows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalog import _P, _W, FILLED, HORIZON, RAW, SPLIT, _days, _filled, _r, _register, _split
from tidewright.functions import calendars
from tidewright.operators import aggregates, windows
from tidewright.sources import frames
from tidewright.sources import panel as source

_F = f"WITH {FILLED}"
_raw = lambda s, d: source.orders_daily(s, d)

# Cleaning
_register("clean_frequency", lambda s, d: frames.infer_frequency(_filled(s, d)), "SELECT 'D' AS frequency")
_register("clean_monthly", lambda s, d: frames.clean_up(_raw(s, d).where("y IS NOT NULL"), "1 month", "month", "sum"), f"WITH {RAW}, m AS (SELECT series_id, CAST(date_trunc('month', ds) AS DATE) AS ds, SUM(y) AS y FROM raw GROUP BY 1, 2), sp AS (SELECT s.series_id, x.ds FROM (SELECT DISTINCT series_id FROM m) s, (SELECT DISTINCT ds FROM m) x) SELECT sp.series_id, sp.ds, {_r('m.y', 'y')} FROM sp LEFT JOIN m ON sp.series_id = m.series_id AND sp.ds = m.ds")
for _fill, _sql in (("zero", "COALESCE(y, 0)"), ("mean", f"COALESCE(y, AVG(y) {_P})"), ("median", f"COALESCE(y, MEDIAN(y) {_P})")):
    _register(f"clean_prefill_{_fill}", lambda s, d, f=_fill: frames.clean_up(_raw(s, d), prefill=f, newest=200, drop_last=3), f"WITH {RAW}, t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER ({_W} DESC) AS b FROM panel) WHERE b BETWEEN 4 AND 203) SELECT series_id, ds, {_r(_sql, 'y')} FROM t WHERE series_id IN (SELECT series_id FROM t GROUP BY 1 HAVING COUNT(y) >= FLOOR(COUNT(*) * 0.001))")
_register("clean_seasons", lambda s, d: frames.seasons(_filled(s, d)), f"{_F}, b AS (SELECT *, ROW_NUMBER() OVER ({_W} DESC) - 1 AS b, COUNT(*) {_P} // 7 AS w FROM f) SELECT series_id, CAST(w - 1 - b // 7 AS INTEGER) AS season, CAST(6 - b % 7 AS INTEGER) AS place, {_r('y', 'y')} FROM b WHERE b < w * 7")
_register("clean_leading_gaps", lambda s, d: frames.drop_leading_gaps(_raw(s, d), share=0.5, window=2), f"WITH {RAW}, g AS (SELECT ds, AVG((y IS NULL)::INT) AS g FROM panel GROUP BY 1), l AS (SELECT MIN(ds) FILTER (g <= 0.5) AS f, COUNT(*) AS n FROM g), c AS (SELECT f, COUNT(*) FILTER (ds < f) AS lead, MAX(n) AS n FROM g, l GROUP BY f) SELECT series_id, ds, {_r('y', 'y')} FROM panel, c WHERE NOT (lead >= 2 AND lead <= 0.5 * n) OR ds >= f")
for _g, _step in (("day", "1 DAY"), ("week", "7 DAY"), ("month", "1 MONTH"), ("year", "1 YEAR")):
    _register(f"future_{_g}", lambda s, d, g=_g: frames.future_steps(_filled(s, d), 6, g), f"{_F} SELECT series_id, CAST(k AS INTEGER) AS step, CAST(l + k * INTERVAL {_step} AS DATE) AS ds FROM (SELECT series_id, MAX(ds) AS l FROM f GROUP BY 1), range(1, 7) t(k)")
_labels = lambda s, d: _filled(s, d).select("series_id", "ds", F.when(F.dayofmonth("ds") > 2, F.date_format("ds", "EEEE")).otherwise(" ").alias("y"))
_LAB = f"{_F}, t AS (SELECT series_id, ds, CASE WHEN day(ds) > 2 THEN dayname(ds) END AS y FROM f), h AS (SELECT series_id, ds, COALESCE(LAST_VALUE(y IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), FIRST_VALUE(y IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM t)"
_register("clean_labels", lambda s, d: frames.encode_labels(_labels(s, d))[0], f"{_LAB} SELECT series_id, ds, DENSE_RANK() OVER (PARTITION BY series_id ORDER BY y)::DOUBLE AS y FROM h")
_register("clean_labels_back", lambda s, d: frames.decode_labels(*frames.encode_labels(_labels(s, d))), f"{_LAB} SELECT series_id, ds, y FROM h")
_register("clean_subset", lambda s, d: frames.subset(_filled(s, d), _filled(s, d).groupBy("series_id").agg(F.avg("y").alias("weight")), 3))
_register("panel_json", lambda s, d: frames.as_json(_filled(s, d).withColumn("y", F.floor("y"))), f"{_F}, j AS (SELECT ds, string_agg('\"' || series_id || '\":' || CAST(FLOOR(y) AS BIGINT), ',' ORDER BY series_id) AS j FROM f GROUP BY 1) SELECT ds, '{{' || j || '}}' AS body FROM j")
_PROFILE = f"{_F}, p AS (SELECT *, LAG(y) OVER ({_W}) AS p FROM f), q AS (SELECT series_id, POW(STDDEV_SAMP(y) / AVG(y), 2) AS cv2, POW(COUNT(y) / COUNT(*) FILTER (y <> 0), 2) AS adi2, CORR(y, p) AS ac, AVG((y = p)::INT) AS un FROM p GROUP BY 1)"
_register("series_class", lambda s, d: frames.classify(aggregates.profile(_filled(s, d))), f"{_PROFILE} SELECT series_id, CASE WHEN un >= 0.95 THEN 'flat' WHEN ac > 0.98 THEN 'smooth_drift' WHEN adi2 >= 1.2 AND cv2 >= 0.5 THEN 'lumpy' WHEN adi2 >= 1.2 THEN 'intermittent' WHEN cv2 >= 0.5 THEN 'erratic' ELSE 'smooth' END AS profile FROM q")
_register("series_distinct", lambda s, d: _filled(s, d).groupBy("series_id").agg(F.count_distinct("y").alias("n")), f"{_F} SELECT series_id, COUNT(DISTINCT y) AS n FROM f GROUP BY 1")
for _agg, _f in (("sum", "SUM"), ("mean", "AVG"), ("max", "MAX"), ("median", "MEDIAN"), ("count", "COUNT")):
    _register(
        f"pivot_{_agg}",
        lambda s, d, a=_agg: source.wide_from_long(source.table(s, d, "events").select("event_type", F.to_date("ts").alias("ds"), F.col("value").alias("y")).withColumnRenamed("event_type", "series_id"), ["click", "view"], a).select("ds", F.col("click").cast("double").alias("click"), F.col("view").cast("double").alias("view")),
        f"SELECT ts::DATE AS ds, {_r(f'''({_f}(value) FILTER (event_type = 'click'))::DOUBLE''', 'click')}, {_r(f'''({_f}(value) FILTER (event_type = 'view'))::DOUBLE''', 'view')} FROM events GROUP BY 1",
    )

# Dates
_D = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders)"
_EXP = {
    "hour": "0", "weekom": "(day(ds) - 1) // 7 + 1", "midyear": "(dayofyear(ds) BETWEEN 75 AND 257)::INT", "quarter_start": "(day(ds) = 1 AND month(ds) % 3 = 1)::INT", "quarter_end": "(last_day(ds) = ds AND month(ds) % 3 = 0)::INT",
    "year_start": "(dayofyear(ds) = 1)::INT", "year_end": "(last_day(ds) = ds AND month(ds) = 12)::INT", "daysinmonth": "day(last_day(ds))", "leap_place": "year(ds) % 4", "epoch": "ds - DATE '1970-01-01'",
}
_cast = lambda parts: ", ".join(f"({v})::DOUBLE AS {k}" for k, v in parts.items())
_register("date_expanded", lambda s, d: calendars.features(_days(s, d), calendars.expanded(F.col("ds").cast("timestamp"))), f"SELECT ds, {_cast(_EXP)} FROM {_D}")
_register("date_binarized", lambda s, d: calendars.features(_days(s, d), calendars.binarized(F.col("ds"))), f"SELECT ds, {_cast({**{f'month_{m}': f'(month(ds) = {m})::INT' for m in range(1, 13)}, **{f'weekday_{k}': f'(isodow(ds) = {k + 1})::INT' for k in range(7)}})} FROM {_D}")
_CF = {f"{n}{f}{k}": f"ROUND({f}(2 * PI() * {k} * (ds - DATE '2030-01-01') / {p}), 6)" for n, p, o in (("y", 365.25, 6), ("w", 7.0, 3)) for k in range(1, o + 1) for f in ("cos", "sin")}
_register("date_common_fourier", lambda s, d: calendars.features(_days(s, d), calendars.common_fourier(F.col("ds"))), "SELECT ds, " + ", ".join(_r(v, k) for k, v in _CF.items()) + f" FROM {_D}")
_LAGGED = {"weekom": _EXP["weekom"], "daysinmonth": _EXP["daysinmonth"], **{f"{k}_lag{n}": _EXP[k].replace("ds", f"(ds - {n})") for n in (1, 7) for k in ("weekom", "daysinmonth")}}
_register("date_lags", lambda s, d: calendars.shifted(_days(s, d), lambda c: {k: v for k, v in calendars.expanded(c).items() if k in ("weekom", "daysinmonth")}, (1, 7)), f"SELECT ds, {_cast(_LAGGED)} FROM {_D}")
_register("date_polynomial", lambda s, d: calendars.polynomial(_days(s, d).select("ds", F.month("ds").cast("double").alias("m"), F.dayofmonth("ds").cast("double").alias("k")), ["m", "k"]), f"SELECT ds, m, k, m * m AS m_m, m * k AS m_k, k * k AS k_k FROM (SELECT ds, month(ds)::DOUBLE AS m, day(ds)::DOUBLE AS k FROM {_D})")
_OFF = lambda i: f"(fmod(ph - {i} / 6.0 + 1.5, 1.0) - 0.5)"
_PH = "(SELECT ds, fmod((ds - DATE '1970-01-01') / 365.25, 1.0) AS ph FROM " + _D + ")"
for _kind, _w in (("morlet", "EXP(-{x} * {x} / 2) * COS(5 * {x})"), ("ricker", "(1 - {x} * {x}) * EXP(-{x} * {x} / 2)")):
    _register(f"date_wavelet_{_kind}", lambda s, d, k=_kind: calendars.wavelets(_days(s, d), 365.25, kind=k), "SELECT ds, " + ", ".join(_r(_w.format(x=f"({_OFF(i)} / 0.15)"), f"{_kind}{i}") for i in range(6)) + f" FROM {_PH}")
_register("date_islamic", lambda s, d: calendars.features(_days(s, d), calendars.islamic(F.col("ds"))))
_register("date_hebrew", lambda s, d: calendars.features(_days(s, d), calendars.hebrew(F.col("ds"))))
_AGE = "((ds - DATE '1970-01-01') + 0.5 - 10962.76) / 29.530588853"
_register("date_moon", lambda s, d: calendars.features(_days(s, d), calendars.moon(F.col("ds"))), f"SELECT ds, {_r('(1 - COS(2 * PI() * (a - FLOOR(a)))) / 2', 'moon_lit')}, FLOOR(a)::DOUBLE AS lunar_month, (FLOOR((a - FLOOR(a)) * 29.530588853) + 1)::DOUBLE AS lunar_day FROM (SELECT ds, ({_AGE})::DOUBLE AS a FROM {_D})")
_NTH = lambda m, w, n: f"(month(ds) = {m} AND isodow(ds) = {w + 1} AND " + (f"(day(ds) - 1) // 7 + 1 = {n})" if n > 0 else "day(ds) + 7 > day(last_day(ds)))")
_ON = lambda m, k: f"(month(ds) = {m} AND day(ds) = {k})"
_US = {"new_year": _ON(1, 1), "king": _NTH(1, 0, 3), "washington": _NTH(2, 0, 3), "memorial": _NTH(5, 0, -1), "juneteenth": _ON(6, 19), "independence": _ON(7, 4), "labor": _NTH(9, 0, 1), "columbus": _NTH(10, 0, 2), "veterans": _ON(11, 11), "thanksgiving": _NTH(11, 3, 4), "christmas": _ON(12, 25)}
_register("date_holidays_each", lambda s, d: calendars.holiday_flags(_days(s, d), each=True), "SELECT ds, " + ", ".join(f"{v}::INTEGER AS {k}" for k, v in _US.items()) + f" FROM {_D}")
_register("date_holidays", lambda s, d: calendars.holiday_flags(_days(s, d)), f"SELECT ds, ({' OR '.join(_US.values())})::INTEGER AS holiday FROM {_D}")

# Generated panels: drawn by hashes, so they have no SQL but for their exact parts
_register("generate_weekdays", lambda s, d: frames.weekdays(s), "SELECT 'weekday' AS series_id, DATE '2021-01-01' + t::INTEGER AS ds, dayname(DATE '2021-01-01' + t::INTEGER) AS y FROM range(180) r(t)")
_register("generate_noisy_linear", lambda s, d: frames.noisy(s, "linear"))
_register("generate_noisy_sine", lambda s, d: frames.noisy(s, "sine"))
_register("generate_artificial", lambda s, d: frames.artificial(s))
_register("generate_labelled", lambda s, d: frames.labelled(s, 5, 365))
_register("generate_from_template", lambda s, d: frames.labelled(s, 3, 365, template='{"noise": 0.0, "anomaly": 0.0}'))
_register(
    "generate_parts_sum_up",
    lambda s, d: frames.labelled(s, 4, 200).groupBy("series_id").agg(F.count("*").alias("n"), F.max(F.round(F.abs(F.col("y") - F.col("base") - F.col("trend") - F.col("level") - F.col("season") - F.col("holiday") - F.col("anomaly") - F.col("noise")), 6)).alias("gap")),
    "SELECT 'series_' || k AS series_id, 200::BIGINT AS n, 0.0::DOUBLE AS gap FROM range(4) t(k)",
)

# Windows
_register("window_last", lambda s, d: windows.last_window(_filled(s, d), 10).select("series_id", F.size("window").alias("n"), F.round(F.element_at("window", -1), 2).alias("newest")), f"{_F} SELECT series_id, 10::INTEGER AS n, {_r('ARG_MAX(y, ds)', 'newest', 2)} FROM f GROUP BY 1")
_register("window_maker", lambda s, d: windows.make_windows(_filled(s, d), 7, 3, stride=5).select("series_id", "ds", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("x"), F.round(F.aggregate("target", F.lit(0.0), lambda a, v: a + v), 4).alias("target")),
    f"{_F}, n AS (SELECT *, ROW_NUMBER() OVER ({_W}) AS i, COUNT(*) {_P} AS n, SUM(y) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS x, SUM(y) OVER ({_W} ROWS BETWEEN 7 FOLLOWING AND 9 FOLLOWING) AS target FROM f) SELECT series_id, ds, {_r('x', 'x')}, {_r('target', 'target')} FROM n WHERE i + 9 <= n AND (i - 1) % 5 = 0")
_register("window_moving_sum", lambda s, d: windows.moving_sum(_filled(s, d), 7), f"{_F} SELECT series_id, ds, {_r(f'SUM(y) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 'y')} FROM f")
_register("window_forward_mean", lambda s, d: windows.forward_mean(_filled(s, d), 7), f"{_F} SELECT series_id, ds, {_r(f'AVG(y) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)', 'y')} FROM f")
_register(
    "window_features",
    lambda s, d: windows.features(_filled(s, d)).select("series_id", "ds", "macd", "energy", "nonzero", "autocorrelation"),
    f"""{_F}, l AS (SELECT *, LAG(y) OVER ({_W}) AS p, ROW_NUMBER() OVER ({_W}) AS i FROM f) SELECT series_id, ds, {_r(f'AVG(y) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) - AVG(y) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)', 'macd', 6)},
{_r(f'SUM(y * y / 1e6) OVER ({_W} ROWS UNBOUNDED PRECEDING)', 'energy', 6)}, COUNT(*) FILTER (y <> 0) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS nonzero, {_r('CASE WHEN i > 3 THEN COVAR_POP(y, p) OVER ww / NULLIF(STDDEV_POP(CASE WHEN p IS NOT NULL THEN y END) OVER ww * STDDEV_POP(p) OVER ww, 0) END', 'autocorrelation', 6)} FROM l WINDOW ww AS ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    6,
)


def _melted(s, d):
    from tidewright.operators import forecast

    return windows.melt_intervals(forecast.seasonal_naive(_split(s, d)[0], HORIZON), 0.9)


_register("melt_intervals", _melted, f"WITH {SPLIT}, pp AS (SELECT series_id, 6 - (rn - 1) % 7 AS b, ARG_MIN(y, rn) AS fc FROM train GROUP BY 1, 2), q AS (SELECT series_id, step, fc, fc - lo AS l, fc + up AS u FROM pp JOIN steps ON (step - 1) % 7 = b JOIN wd USING (series_id)) SELECT series_id, CAST(step AS INTEGER) AS step, UNNEST(['50%', '5.0%', '95.0%']) AS label, ROUND(UNNEST([fc, l, u]), 4) + 0.0 AS value FROM q")
_register(
    "hierarchy_sets",
    lambda s, d: source.table(s, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice").cube("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("total")).select(F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.round("total", 2).alias("total")),
    "SELECT COALESCE(o_orderpriority, 'all') AS priority, COALESCE(o_orderstatus, 'all') AS status, ROUND(SUM(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)",
    2,
)
_register("components_union", lambda s, d: windows.sum_components([_filled(s, d), _filled(s, d).withColumn("y", F.lit(1.0))]), f"{_F} SELECT series_id, ds, {_r('y + 1', 'y')} FROM f")
