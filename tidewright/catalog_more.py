"""Registered queries of windows, aggregates, joins, ensembles, shaping and event time, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalog import _P, _SEASON, _W, FILLED, HORIZON, RAW, SPLIT, _filled, _r, _register, _split
from tidewright.operators import aggregates, ensembles, forecast, joins, windows
from tidewright.operators.impute import impute
from tidewright.operators.transforms import transform
from tidewright.sources import panel as source
from tidewright.sources import shape
from tidewright.streaming import windows as timed

_F = f"WITH {FILLED}"
_COUNT = "CAST(COUNT({0}) AS BIGINT)"
_ROWS = f"OVER ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"

# Windows
_register("window_lags", lambda s, d: windows.lags(_filled(s, d)), f"{_F} SELECT series_id, ds, {_r('y', 'y')}, " + ", ".join(_r(f"LAG(y, {k}) OVER ({_W})", f"lag{k}") for k in range(1, 8)) + " FROM f")
_ROLL = {"low": "MIN(y)", "high": "MAX(y)", "mean": "AVG(y)", "median": "MEDIAN(y)", "q10": "quantile_cont(y, 0.1)", "q90": "quantile_cont(y, 0.9)", "std": "STDDEV_SAMP(y)"}
_register("window_rolling", lambda s, d: windows.rolling(_filled(s, d)), f"{_F} SELECT series_id, ds, " + ", ".join(_r(f"{v} {_ROWS}", k) for k, v in _ROLL.items()) + " FROM f")
_register(
    "window_regression",
    lambda s, d: windows.rolling_regression(_filled(s, d)),
    f"{_F}, x AS (SELECT *, CAST(ROW_NUMBER() OVER ({_W}) - 1 AS DOUBLE) AS x FROM f) SELECT series_id, ds, {_r(f'CASE WHEN x > 0 THEN REGR_SLOPE(y, x) {_ROWS} END', 'slope')}, {_r(f'CASE WHEN x > 0 THEN REGR_INTERCEPT(y, x) {_ROWS} END', 'intercept')} FROM x",
)
_register(
    "window_ewma",
    lambda s, d: windows.ewma(_filled(s, d)),
    f"""{_F}, v AS (SELECT series_id, ds, LIST(y) OVER ({_W} ROWS BETWEEN 150 PRECEDING AND CURRENT ROW) AS v FROM f)
SELECT series_id, ds, {_r('list_sum(list_transform(range(len(v)), lambda j: v[len(v) - j] * POW(0.75, j))) / list_sum(list_transform(range(len(v)), lambda j: POW(0.75, j)))', 'y')} FROM v""",
)
_register(
    "window_cumulative_product",
    lambda s, d: windows.cumulative_product(transform(_filled(s, d), "pct_change").withColumn("y", F.col("y") + 1)),
    f"{_F} SELECT series_id, ds, {_r(f'y / FIRST_VALUE(y) OVER ({_W})', 'y')} FROM f",
)
_register(
    "window_rank_in_history",
    lambda s, d: windows.rank_in_history(_filled(s, d)),
    f"""{_F}, l AS (SELECT *, LAST_VALUE(y) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM f),
c AS (SELECT series_id, COUNT(*) FILTER (y < l) AS a, COUNT(*) FILTER (y <= l) AS b, COUNT(*) AS n FROM l GROUP BY 1) SELECT series_id, {_r('(a + b + (b > a)::INT) * 50.0::DOUBLE / n', 'rank')} FROM c""",
)

# Aggregates
_register("series_weights", lambda s, d: aggregates.weights(_filled(s, d)), f"{_F} SELECT series_id, {_r('AVG(y)', 'mean')}, {_r('MEDIAN(y)', 'median')}, {_r('MIN(y)', 'min')}, {_r('MAX(y)', 'max')}, {_r('1 / AVG(y)', 'inverse_mean')} FROM f GROUP BY 1")
_PROFILE = {
    "mean": "AVG(y)", "std": "STDDEV_SAMP(y)", "min": "MIN(y)", "q25": "quantile_cont(y, 0.25)", "median": "MEDIAN(y)", "q75": "quantile_cont(y, 0.75)", "max": "MAX(y)", "cv2": "POW(STDDEV_SAMP(y) / AVG(y), 2)",
    "adi2": "POW(COUNT(y) / COUNT(*) FILTER (y <> 0), 2)", "autocorrelation": "CORR(y, p)", "unchanged": "AVG((y = p)::INT)",
}
_register("series_profile", lambda s, d: aggregates.profile(_filled(s, d)), f"{_F}, p AS (SELECT *, LAG(y) OVER ({_W}) AS p FROM f) SELECT series_id, COUNT(y) AS n, {', '.join(_r(v, k) for k, v in _PROFILE.items())} FROM p GROUP BY 1")
_register(
    "aggregate_trimmed_mean",
    lambda s, d: aggregates.trimmed_mean(_filled(s, d)),
    f"{_F}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY y) AS r, COUNT(*) {_P} AS n FROM f) SELECT series_id, {_r('AVG(y)', 'y')} FROM r WHERE r > CEIL(n * 0.2) AND r <= n - CEIL(n * 0.2) GROUP BY 1",
)
_register(
    "aggregate_mode",
    lambda s, d: aggregates.mode(transform(_filled(s, d), "round", decimals=-3, on_transform=True)),
    f"{_F}, c AS (SELECT series_id, round_even(y / 1000, 0) * 1000 AS v, COUNT(*) AS n FROM f GROUP BY 1, 2) SELECT series_id, {_r('v', 'y')} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY n DESC, v) AS r FROM c) WHERE r = 1",
)
_register(
    "aggregate_time_weighted_mean",
    lambda s, d: aggregates.time_weighted_mean(_filled(s, d)),
    f"{_F}, w AS (SELECT *, (ds - MIN(ds) {_P})::DOUBLE AS w FROM f) SELECT series_id, {_r('SUM(w * y) / SUM(w)', 'y')} FROM w GROUP BY 1",
)


def _sales(spark, sf_dir):
    """Order totals by region and nation: orders are summed by customer before they meet the rest."""
    t = lambda name: source.table(spark, sf_dir, name)
    by_customer = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    held = by_customer.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return held.groupBy("c_nationkey").agg(F.sum("total").alias("total")).join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "total")


_SALES = "s AS (SELECT r_name, n_name, SUM(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"
_register("hierarchy_shares", lambda s, d: aggregates.group_shares(_sales(s, d), "r_name", "total").select("r_name", "n_name", "share"), f"WITH {_SALES} SELECT r_name, n_name, {_r('total / SUM(total) OVER (PARTITION BY r_name)', 'share')} FROM s")
_register(
    "hierarchy_rollup",
    lambda s, d: _sales(s, d).rollup("r_name", "n_name").agg(F.round(F.sum("total"), 2).alias("total")).select(F.coalesce("r_name", F.lit("all")).alias("r_name"), F.coalesce("n_name", F.lit("all")).alias("n_name"), "total"),
    f"WITH {_SALES} SELECT COALESCE(r_name, 'all') AS r_name, COALESCE(n_name, 'all') AS n_name, ROUND(SUM(total), 2) AS total FROM s GROUP BY ROLLUP (r_name, n_name)",
)

# Joins
_register(
    "join_as_of",
    lambda s, d: joins.as_of(_filled(s, d), _filled(s, d).where(F.col("ds") == F.last_day("ds"))),
    f"{_F}, m AS (SELECT * FROM f WHERE ds = last_day(ds)) SELECT f.series_id, f.ds, {_r('f.y', 'y')}, {_r('m.y', 'value')} FROM f ASOF LEFT JOIN m ON f.series_id = m.series_id AND f.ds >= m.ds",
)


def _nearest(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return joins.nearest_value(forecast.seasonal_naive(train, HORIZON, how="mean"), train)


_register(
    "join_nearest_value",
    _nearest,
    f"WITH {SPLIT}, {_SEASON}, q AS (SELECT series_id, CAST(step AS INTEGER) AS step, mean AS fc FROM p JOIN steps ON (step - 1) % 7 = b) SELECT q.series_id, step, {_r('ARG_MIN(train.y, ABS(train.y - fc))', 'forecast')} FROM q JOIN train ON q.series_id = train.series_id GROUP BY 1, 2",
)

# Ensembles, selection and validation
def _models(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    found = {"last": forecast.last_value(train, HORIZON), "mean": forecast.average_value(train, HORIZON), "seasonal": forecast.seasonal_naive(train, HORIZON)}
    models = ensembles.stack(found)
    return models, ensembles.errors(models, test)


_MODELS = f"""WITH {SPLIT}, {_SEASON}, m AS (SELECT 'last' AS model, series_id, step, fc FROM (SELECT series_id, ARG_MAX(y, ds) AS fc FROM train GROUP BY 1), steps
UNION ALL SELECT 'mean', series_id, step, fc FROM (SELECT series_id, AVG(y) AS fc FROM train GROUP BY 1), steps UNION ALL SELECT 'seasonal', series_id, step, lastvalue FROM p JOIN steps ON (step - 1) % 7 = b),
e AS (SELECT m.*, y, ABS(fc - y) AS ae FROM m JOIN test USING (series_id, step))"""
_STEP = "CAST(step AS INTEGER) AS step"
for _how, _f in (("mean", "AVG(fc)"), ("median", "MEDIAN(fc)")):
    _register(f"ensemble_{_how}", lambda s, d, how=_how: ensembles.simple(_models(s, d)[0], how), f"{_MODELS} SELECT series_id, {_STEP}, {_r(_f, 'forecast')} FROM m GROUP BY series_id, step")
_register("ensemble_distance", lambda s, d: ensembles.distance(_models(s, d)[0], "last", "seasonal", HORIZON // 2), f"{_MODELS} SELECT series_id, {_STEP}, {_r('fc', 'forecast')} FROM m WHERE model = CASE WHEN step <= {HORIZON // 2} THEN 'last' ELSE 'seasonal' END")
for _how, _key in (("horizontal", "series_id"), ("mosaic", "series_id, step")):
    _register(
        f"ensemble_{_how}",
        lambda s, d, f=getattr(ensembles, _how): f(*_models(s, d)),
        f"{_MODELS}, best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_key} ORDER BY ROUND(a, 6), model) AS r FROM (SELECT {_key}, model, AVG(ae) AS a FROM e GROUP BY {_key}, model)) SELECT series_id, {_STEP}, model, {_r('fc', 'forecast')} FROM m JOIN (SELECT {_key}, model FROM best WHERE r = 1) USING ({_key}, model)",
    )
_SCORED = f"""{_MODELS}, g AS (SELECT model, series_id, AVG(ae) AS mae, SQRT(AVG((fc - y) * (fc - y))) AS rmse, 200 * AVG(ae / NULLIF(ABS(fc) + ABS(y), 0)) AS smape FROM e GROUP BY 1, 2),
h AS (SELECT model, AVG(mae) AS mae, AVG(rmse) AS rmse, AVG(smape) AS smape FROM g GROUP BY 1)"""
_WEIGHTS = {"smape": 5.0, "mae": 2.0, "rmse": 2.0}
_register("model_scores", lambda s, d: ensembles.score(_models(s, d)[1], _WEIGHTS), f"{_SCORED} SELECT model, {_r('mae', 'mae')}, {_r('rmse', 'rmse')}, {_r('smape', 'smape')}, {_r(' + '.join(f'{w} * {m} / MIN({m}) OVER ()' for m, w in _WEIGHTS.items()), 'score')} FROM h")
_register(
    "model_top_per_series",
    lambda s, d: ensembles.top_per_group(_models(s, d)[1].groupBy("series_id", "model").agg(F.round(F.avg("ae"), 4).alias("mae")), "series_id", ["mae", "model"], 2),
    f"{_MODELS}, g AS (SELECT series_id, model, {_r('AVG(ae)', 'mae')} FROM e GROUP BY 1, 2) SELECT series_id, model, mae, CAST(r AS INTEGER) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY mae, model) AS r FROM g) WHERE r <= 2",
)
_register(
    "validation_backwards",
    lambda s, d: ensembles.backward_splits(_filled(s, d), HORIZON, 3),
    f"{_F}, v AS (SELECT *, (ROW_NUMBER() OVER ({_W} DESC) - 1) // {HORIZON} AS v, COUNT(*) {_P} AS n FROM f) SELECT CAST(v AS INTEGER) AS validation, series_id, n - (v + 1) * {HORIZON} AS train_rows, MIN(ds) AS test_start, MAX(ds) AS test_end FROM v WHERE v < 3 GROUP BY v, series_id, n",
)

# Shaping
for _kind, _y in (("zeroes", "0.0::DOUBLE"), ("linear", "(k * (t + 1))::DOUBLE"), ("sine", "SIN(k * (t + 1))")):
    _register(f"generate_{_kind}", lambda s, d, k=_kind: shape.generated(s, k), f"SELECT 's' || k AS series_id, DATE '2021-01-01' + t::INTEGER AS ds, {_r(_y, 'y')} FROM range(1, 6) a(k), range(200) b(t)")
_register("shape_first_valid", lambda s, d: shape.first_valid(source.orders_daily(s, d)), f"WITH {RAW} SELECT series_id, MIN(ds) AS ds FROM panel WHERE y IS NOT NULL GROUP BY 1")
_register(
    "shape_without_leading_zeros",
    lambda s, d: shape.without_leading_zeros(impute(source.orders_daily(s, d), "zero")),
    f"WITH {RAW}, z AS (SELECT series_id, ds, COALESCE(y, 0) AS y FROM panel) SELECT series_id, ds, {_r(f'CASE WHEN SUM(y) OVER ({_W} ROWS UNBOUNDED PRECEDING) > 0 OR ds = MAX(ds) {_P} THEN y END', 'y')} FROM z",
)
_register("shape_forecast_index", lambda s, d: shape.future(_filled(s, d), HORIZON), f"WITH {FILLED} SELECT series_id, CAST(k AS INTEGER) AS step, l + k::INTEGER AS ds FROM (SELECT series_id, MAX(ds) AS l FROM f GROUP BY 1), range(1, {HORIZON + 1}) t(k)")


# Event time
def _shown(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")}).withColumn("total", F.round("total", 4))


_shows = lambda a, b: f"strftime({a}, '%Y-%m-%d %H:%M:%S') AS start, strftime({b}, '%Y-%m-%d %H:%M:%S') AS \"end\""
_events = lambda s, d: source.table(s, d, "events")
_AGG = f"COUNT(*) AS n, {_r('SUM(value)', 'total')}"
_register("events_tumbling", lambda s, d: _shown(timed.tumbling(_events(s, d), "1 day", "event_type", "value")), f"SELECT event_type, {_shows('w', 'w + INTERVAL 1 DAY')}, {_AGG} FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS w FROM events) GROUP BY event_type, w")
_register(
    "events_sliding",
    lambda s, d: _shown(timed.sliding(_events(s, d), "2 days", "1 day", "event_type", "value")),
    f"SELECT event_type, {_shows('w', 'w + INTERVAL 2 DAY')}, {_AGG} FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP - to_days(k::INTEGER) AS w FROM events, range(2) t(k)) GROUP BY event_type, w",
)
_register(
    "events_sessions",
    lambda s, d: _shown(timed.sessions(_events(s, d), "6 hours", "user_id", "value")),
    f"""WITH g AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
k AS (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, {_shows('MIN(ts)', 'MAX(ts) + INTERVAL 6 HOUR')}, {_AGG} FROM k GROUP BY user_id, k""",
)
