"""The engine's registered queries and their SQL.

The panel of most queries: daily order totals by priority, on a full daily spine, gaps filled
forward. Results are rounded to 4 decimals on both sides.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import dates
from tidewright.operators import forecast, metrics, transforms
from tidewright.operators.impute import METHODS, impute
from tidewright.sources import panel as source

HORIZON = 28

RAW = """raw AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, ROUND(SUM(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2),
spine AS (SELECT s.series_id, d.ds FROM (SELECT DISTINCT series_id FROM raw) s, (SELECT CAST(UNNEST(generate_series(mn, mx, INTERVAL 1 DAY)) AS DATE) AS ds FROM (SELECT MIN(ds)::TIMESTAMP AS mn, MAX(ds)::TIMESTAMP AS mx FROM raw)) d),
panel AS (SELECT spine.series_id, spine.ds, raw.y FROM spine LEFT JOIN raw ON spine.series_id = raw.series_id AND spine.ds = raw.ds)"""
_W = "PARTITION BY series_id ORDER BY ds"
_LAST = f"LAST_VALUE(y IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = f"FIRST_VALUE(y IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_P = "OVER (PARTITION BY series_id)"
FILLED = f"{RAW}, f AS (SELECT series_id, ds, COALESCE({_LAST}, {_NEXT}) AS y FROM panel)"
SPLIT = f"""{FILLED}, n AS (SELECT *, ROW_NUMBER() OVER ({_W} DESC) AS rn FROM f), train AS (SELECT series_id, ds, y, rn - {HORIZON} AS rn FROM n WHERE rn > {HORIZON}),
test AS (SELECT series_id, {HORIZON} + 1 - rn AS step, y FROM n WHERE rn <= {HORIZON}), steps AS (SELECT CAST(UNNEST(range(1, {HORIZON + 1})) AS INTEGER) AS step),
wd AS (SELECT series_id, quantile_cont(y, 0.9) - quantile_cont(y, 0.5) AS up, quantile_cont(y, 0.5) - quantile_cont(y, 0.1) AS lo FROM train GROUP BY 1)"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute(source.orders_daily(spark, sf_dir), "ffill")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return source.holdout(_filled(spark, sf_dir), HORIZON)


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """-0.0 and rounding noise made alike."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(x: str, name: str, digits: int = 4) -> str:
    return f"ROUND({x}, {digits}) + 0.0 AS {name}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(name: str, query, sql: str | None = None, digits: int = 4) -> None:
    QUERIES[name] = lambda spark, sf_dir: _rounded(query(spark, sf_dir), digits)
    if sql:
        SQL[name] = sql


_register("panel_regularise", source.orders_daily, f"WITH {RAW} SELECT series_id, ds, {_r('y', 'y')} FROM panel")
_register(
    "panel_holdout",
    lambda s, d: _split(s, d)[1].select("series_id", "ds", "step", "y"),
    f"WITH {FILLED}, n AS (SELECT *, ROW_NUMBER() OVER ({_W} DESC) AS rn FROM f) SELECT series_id, ds, CAST({HORIZON} + 1 - rn AS INTEGER) AS step, {_r('y', 'y')} FROM n WHERE rn <= {HORIZON}",
)


def _wide(spark, sf_dir):
    """A column for each order priority, under names without signs."""
    wide = source.wide_from_long(_filled(spark, sf_dir))
    return wide.select("ds", *[F.col(f"`{c}`").alias(_plain(c)) for c in wide.columns if c != "ds"])


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalpha() or c == " ").strip().replace(" ", "_")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_WIDE_SQL = ", ".join(_r(f"MAX(CASE WHEN series_id = '{n}' THEN y END)", _plain(n)) for n in _PRIORITIES)
_LONG_SQL = " ".join(f"WHEN '{n}' THEN '{_plain(n)}'" for n in _PRIORITIES)
_register("panel_wide", _wide, f"WITH {FILLED} SELECT ds, {_WIDE_SQL} FROM f GROUP BY ds")
_register("panel_long", lambda s, d: source.long_from_wide(_wide(s, d), "ds"), f"WITH {FILLED} SELECT CASE series_id {_LONG_SQL} END AS series_id, ds, {_r('y', 'y')} FROM f")

_BETWEEN = f"""i AS (SELECT *, ROW_NUMBER() OVER ({_W}) AS i FROM panel), k AS (SELECT *, MAX(CASE WHEN y IS NOT NULL THEN i END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS i0,
MIN(CASE WHEN y IS NOT NULL THEN i END) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1, {_LAST} AS y0, {_NEXT} AS y1 FROM i)"""
_LINE = "COALESCE(y, y0 + (y1 - y0) * (i - i0) / NULLIF(i1 - i0, 0), y0, y1, 0)"
_IMPUTE_SQL = {
    "ffill": f"COALESCE({_LAST}, {_NEXT}, 0)",
    "previous": f"COALESCE({_LAST}, {_NEXT}, 0)",
    "bfill": f"COALESCE({_NEXT}, {_LAST}, 0)",
    "zero": "COALESCE(y, 0)",
    "one": "COALESCE(y, 1)",
    "mean": f"COALESCE(y, AVG(y) {_P}, 0)",
    "median": f"COALESCE(y, MEDIAN(y) {_P}, 0)",
    "ffill_mean_biased": f"COALESCE(y, (COALESCE({_LAST}, {_NEXT}) + AVG(y) {_P}) / 2, 0)",
    "rolling_mean": f"COALESCE(y, AVG(y) OVER ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), {_LAST}, {_NEXT}, 0)",
    "rolling_mean_24": f"COALESCE(y, AVG(y) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), {_LAST}, {_NEXT}, 0)",
}
_PLACED_SQL = {"interpolate": _LINE, "time": _LINE, "nearest": "COALESCE(y, CASE WHEN i - i0 <= i1 - i THEN y0 ELSE y1 END, y0, y1, 0)"}
for _m in METHODS:
    _digits = 6 if _m.startswith("rolling_mean") else 4  # means of eight cents end in a 5 at the fifth place
    _sql = f"WITH {RAW} SELECT series_id, ds, {_r(_IMPUTE_SQL[_m], 'y', _digits)} FROM panel" if _m in _IMPUTE_SQL else f"WITH {RAW}, {_BETWEEN} SELECT series_id, ds, {_r(_PLACED_SQL[_m], 'y')} FROM k"
    _register(f"impute_{_m}", lambda s, d, m=_m: impute(source.orders_daily(s, d), m), _sql, _digits)
_register(
    "impute_fake_date",
    lambda s, d: impute(source.orders_daily(s, d), "fake date"),
    f"""WITH {RAW}, b AS (SELECT series_id, ds, y, ROW_NUMBER() OVER ({_W} DESC) AS b FROM panel), v AS (SELECT series_id, ROW_NUMBER() OVER ({_W} DESC) AS b, y FROM panel WHERE y IS NOT NULL),
m AS (SELECT b.series_id, b.ds, v.y FROM b LEFT JOIN v ON b.series_id = v.series_id AND b.b = v.b) SELECT series_id, ds, {_r(f"COALESCE(y, {_NEXT}, 0)", "y")} FROM m""",
)

_register("transform_slice", lambda s, d: transforms.slice_tail(_filled(s, d), 100), f"WITH {FILLED} SELECT series_id, ds, {_r('y', 'y')} FROM (SELECT *, ROW_NUMBER() OVER ({_W} DESC) AS rn FROM f) WHERE rn <= 100")


def _undo(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    w = Window.partitionBy("series_id").orderBy("step")
    last = train.groupBy("series_id").agg(F.max_by("y", "ds").alias("last"))
    changes = test.join(last, "series_id").select("series_id", "step", (F.col("y") - F.coalesce(F.lag("y").over(w), F.col("last"))).alias("y"))
    return transforms.undo_difference(changes, last)


_register("inverse_difference", _undo, f"WITH {SPLIT} SELECT series_id, CAST(step AS INTEGER) AS step, {_r('y', 'y')} FROM test")

_BOUNDS = lambda k: f"{_r(f'fc - {k} * lo', 'lower')}, {_r(f'fc + {k} * up', 'upper')}"
_FORECAST = "CAST(step AS INTEGER) AS step, " + _r("fc", "forecast")
_SEASON = f"b AS (SELECT *, 6 - (rn - 1) % 7 AS b FROM train), p AS (SELECT series_id, b, ARG_MIN(y, rn) AS lastvalue, AVG(y) AS mean, MEDIAN(y) AS median FROM b GROUP BY 1, 2)"
_forecasts = {
    "last_value": (forecast.last_value, f"SELECT series_id, {_FORECAST}, {_BOUNDS(0.9)} FROM (SELECT series_id, ARG_MAX(y, ds) AS fc FROM train GROUP BY 1) JOIN wd USING (series_id), steps"),
    "average_mean": (forecast.average_value, f"SELECT series_id, {_FORECAST}, {_BOUNDS(1)} FROM (SELECT series_id, AVG(y) AS fc FROM train GROUP BY 1) JOIN wd USING (series_id), steps"),
    "average_median": (partial(forecast.average_value, how="median"), f"SELECT series_id, {_FORECAST}, {_BOUNDS(1)} FROM (SELECT series_id, MEDIAN(y) AS fc FROM train GROUP BY 1) JOIN wd USING (series_id), steps"),
    "constant": (forecast.constant, "SELECT series_id, step, 0.0::DOUBLE AS forecast, 0.0::DOUBLE AS lower, 0.0::DOUBLE AS upper FROM wd, steps"),
}
for _k, (_f, _sql) in _forecasts.items():
    _register(f"forecast_{_k}", lambda s, d, f=_f: f(_split(s, d)[0], HORIZON), f"WITH {SPLIT} {_sql}")
for _k in ("lastvalue", "mean", "median"):
    _register(
        f"forecast_seasonal_{_k}",
        lambda s, d, k=_k: forecast.seasonal_naive(_split(s, d)[0], HORIZON, how=k),
        f"WITH {SPLIT}, {_SEASON} SELECT series_id, {_FORECAST}, {_BOUNDS(1)} FROM (SELECT series_id, step, {_k} AS fc FROM p JOIN steps ON (step - 1) % 7 = b) JOIN wd USING (series_id)",
    )
_register(
    "forecast_motif",
    lambda s, d: forecast.motif(_split(s, d)[0], HORIZON),
    f"""WITH {SPLIT}, a AS (SELECT series_id, LIST(y ORDER BY ds) AS v FROM train GROUP BY 1), w AS (SELECT series_id, v, i, ROUND(list_sum(list_transform(range(14), lambda j: ABS(v[i + j] - v[len(v) - 13 + j]))), 4) AS d
FROM (SELECT series_id, v, UNNEST(range(1, len(v) - 14 - {HORIZON} + 2)) AS i FROM a)), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY d, i) AS r FROM w),
p AS (SELECT series_id, step, v[i + 13 + step] AS y FROM r, steps WHERE r <= 5)
SELECT series_id, CAST(step AS INTEGER) AS step, {_r('AVG(y)', 'forecast')}, {_r('quantile_cont(y, 0.05)', 'lower')}, {_r('quantile_cont(y, 0.95)', 'upper')} FROM p GROUP BY 1, 2""",
)
_register(
    "constraint_dampening",
    lambda s, d: forecast.dampen(forecast.seasonal_naive(_split(s, d)[0], HORIZON)).select("series_id", "step", "forecast"),
    f"""WITH {SPLIT}, {_SEASON}, q AS (SELECT series_id, step, lastvalue AS fc FROM p JOIN steps ON (step - 1) % 7 = b), c AS (SELECT *, COALESCE((fc - LAG(fc) OVER (PARTITION BY series_id ORDER BY step)) * POW(0.98, step - 2), 0) AS c FROM q)
SELECT series_id, CAST(step AS INTEGER) AS step, {_r('FIRST_VALUE(fc) OVER w + SUM(c) OVER w', 'forecast')} FROM c WINDOW w AS (PARTITION BY series_id ORDER BY step ROWS UNBOUNDED PRECEDING)""",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal naive forecasts of the last four weeks of each series, scored."""
    train, test = _split(spark, sf_dir)
    return _rounded(metrics.evaluate(forecast.seasonal_naive(train, HORIZON), test, train))


_SAME = "SIGN(fc - last) = SIGN(y - last)"
_M = {
    "smape": "200 * SUM(ABS(e) / NULLIF(ABS(fc) + ABS(y), 0)) / COUNT(y)", "mae": "AVG(ABS(e))", "rmse": "SQRT(AVG(e * e))", "made": "AVG(ABS(da - df)) / MAX(scaler)", "mage": "MAX(mage)", "mate": "ABS(SUM(e))",
    "matse": "ABS(SUM(e)) / SUM(ABS(y))", "underestimate": "SUM(CASE WHEN e <= 0 THEN e ELSE 0 END)", "overestimate": "SUM(CASE WHEN e > 0 THEN e ELSE 0 END)",
    "mle": "AVG(CASE WHEN e > 0 THEN LN(1 + ABS(e)) ELSE ABS(e) END)", "imle": "AVG(CASE WHEN e < 0 THEN LN(1 + ABS(e)) ELSE ABS(e) END)",
    "spl": "AVG(CASE WHEN y >= u THEN 0.9 * (y - u) ELSE (1 - 0.9) * (u - y) END + CASE WHEN y >= l THEN (1 - 0.9) * (y - l) ELSE 0.9 * (l - y) END) / MAX(scaler)",
    "containment": "AVG((y BETWEEN l AND u)::INT)", "contour": "AVG(((da >= 0) = (df > 0))::INT)", "maxe": "MAX(ABS(e))", "oda": f"AVG(({_SAME})::INT)",
    "dwae": f"SQRT(SUM(CASE WHEN {_SAME} THEN ABS(e) ELSE e * e + 1 END) / COUNT(*) / MAX(scaler) + 1)", "mqae": "AVG(ABS(e)) FILTER (rk <= 23)", "ewmae": "AVG(ABS(e) * POW(10, (step - 1) / 27.0))",
    "uwmse": "AVG(POW(ABS(e) * CASE WHEN step = 1 THEN 5.0 WHEN step = 28 THEN 2.5 ELSE 1.0 END, 2)) / MAX(scaler)", "smoothness": "LN(1 + AVG(ABS(d2)))",
    "wasserstein": "AVG(ABS(cf - ca)) / MAX(scaler)", "dwd": "AVG(ABS(cdf - cda)) / MAX(scaler)", "custom": "0.0::DOUBLE",
}
_SCALED = f"""t AS (SELECT series_id, rn, y, ABS(y - LEAD(y) OVER (PARTITION BY series_id ORDER BY rn)) AS d FROM train WHERE rn <= 100),
sc AS (SELECT series_id, AVG(d) AS scaler, ARG_MIN(y, rn) AS last FROM t GROUP BY 1), j AS (SELECT series_id, step, fc, y, fc - lo AS l, fc + up AS u, scaler, last, fc - y AS e FROM q JOIN test USING (series_id, step) JOIN wd USING (series_id) JOIN sc USING (series_id)),
k0 AS (SELECT *, y - COALESCE(LAG(y) OVER w, last) AS da, fc - COALESCE(LAG(fc) OVER w, last) AS df FROM j WINDOW w AS (PARTITION BY series_id ORDER BY step)),
k AS (SELECT *, SUM(y) OVER w AS ca, SUM(fc) OVER w AS cf, SUM(ABS(da)) OVER w AS cda, SUM(ABS(df)) OVER w AS cdf, df - LAG(df) OVER (PARTITION BY series_id ORDER BY step) AS d2, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ABS(e), step) AS rk,
(SELECT AVG(m) FROM (SELECT ABS(SUM(e)) AS m FROM k0 GROUP BY step)) AS mage FROM k0 WINDOW w AS (PARTITION BY series_id ORDER BY step ROWS UNBOUNDED PRECEDING))"""
_METRICS_SQL = f"""WITH {SPLIT}, {_SEASON}, q AS (SELECT series_id, step, lastvalue AS fc FROM p JOIN steps ON (step - 1) % 7 = b), {_SCALED}
SELECT series_id, {", ".join(_r(v, k) for k, v in _M.items())} FROM k GROUP BY series_id"""
_register("flagship_metrics", flagship, _METRICS_SQL)

_DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders)"
_days = lambda s, d: source.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("ds")).distinct()
_register(
    "date_parts",
    lambda s, d: dates.date_parts(_days(s, d)),
    "SELECT ds, " + ", ".join(f"CAST({v} AS INTEGER) AS {k}" for k, v in {"year": "year(ds)", "quarter": "quarter(ds)", "month": "month(ds)", "week": "weekofyear(ds)", "day": "day(ds)", "dayofyear": "dayofyear(ds)", "weekday": "isodow(ds) - 1", "weekend": "isodow(ds) > 5", "month_start": "day(ds) = 1", "month_end": "last_day(ds) = ds"}.items()) + f" FROM {_DAYS}",
)
_register(
    "date_fourier",
    lambda s, d: dates.fourier(_days(s, d), 365.25, 3),
    "SELECT ds, " + ", ".join(_r(f"{f}(2 * PI() * {k} * (ds - DATE '1970-01-01') / 365.25)", f"{f}{k}") for k in (1, 2, 3) for f in ("sin", "cos")) + f" FROM {_DAYS}",
)


def _others() -> None:
    """The other catalogues register their queries when they are imported."""
    from tidewright import catalog_detect, catalog_models, catalog_more, catalog_search, catalog_shape, catalog_transforms  # noqa: F401


def queries() -> dict:
    _others()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _others()
    return dict(SQL)
