"""Registered queries of validation, scores, selection, ensembles, reconciliation and regressors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalog import _METRICS_SQL, _SEASON, _W, FILLED, HORIZON, SPLIT, _filled, _r, _register, _split, flagship
from tidewright.operators import ensembles, forecast, joins, metrics, search
from tidewright.sources import panel as source

_F = f"WITH {FILLED}"
_N = "dd AS (SELECT ds, ROW_NUMBER() OVER (ORDER BY ds) AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT ds FROM f))"
_CUTS = {
    "backwards": f"n - k * {HORIZON}",
    "even": f"(n - {HORIZON}) // 4 * k + {HORIZON}",
    "seasonal 364": f"n - (k * 364 - {HORIZON})",
    "mixed_length": f"CASE k WHEN 1 THEN n // 2 WHEN 2 THEN 2 * n // 3 ELSE n - {HORIZON} END",
}
for _m, _c in _CUTS.items():
    _register(
        f"validation_splits_{_m.replace(' ', '_')}",
        lambda s, d, m=_m: search.split_table(_filled(s, d), m, HORIZON, 3).groupBy("split", "role").agg(F.count("*").alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last")),
        f"{_F}, {_N}, e AS (SELECT k, ds, i, CASE WHEN k = 0 THEN n ELSE {_c} END AS e FROM dd, range(0, 4) t(k)) SELECT CAST(k AS INTEGER) AS split, CASE WHEN i > e - {HORIZON} THEN 'test' ELSE 'train' END AS role, COUNT(*) AS n, MIN(ds) AS first, MAX(ds) AS last FROM e WHERE i <= e GROUP BY 1, 2",
    )
for _m in ("similarity", "seasonal"):
    _register(f"validation_splits_{_m}", lambda s, d, m=_m: search.split_table(_filled(s, d), m, HORIZON, 2).groupBy("split", "role").agg(F.count("*").alias("n"), F.max("ds").alias("last")))
_register("validation_most", lambda s, d: s.createDataFrame([(n, search.most_validations(n, HORIZON, "max")) for n in (60, 100, 500)], "n int, validations int"), f"SELECT * FROM (VALUES (60::INTEGER, {max(min(50, int(60 / HORIZON - 1.5)), 0)}::INTEGER), (100, {int(100 / HORIZON - 1.5)}), (500, {int(500 / HORIZON - 1.5)})) t(n, validations)")
_register(
    "validation_slice",
    lambda s, d: joins.on_dates(_filled(s, d), search.split_table(_filled(s, d), "backwards", HORIZON, 2), 2, "test"),
    f"{_F}, {_N} SELECT series_id, f.ds, {_r('y', 'y')} FROM f JOIN dd ON f.ds = dd.ds WHERE i > n - {3 * HORIZON} AND i <= n - {2 * HORIZON}",
)

# Metrics and their averages
_AVG = lambda c: _r(f"AVG({c})", c, 3)
_COLS = ("smape", "mae", "rmse", "spl", "containment")
_BASE = f"SELECT series_id, {', '.join(_COLS)} FROM ({_METRICS_SQL})"
_register("metrics_mean", lambda s, d: metrics.averaged(flagship(s, d).select("series_id", *_COLS)), f"SELECT {', '.join(map(_AVG, _COLS))} FROM ({_BASE})", 3)
_register(
    "metrics_weighted",
    lambda s, d: metrics.averaged(flagship(s, d).select("series_id", *_COLS), metrics.clean_weights(_filled(s, d), s.createDataFrame([("1-URGENT", "-3"), ("2-HIGH", "x")], "series_id string, weight string"))),
    f"SELECT {', '.join(_r(f'SUM({c} * w) / SUM(w)', c, 3) for c in _COLS)} FROM (SELECT *, CASE WHEN series_id = '1-URGENT' THEN 3.0 ELSE 1.0 END AS w FROM ({_BASE}))",
    3,
)
_Q = f"{SPLIT}, {_SEASON}, q AS (SELECT series_id, step, lastvalue AS fc FROM p JOIN steps ON (step - 1) % 7 = b)"
_register(
    "metrics_per_step",
    lambda s, d: metrics.per_step(forecast.seasonal_naive(_split(s, d)[0], HORIZON), _split(s, d)[1], _filled(s, d).groupBy("series_id").agg(F.lit(1.0).alias("weight"))),
    f"WITH {_Q} SELECT CAST(step AS INTEGER) AS step, {_r('SUM(COALESCE(200 * ABS(fc - y) / NULLIF(ABS(fc) + ABS(y), 0), 0)) / COUNT(*)', 'smape')} FROM q JOIN test USING (series_id, step) GROUP BY 1",
)
_register(
    "metrics_extra",
    lambda s, d: metrics.extra(metrics.align(forecast.seasonal_naive(_split(s, d)[0], HORIZON), _split(s, d)[1], metrics.scale_of(_split(s, d)[0]))).select("series_id", "medae", "qae", "threshold_loss"),
    f"WITH {_Q}, e AS (SELECT series_id, fc, y, ABS(fc - y) AS ae FROM q JOIN test USING (series_id, step)) SELECT series_id, {_r('MEDIAN(ae)', 'medae')}, {_r('quantile_cont(ae, 0.9)', 'qae')}, {_r('AVG(CASE WHEN y * 0.9 >= fc THEN 2 * ae ELSE ae END)', 'threshold_loss')} FROM e GROUP BY 1",
)
_register(
    "metrics_histogram",
    lambda s, d: metrics.histogram_distance(_split(s, d)[0], _split(s, d)[1], 10),
    f"""WITH {SPLIT}, u AS (SELECT series_id, y, 1.0 AS a, 0.0 AS b FROM train UNION ALL SELECT series_id, y, 0.0, 1.0 FROM test), m AS (SELECT series_id, MIN(y) AS lo, MAX(y) AS hi FROM u GROUP BY 1),
h AS (SELECT u.series_id, LEAST(FLOOR((y - lo) * 10 / (hi - lo)), 9) AS bin, SUM(a) AS a, SUM(b) AS b FROM u JOIN m USING (series_id) GROUP BY 1, 2), nn AS (SELECT series_id, a / SUM(a) OVER (PARTITION BY series_id) AS a, b / SUM(b) OVER (PARTITION BY series_id) AS b FROM h)
SELECT series_id, {_r('SUM((a - b) * (a - b) / NULLIF(a + b, 0)) / 2', 'distance')} FROM nn GROUP BY 1""",
)
_register(
    "metrics_ranked_probability",
    lambda s, d: metrics.ranked_probability(s.range(10).select(F.lit("x").alias("g"), F.col("id").alias("place"), F.lit(0.1).alias("p"), (F.col("id") == 3).cast("double").alias("hit")), ["g"], "place", "p", "hit"),
    f"SELECT 'x' AS g, {_r('SUM(POW(c, 2)) / 9', 'rps')} FROM (SELECT (k + 1) * 0.1 - (k >= 3)::INT AS c FROM range(10) t(k))",
)

# Results of models: the parts as templates, the lines of an order as their runs
_runs = lambda s, d: source.table(s, d, "lineitem").select(
    F.concat(F.lit("t"), F.col("l_partkey") % 40).alias("id"), F.concat(F.lit("m"), F.col("l_partkey") % 5).alias("model"), F.to_json(F.struct((F.col("l_partkey") % 8).cast("string").alias("lag"), (F.col("l_partkey") % 2).cast("string").alias("trend"))).alias("params"),
    (F.col("l_linenumber") % 3).alias("split"), F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("series_id"), F.when(F.col("l_tax") == 0.08, "failed").alias("exception"), F.col("l_quantity").alias("smape"), (F.col("l_extendedprice") / 1000).alias("mae"),
    (F.col("l_discount") * 10 + 1).alias("spl"), F.col("l_tax").alias("containment"), F.col("l_extendedprice").alias("maxe"), F.col("l_quantity").alias("underestimate"), (F.col("l_orderkey") % 100).cast("double").alias("runtime"),
)
_RUNS = """runs AS (SELECT 't' || (l_partkey % 40) AS id, 'm' || (l_partkey % 5) AS model, (l_partkey % 8)::VARCHAR AS lag, (l_partkey % 2)::VARCHAR AS trend, l_linenumber % 3 AS split, 's' || (l_suppkey % 7) AS series_id, CASE WHEN l_tax = 0.08 THEN 'failed' END AS exception,
l_quantity AS smape, l_extendedprice / 1000 AS mae, l_discount * 10 + 1 AS spl, l_tax AS containment, l_extendedprice AS maxe, l_quantity AS underestimate, (l_orderkey % 100)::DOUBLE AS runtime FROM lineitem)"""
_NAMES = ("smape", "mae", "spl", "containment", "maxe", "underestimate")
_OVER = f"{_RUNS}, ov AS (SELECT id, model, COUNT(DISTINCT split) AS runs, AVG(smape) AS smape, AVG(mae) AS mae, AVG(spl) AS spl, AVG(containment) AS containment, MAX(maxe) AS maxe, SUM(underestimate) AS underestimate FROM runs WHERE exception IS NULL GROUP BY 1, 2)"
_over = lambda s, d: search.over_validations(_runs(s, d), _NAMES)
_register("results_over_validations", _over, f"WITH {_OVER} SELECT id, model, runs, {', '.join(_r(c, c) for c in _NAMES)} FROM ov")
_register("results_failure_rate", lambda s, d: search.failure_rate(_runs(s, d)), f"WITH {_RUNS} SELECT model, {_r('AVG((exception IS NOT NULL)::INT)', 'failures')} FROM runs GROUP BY 1")
_W3 = {"smape": 5.0, "mae": 2.0, "containment": 0.5}
_SC = f"{_OVER}, sr AS (SELECT *, smape / MIN(smape) OVER () AS ra FROM ov), sc AS (SELECT id, model, runs, 5 * ra + 2 * mae / MIN(mae) OVER () + 0.5 * (1 + ABS(0.9 - containment)) * quantile_cont(ra, 0.5) OVER () AS score FROM sr)"
_scored = lambda s, d: search.score(_over(s, d), _W3)
_register("results_scores", lambda s, d: _scored(s, d).select("id", "model", "score"), f"WITH {_SC} SELECT id, model, {_r('score', 'score')} FROM sc")
_register("results_head", lambda s, d: search.head(_scored(s, d), 6, 2).select("id", "model", "score"), f"WITH {_SC}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY score, id) AS r FROM sc) SELECT id, model, {_r('score', 'score')} FROM r WHERE r <= 2 ORDER BY score, id LIMIT 6")
_register("results_best", lambda s, d: search.best(_scored(s, d).withColumn("ensemble", F.lit(0)), 3).select("id", "model", "score"), f"WITH {_SC} SELECT id, model, {_r('score', 'score')} FROM sc WHERE runs >= 3 ORDER BY score, id LIMIT 1")
_EACH = f"{_RUNS}, g AS (SELECT *, smape / MIN(smape) OVER w AS ra, mae / MIN(mae) OVER w AS rm FROM (SELECT * FROM runs WHERE exception IS NULL AND id IN (SELECT id FROM runs WHERE exception IS NULL GROUP BY 1 HAVING COUNT(DISTINCT split) >= 3)) WINDOW w AS (PARTITION BY split, series_id))"
_each = lambda s, d: search.per_series(_runs(s, d), {"smape": 5.0, "mae": 2.0}, 3)
_register("results_per_series", _each, f"WITH {_EACH} SELECT id, model, series_id, {_r('AVG(5 * ra + 2 * rm)', 'score')} FROM g GROUP BY 1, 2, 3")
_register(
    "results_for_validation",
    lambda s, d: search.for_validation(_scored(s, d), _each(s, d)),
    f"WITH {_SC}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY score, id) AS r FROM sc), {_EACH[len(_RUNS) + 2:]}, e AS (SELECT id, series_id, AVG(5 * ra + 2 * rm) AS score FROM g GROUP BY 1, 2) (SELECT id FROM r WHERE r <= 5 ORDER BY score, id LIMIT (SELECT GREATEST(FLOOR(COUNT(*) * 0.15), 1)::BIGINT FROM sc)) UNION SELECT ARG_MIN(id, {{'s': score, 'i': id}}) FROM e GROUP BY series_id",
)
_register(
    "results_without_twins",
    lambda s, d: search.without_twins(_runs(s, d)).groupBy("id", "split").agg(F.count("*").alias("n"), F.sum("runtime").alias("runtime")),
    f"WITH {_RUNS} SELECT id, split, COUNT(*) AS n, SUM(runtime) AS runtime FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY split, smape, mae, spl ORDER BY runtime, id) AS r FROM runs) WHERE r = 1 GROUP BY 1, 2",
)
_register("results_impacts", lambda s, d: search.impacts(_runs(s, d).withColumn("score", F.col("smape"))), f"WITH {_RUNS}, x AS (SELECT smape, UNNEST(['lag', 'trend']) AS name, UNNEST([lag, trend]) AS value FROM runs) SELECT name, value, {_r('AVG(smape)', 'score')}, COUNT(*) AS n FROM x GROUP BY 1, 2")
_register("results_correlations", lambda s, d: search.correlations(_runs(s, d), ["smape", "mae", "spl"]), f"WITH {_RUNS} SELECT 'smape' AS a, 'mae' AS b, {_r('CORR(smape, mae)', 'correlation')} FROM runs UNION ALL SELECT 'smape', 'spl', {_r('CORR(smape, spl)', 'correlation')} FROM runs UNION ALL SELECT 'mae', 'spl', {_r('CORR(mae, spl)', 'correlation')} FROM runs")
_register("results_with_extremes", lambda s, d: joins.with_extremes(_over(s, d).select("id", "model"), _runs(s, d)), f"WITH {_OVER} SELECT ov.id, ov.model, {_r('least_mae', 'least_mae')}, {_r('most_mae', 'most_mae')} FROM ov LEFT JOIN (SELECT id, MIN(mae) AS least_mae, MAX(mae) AS most_mae FROM runs GROUP BY 1) x USING (id)")
_tem = lambda s, d: _runs(s, d).select("model", "params", F.lit("{}").alias("transforms"), F.lit(0).alias("ensemble"))
_register("templates_untried", lambda s, d: joins.untried(_tem(s, d), _tem(s, d).where("model IN ('m0', 'm3')")).select("model", "params"), f"WITH {_RUNS} SELECT DISTINCT model, '{{\"lag\":\"' || lag || '\",\"trend\":\"' || trend || '\"}}' AS params FROM runs WHERE model NOT IN ('m0', 'm3')")
_register("templates_in_both", lambda s, d: joins.in_both(_runs(s, d).where("split = 0"), _runs(s, d).where("split = 2"), ["id"]), f"WITH {_RUNS} SELECT id FROM runs WHERE split = 0 INTERSECT SELECT id FROM runs WHERE split = 2")
_register("templates_random", lambda s, d: search.template(s, search.random_rows(12, seed=3)))
_register("templates_bred", lambda s, d: search.template(s, search.bred(search.random_rows(4, seed=3), 8, seed=5)))
_register("search_forecast", lambda s, d: search.Search(HORIZON, population=3, names=["SeasonalNaive", "LastValueNaive"], seed=1).fit(_filled(s, d)).predict().select("series_id", "step", "forecast", "lower", "upper"))
# Ensembles
def _models(s, d):
    train, test = _split(s, d)
    m = ensembles.stack({"last": forecast.last_value(train, HORIZON), "mean": forecast.average_value(train, HORIZON), "seasonal": forecast.seasonal_naive(train, HORIZON)})
    return m, ensembles.errors(m, test)


_MODELS = f"""{SPLIT}, {_SEASON}, m AS (SELECT 'last' AS model, series_id, step, fc FROM (SELECT series_id, ARG_MAX(y, ds) AS fc FROM train GROUP BY 1), steps
UNION ALL SELECT 'mean', series_id, step, fc FROM (SELECT series_id, AVG(y) AS fc FROM train GROUP BY 1), steps UNION ALL SELECT 'seasonal', series_id, step, lastvalue FROM p JOIN steps ON (step - 1) % 7 = b), e AS (SELECT m.*, y, ABS(fc - y) AS ae FROM m JOIN test USING (series_id, step))"""
_S = "CAST(step AS INTEGER) AS step"
_register("ensemble_weighted", lambda s, d: ensembles.weighted(_models(s, d)[0], {"last": 1.0, "mean": 2.0, "seasonal": 5.0}), f"WITH {_MODELS} SELECT series_id, {_S}, {_r('SUM(fc * w) / SUM(w)', 'forecast')} FROM (SELECT *, CASE model WHEN 'last' THEN 1.0 WHEN 'mean' THEN 2.0 ELSE 5.0 END AS w FROM m) GROUP BY series_id, step")
_register("ensemble_midhinge", lambda s, d: ensembles.midhinge(_models(s, d)[0]), f"WITH {_MODELS} SELECT series_id, {_S}, {_r('(quantile_cont(fc, 0.25) + quantile_cont(fc, 0.75)) / 2', 'forecast')} FROM m GROUP BY series_id, step")
_register(
    "ensemble_mosaic_smoothed",
    lambda s, d: ensembles.mosaic_smoothed(*_models(s, d), window=7),
    f"""WITH {_MODELS}, sm AS (SELECT series_id, model, step, ROUND(AVG(ae) OVER (PARTITION BY series_id, model ORDER BY step ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS a FROM e), bm AS (SELECT series_id, step, model FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, step ORDER BY a, model) AS r FROM sm) WHERE r = 1)
SELECT series_id, {_S}, model, {_r('fc', 'forecast')} FROM m JOIN bm USING (series_id, step, model)""",
)
_register("ensemble_horizontal_limited", lambda s, d: ensembles.horizontal(*ensembles.limited(*_models(s, d), 2)), f"WITH {_MODELS}, tot AS (SELECT model FROM (SELECT model, AVG(a) AS a FROM (SELECT model, series_id, AVG(ae) AS a FROM e GROUP BY 1, 2) GROUP BY 1) ORDER BY ROUND(a, 6), model LIMIT 2), bs AS (SELECT series_id, model FROM (SELECT series_id, model, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ROUND(AVG(ae), 6), model) AS r FROM e WHERE model IN (SELECT model FROM tot) GROUP BY 1, 2) WHERE r = 1) SELECT series_id, {_S}, model, {_r('fc', 'forecast')} FROM m JOIN bs USING (series_id, model)")
_register("ensemble_of_mosaic_step", lambda s, d: ensembles.mosaic(*_models(s, d)).where("step = 1").select("series_id", "model"), f"WITH {_MODELS} SELECT series_id, model FROM (SELECT series_id, model, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ROUND(ae, 6), model) AS r FROM e WHERE step = 1) WHERE r = 1")
_register("ensemble_unpredictability", lambda s, d: ensembles.unpredictability(_models(s, d)[1]), f"WITH {_MODELS}, u AS (SELECT series_id, AVG(ae) / NULLIF(AVG(ABS(y)), 0) AS u FROM e GROUP BY 1) SELECT series_id, {_r('(u - MIN(u) OVER ()) / NULLIF(MAX(u) OVER () - MIN(u) OVER (), 0)', 'score')} FROM u")

# Hierarchy and regressors
_GR = "gr AS (SELECT series_id, 'group_' || NTILE(2) OVER (ORDER BY series_id) AS grp FROM (SELECT DISTINCT series_id FROM f))"
_register("hierarchy_tiles", lambda s, d: search.tiles(_filled(s, d), 2), f"{_F}, {_GR} SELECT series_id, grp FROM gr")


def _levels(s, d):
    train, _ = _split(s, d)
    groups = search.tiles(train, 2)
    top = train.join(groups, "series_id").groupBy(F.col("grp").alias("series_id"), "ds").agg(F.sum("y").alias("y"))
    both = forecast.average_value(train, 3, "median").unionByName(forecast.average_value(top, 3, "median"))
    return both.select("series_id", "step", "forecast"), groups


_LV = f"{SPLIT}, {_GR.replace('FROM f)', 'FROM train)')}, bt AS (SELECT series_id, MEDIAN(y) AS fc FROM train GROUP BY 1), tp AS (SELECT grp, MEDIAN(y) AS fc FROM (SELECT grp, ds, SUM(y) AS y FROM train JOIN gr USING (series_id) GROUP BY 1, 2) GROUP BY 1), gp AS (SELECT tp.grp, ANY_VALUE(tp.fc) AS top, (ANY_VALUE(tp.fc) - SUM(bt.fc)) / (COUNT(*) + 1) AS g FROM tp JOIN gr USING (grp) JOIN bt USING (series_id) GROUP BY 1), s3 AS (SELECT CAST(UNNEST([1, 2, 3]) AS INTEGER) AS step)"
_register("hierarchy_reconciled", lambda s, d: search.reconcile(*_levels(s, d)), f"WITH {_LV} SELECT series_id, step, {_r('fc + g', 'forecast')} FROM bt JOIN gr USING (series_id) JOIN gp USING (grp), s3 UNION ALL SELECT grp, step, {_r('top - g', 'forecast')} FROM gp, s3")
_register(
    "hierarchy_reconciled_by_share",
    lambda s, d: aggregates_reconcile(s, d),
    f"WITH {_LV}, sh AS (SELECT series_id, SUM(ABS(y)) / SUM(SUM(ABS(y))) OVER (PARTITION BY grp) AS share FROM train JOIN gr USING (series_id) GROUP BY series_id, grp), hg AS (SELECT tp.grp, (ANY_VALUE(tp.fc) - SUM(bt.fc)) / 2 AS g FROM tp JOIN gr USING (grp) JOIN bt USING (series_id) GROUP BY 1) SELECT series_id, step, {_r('fc + share * g', 'forecast')} FROM bt JOIN gr USING (series_id) JOIN hg USING (grp) JOIN sh USING (series_id), s3",
)


def aggregates_reconcile(s, d):
    from tidewright.operators import aggregates

    both, groups = _levels(s, d)
    bottom = both.join(groups, "series_id").select("series_id", "grp", "step", "forecast")
    top = both.join(groups.select(F.col("grp").alias("series_id")).distinct(), "series_id").select(F.col("series_id").alias("grp"), "step", "forecast")
    totals = _split(s, d)[0].join(groups, "series_id").groupBy("series_id", "grp").agg(F.sum(F.abs("y")).alias("total"))
    return aggregates.reconcile_mean(bottom, top, aggregates.group_shares(totals, "grp", "total").select("series_id", "share"))


_register(
    "regressor_lagged",
    lambda s, d: search.lagged_regressor(_filled(s, d), HORIZON, "mean+std"),
    f"""{_F}, ev AS (SELECT series_id, ds FROM f UNION SELECT series_id, ds + {HORIZON} FROM f), l AS (SELECT ev.series_id, ev.ds, f.y FROM ev LEFT JOIN f ON f.series_id = ev.series_id AND f.ds + {HORIZON} = ev.ds),
b AS (SELECT series_id, ds, COALESCE(y, FIRST_VALUE(y IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM l) SELECT ds, {_r('AVG(y)', 'mean')}, {_r('STDDEV_SAMP(y)', 'std')} FROM b GROUP BY 1""",
)
_register("regressor_aligned", lambda s, d: joins.align_regressor(_filled(s, d), source.table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("ds")).agg(F.sum("l_quantity").alias("shipped"))), f"{_F}, r AS (SELECT CAST(l_shipdate AS DATE) AS ds, SUM(l_quantity) AS shipped FROM lineitem GROUP BY 1) SELECT series_id, f.ds, {_r('y', 'y')}, {_r('COALESCE(shipped, 0)', 'shipped')} FROM f LEFT JOIN r ON f.ds = r.ds")
