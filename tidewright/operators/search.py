"""Templates, validation splits, scores, the search over templates and what is chosen from it."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import joins, metrics, models
from .ensembles import top_per_group
from .lineage import cut

# Validation splits


def cuts(method: str, n: int, horizon: int, validations: int) -> list[int]:
    """How many of n rows each validation has, its last `horizon` rows being its test."""
    out = []
    for y in range(validations):
        if method == "backwards":
            out.append(n - (y + 1) * horizon)
        elif method == "even":
            out.append((n - horizon) // (validations + 1) * (y + 1) + horizon)
        elif method.startswith("seasonal"):
            period = int("".join(c for c in method if c.isdigit()) or 364)
            out.append(n - ((y + 1) * period - horizon) if period >= horizon else n - (y + 1) * horizon)
        elif method == "mixed_length":
            out.append(n // 2 if y == 0 else 2 * n // 3 if y == 1 else n - (y - 1) * horizon)
        else:
            raise ValueError(method)
    return out


def most_validations(n: int, horizon: int, asked: int | str = "auto", least: float = 0.5, method: str = "backwards") -> int:
    """As many validations as the rows allow: `auto` is 3, `max` is 50 at most."""
    asked = 3 if asked == "auto" else 50 if asked == "max" else int(asked)
    if method.startswith("seasonal"):
        period = int("".join(c for c in method if c.isdigit()) or 364)
        return max(min(asked, (n - horizon) // period), 0)
    return max(min(asked, int((n / horizon) - 1 - least)), 0)


def split_table(panel: DataFrame, method: str, horizon: int, validations: int, dates: DataFrame | None = None) -> DataFrame:
    """split, role (train, test), ds: a row a date of each validation; 0 is the first hold-out.

    custom: `dates` is such a table already. similarity: the windows nearest to the last one in
    the mean of the scaled series. seasonal: those that end on the days of the year nearest to the
    last one's. Dates are few, so they are numbered in one window.
    """
    if method == "custom":
        return dates
    each = panel.groupBy("ds").agg(F.avg("y").alias("_y")).withColumn("_i", F.row_number().over(Window.orderBy("ds")))
    if method in ("similarity", "seasonal"):
        from .forecast import DISTANCES

        series = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_y"))), lambda x: x["_y"]).alias("v"))
        n = F.size("v")
        if method == "similarity":
            tail = F.slice("v", n - horizon + 1, F.lit(horizon))
            score = lambda e: DISTANCES["mae"](F.slice("v", e - horizon + 1, F.lit(horizon)), tail)
        else:
            score = lambda e: F.abs(F.pmod((n - e) + F.lit(182.625), F.lit(365.25)) - 182.625)
        ends = F.sequence(F.lit(2 * horizon), n - horizon)
        best = F.slice(F.array_sort(F.transform(ends, lambda e: F.struct(F.round(score(e), 4).alias("d"), (-e).alias("e")))), F.lit(1), F.lit(validations))
        picked = series.select(F.posexplode(F.transform(best, lambda x: -x["e"])).alias("_s", "_end")).withColumn("_s", F.col("_s") + 1)
        whole = series.select(F.lit(0).alias("_s"), n.alias("_end"))
        ends_of = whole.union(picked)
    else:
        n = each.count()
        rows = [(0, n), *enumerate(cuts(method, n, horizon, validations), 1)]
        ends_of = panel.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("_s"), F.lit(c).alias("_end")) for i, c in rows])))
    held = each.crossJoin(F.broadcast(ends_of)).where(F.col("_i") <= F.col("_end"))  # a few rows
    role = F.when(F.col("_i") > F.col("_end") - horizon, "test").otherwise("train")
    return held.select(F.col("_s").alias("split"), role.alias("role"), "ds")


# Templates


def template(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of (model, parameters, transformations, ensemble) with the rows' ids."""
    from ..functions.scalar import model_id

    plain = [(m, json.dumps(p, sort_keys=True), json.dumps(t, sort_keys=True), e) for m, p, t, e in rows]
    df = spark.createDataFrame(plain, "model string, params string, transforms string, ensemble int")
    return df.withColumn("id", model_id(F.col("model"), F.col("params"), F.col("transforms")))


# What random templates draw from.
PARAMS = {
    "AverageValueNaive": {"how": ["mean", "median", "midhinge"]}, "SeasonalNaive": {"lag": [7, 14, 28], "how": ["lastvalue", "mean", "median"]}, "Motif": {"window": [7, 14, 28], "k": [3, 5, 10], "point": ["mean", "median"]},
    "ETS": {"trend": [True, False]}, "ARIMA": {"p": [1, 3, 7], "d": [0, 1], "q": [0, 1]}, "FFT": {"n_harmonics": [4, 10, 20]}, "BasicLinearModel": {"spacing": [60, 180, None], "lam": [0.01, 1.0]},
    "WindowRegression": {"window": [7, 14, 28], "regression_model": ["Ridge", "KNN"]}, "Theta": {}, "GLS": {}, "LastValueNaive": {},
}
STEPS = ("clip_outliers", "standard", "difference", "seasonal_difference", "detrend", "log", "none")


def random_rows(n: int, names: list[str] | None = None, depth: int = 3, seed: int = 0) -> list[tuple]:
    """Random models, parameters and pipelines; the same seed draws the same."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        m = r.choice(names or sorted(PARAMS))
        said = {"fillna": r.choice(["ffill", "mean", "interpolate"]), "transformations": {str(i): r.choice(STEPS) for i in range(r.randint(0, depth))}}
        out.append((m, {k: r.choice(v) for k, v in PARAMS.get(m, {}).items()}, said, 0))
    return out


def bred(best: list[tuple], n: int, seed: int = 0) -> list[tuple]:
    """New templates from the best: parameters of one and the pipeline of another of them, one draw
    of either changed, or a new one."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = r.choice(best), r.choice(best)
        fresh = random_rows(1, [a[0]], seed=seed * 1000 + i)[0]
        params = {k: (fresh[1].get(k, v) if r.random() < 0.3 else v) for k, v in a[1].items()}
        out.append((a[0], params, fresh[2] if r.random() < 0.3 else b[2], 0))
    return out


# Running and scoring


#: Templates that run at a time.
AT_ONCE = 4


def run(panel: DataFrame, templates: list[tuple], splits: DataFrame, horizon: int, which: list[int]) -> DataFrame:
    """Metrics of each template on each split and series: id, model, split, series_id, exception and
    the metrics. Splits, the steps of a pipeline, forecasts and metrics are written one after
    another, some templates at a time; what fails leaves a row with its exception."""
    from ..functions.scalar import model_id
    from .impute import S

    spark = panel.sparkSession

    def one(job) -> DataFrame:
        s, train, test, (m, p, t, e) = job
        said = (F.lit(m), F.lit(json.dumps(p, sort_keys=True)), F.lit(json.dumps(t, sort_keys=True)))
        key = [model_id(*said).alias("id"), said[0].alias("model"), said[1].alias("params"), said[2].alias("transforms"), F.lit(e).alias("ensemble"), F.lit(s).alias("split")]
        try:
            made = cut(models.model_forecast(train, horizon, m, p, t, cut=cut).select("series_id", "step", "forecast", "lower", "upper"))
            return cut(metrics.evaluate(made, test, train).select(*key, "series_id", F.lit(None).cast("string").alias("exception"), *metrics.NAMES))
        except Exception as err:  # a template that cannot be planned or run
            return spark.range(1).select(*key, F.lit(None).cast("string").alias("series_id"), F.lit(str(err)[:300]).alias("exception"), *[F.lit(None).cast("double").alias(c) for c in metrics.NAMES])

    todo = []
    for s in which:
        train = cut(joins.on_dates(panel, splits, s, "train"))
        test = cut(joins.on_dates(panel, splits, s, "test").withColumn("step", F.row_number().over(S().orderBy("ds"))))
        todo += [(s, train, test, t) for t in templates]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, todo))


KEY = ("id", "model")
#: Metrics that are summed, and taken the greatest of, where validations meet.
SUMMED, GREATEST = ("underestimate", "overestimate"), ("maxe",)


def over_validations(results: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row a template: its metrics over series and validations, and the number of runs."""
    how = lambda c: F.sum(c) if c in SUMMED else F.max(c) if c in GREATEST else F.avg(c)
    return results.where("exception IS NULL").groupBy(*KEY).agg(F.count_distinct("split").alias("runs"), *[how(c).alias(c) for c in names])


def failure_rate(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(F.avg(F.col("exception").isNotNull().cast("double")).alias("failures"))


def _part(c: str, w, interval: float) -> Column:
    """A metric's share of a score, over the rows of a window; smaller is better."""
    x = F.col(c)
    least = F.min(F.when(x != 0, F.abs(x))).over(w)
    ratio = F.coalesce(F.abs(x) / least, F.lit(0.0))
    if c in ("mle", "imle"):
        return ratio / 10
    if c == "smoothness":
        return F.coalesce(x / F.nullif(F.avg(x).over(w), F.lit(0.0)), F.lit(0.0))
    if c in ("contour", "oda"):
        return (2 - x) * F.col("_median")
    if c == "containment":
        return (1 + F.abs(interval - x)) * F.col("_median")
    return ratio


def score(results: DataFrame, weights: dict[str, float], by: str | None = None, interval: float = 0.9) -> DataFrame:
    """The results with `score`: the weighted sum of each metric's ratio to its best value that is not
    0; shares (contour, oda, containment) count by how far they are from theirs, on the scale of the
    median ratio of smape. by: a column within whose groups results are compared (series)."""
    w = Window.partitionBy(*([by] if by else []))
    ratio = F.coalesce(F.col("smape") / F.min(F.nullif("smape", F.lit(0.0))).over(w), F.lit(1.0))
    held = results.withColumn("_ratio", ratio)
    held = held.withColumn("_median", F.percentile("_ratio", F.lit(0.5)).over(w))
    total = sum((k * _part(c, w, interval) for c, k in weights.items() if k), F.lit(0.0))
    return held.withColumn("score", total).drop("_ratio", "_median")


def per_series(results: DataFrame, weights: dict[str, float], validations: int, interval: float = 0.9) -> DataFrame:
    """id, model, series_id, score: the mean over validations of scores among a series' results; only
    templates that ran in all of them."""
    ok = results.where("exception IS NULL")
    ran = ok.groupBy("id").agg(F.count_distinct("split").alias("_n")).where(F.col("_n") >= validations).select("id")
    held = ok.join(ran, "id", "left_semi").withColumn("_g", F.concat_ws("|", F.col("split").cast("string"), "series_id"))
    return score(held, weights, "_g", interval).groupBy("id", "model", "series_id").agg(F.avg("score").alias("score"))


def without_twins(results: DataFrame) -> DataFrame:
    """Of templates with the same errors, the fastest: rows with round, smape, mae, spl and runtime."""
    w = Window.partitionBy("split", "smape", "mae", "spl").orderBy("runtime", "id")
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def head(results: DataFrame, n: int, per_model: int) -> DataFrame:
    """The n best by score (nulls last), no more than `per_model` of a model: sorted and cut."""
    top = top_per_group(results.withColumn("_s", F.coalesce("score", F.lit(float("inf")))), "model", ["_s", "id"], per_model)
    return top.orderBy("_s", "id").limit(n).drop("_s", "place")


def for_validation(results: DataFrame, each: DataFrame, share: float = 0.15, per_model: int = 5) -> DataFrame:
    """ids to validate: the best share of all, and the best of every series."""
    n = max(int(results.count() * share), 1)
    best = each.groupBy("series_id").agg(F.min(F.struct("score", "id")).alias("b")).select("b.id")
    return head(results, n, per_model).select("id").union(best).distinct()


def best(results: DataFrame, validations: int, allow_horizontal: bool = True) -> DataFrame:
    """One row: the least score of those that ran in all validations, ensembles by series first."""
    order = [F.col("ensemble").desc()] if allow_horizontal else []
    full = results.where(F.col("runs") >= validations)
    return full.orderBy(*order, F.col("score").asc_nulls_last(), "id").limit(1)


def impacts(results: DataFrame) -> DataFrame:
    """Mean score and runs of each choice of a parameter: JSON objects taken apart into rows."""
    m = F.from_json("params", "map<string,string>")
    return results.select("score", F.explode(m).alias("name", "value")).groupBy("name", "value").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def correlations(results: DataFrame, names: list[str]) -> DataFrame:
    """Correlation of each two metrics over the results, as rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = results.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])))


class Search:
    """Templates are tried on a hold-out, bred from the best for some generations, the best are
    validated, and the best of these forecasts."""

    def __init__(self, horizon: int, validations: int = 1, method: str = "backwards", population: int = 6, generations: int = 1, weights: dict | None = None, names: list[str] | None = None, seed: int = 0):
        self.horizon, self.validations, self.method = horizon, validations, method
        self.population, self.generations, self.names, self.seed = population, generations, names, seed
        self.weights = weights or {"smape": 5.0, "mae": 2.0, "rmse": 2.0, "spl": 3.0, "containment": 0.1}

    def fit(self, panel: DataFrame) -> Search:
        """Every round's metrics are written tables, templates times series; one row a template is collected."""
        splits = split_table(panel, self.method, self.horizon, self.validations)
        known: dict[str, tuple] = {}
        rows = random_rows(self.population, self.names, seed=self.seed)
        measured = metrics.NAMES[:-1]
        found = None
        for g in range(self.generations + 1):
            ids = template(panel.sparkSession, rows).select("id").collect()
            new = {r.id: t for r, t in zip(ids, rows) if r.id not in known}
            known |= new
            if new:
                got = run(panel, list(new.values()), splits, self.horizon, [0])
                found = got if found is None else found.unionByName(got)
            ranked = score(over_validations(found, measured), self.weights).orderBy("score").collect()
            rows = bred([known[r.id] for r in ranked[:3]], self.population, self.seed + g + 1) if ranked else rows
        self.results = found
        keep = [r.id for r in for_validation(score(over_validations(found, measured), self.weights), per_series(found, self.weights, 1)).collect()]
        if self.validations:
            got = run(panel, [known[i] for i in keep], splits, self.horizon, list(range(1, self.validations + 1)))
            self.results = found.unionByName(got)
        summary = score(over_validations(self.results.where(F.col("id").isin(keep)), measured), self.weights).withColumn("ensemble", F.lit(0))
        chosen = best(summary, self.validations + 1).first()
        if chosen is None:
            raise ValueError("no template ran in all validations")
        self.chosen = known[chosen["id"]]
        self.panel = panel
        return self

    def predict(self) -> DataFrame:
        m, p, t, _ = self.chosen
        return models.model_forecast(self.panel, self.horizon, m, p, t)

    def export(self, path: str) -> None:
        template(self.panel.sparkSession, [self.chosen]).write.mode("overwrite").json(path)


def import_templates(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Templates of a JSON file; only models of the list, if one is given."""
    df = spark.read.schema("model string, params string, transforms string, ensemble int, id string").json(path)
    return df.where(F.col("model").isin(names)) if names else df


# Reconciliation of a hierarchy


def summing(groups: DataFrame) -> DataFrame:
    """series_id, grp: a hierarchy by a map is its own table; without one, series in tiles by name."""
    return groups.select("series_id", "grp")


def tiles(panel: DataFrame, n: int = 5) -> DataFrame:
    """series_id, grp: series in the order of their names, dealt into n groups of neighbours."""
    names = panel.select("series_id").distinct()
    return names.withColumn("grp", F.concat(F.lit("group_"), F.ntile(n).over(Window.orderBy("series_id")).cast("string")))


def reconcile(forecast: DataFrame, groups: DataFrame, variance: DataFrame | None = None) -> DataFrame:
    """Bottom (series_id, step, forecast) and group forecasts made coherent by minimum trace with a
    diagonal error variance: a group's gap is shared out over its members and itself in proportion
    to their variances. With one level of groups the projection has this closed form, so it is two
    aggregations and no matrix."""
    v = variance if variance is not None else forecast.select("series_id").distinct().withColumn("variance", F.lit(1.0))
    held = forecast.join(v, "series_id")
    bottom = held.join(groups, "series_id")
    top = held.select(F.col("series_id").alias("grp"), "step", F.col("forecast").alias("_top"), F.col("variance").alias("_vt"))
    sums = bottom.groupBy("grp", "step").agg(F.sum("forecast").alias("_sum"), F.sum("variance").alias("_vs"))
    gap = top.join(sums, ["grp", "step"]).select("grp", "step", "_top", "_vt", ((F.col("_top") - F.col("_sum")) / (F.col("_vs") + F.col("_vt"))).alias("_g"))
    low = bottom.join(gap, ["grp", "step"]).select("series_id", "step", (F.col("forecast") + F.col("variance") * F.col("_g")).alias("forecast"))
    high = gap.select(F.col("grp").alias("series_id"), "step", (F.col("_top") - F.col("_vt") * F.col("_g")).alias("forecast"))
    return low.unionByName(high)


def lagged_regressor(panel: DataFrame, horizon: int, how: str | None = None) -> DataFrame:
    """ds and the series `horizon` rows before as columns (or their mean, median or mean and spread by
    date), for the dates of the history and those that follow it; the first rows are filled from behind."""
    from .impute import S

    last = panel.groupBy("series_id").agg(F.max("ds").alias("_l"))
    moved = panel.select("series_id", F.date_add("ds", horizon).alias("ds"), "y")
    every = panel.select("series_id", "ds").unionByName(moved.join(last, "series_id").where(F.col("ds") > F.col("_l")).select("series_id", "ds"))
    held = every.join(moved, ["series_id", "ds"], "left")
    back = S().orderBy(F.col("ds").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("y", F.coalesce("y", F.last("y", True).over(back)))
    if how is None:
        from ..sources.panel import wide_from_long

        return wide_from_long(held)
    out = {"mean": [F.avg("y").alias("mean")], "median": [F.median("y").alias("median")], "mean+std": [F.avg("y").alias("mean"), F.stddev_samp("y").alias("std")]}[how]
    return held.groupBy("ds").agg(*out)
