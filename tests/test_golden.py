"""Golden cases of metrics, imputation, quantiles, constraints and validation, with values known from elsewhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import metrics, risk, transforms
from tidewright.operators.impute import fake_date, impute

ACTUAL = {"a": [-10, 10, 10, -10, 0], "b": [0, 10, 0, 0, 10], "c": [None] * 5}
FORECAST = {"a": [-10, 10, 10, -10, 0], "b": [0, 0, 0, 10, 10], "c": [None] * 5}
UPPER = {"a": [10, 20, -10, 10, 20], "b": [0, 0, 0, 10, 10], "c": [0, None, None, None, None]}
LOWER = {"a": [-10, 0, 10, 10, 0], "b": [-10, -10, -10, -10, -5], "c": [None] * 5}
# Metric, mean over series, mean weighted 10 : 1 : 1, series b.
EXPECT = """
smape 40.0 6.667 80.0
mae 2.0 0.333 4.0
rmse 3.162 0.527 6.325
made 0.533 0.089 1.067
mage 4.0 4.0 4.0
underestimate -3.333 -0.833 -10.0
mle 1.240 0.207 2.480
overestimate 3.333 0.833 10.0
imle 1.240 0.207 2.480
spl 0.572 0.623 0.44
containment 0.467 0.567 0.8
contour 0.467 0.717 0.6
maxe 3.333 0.833 10.0
oda 0.533 0.883 0.60
dwae 1.509 1.127 2.527
mqae 1.250 0.208 2.50
ewmae 4.934 1.234 14.803
uwmse 1.778 0.444 5.333
smoothness 2.699 2.893 2.140
wasserstein 0.267 0.044 0.533
dwd 0.8 0.133 1.600
mate 0 0 0
matse 0 0 0
"""


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(k, t + 1, *(None if x[k][t] is None else float(x[k][t]) for x in (FORECAST, LOWER, UPPER, ACTUAL))) for k in ACTUAL for t in range(5)]
    df = spark.createDataFrame(rows, "series_id string, step int, forecast double, lower double, upper double, y double")
    train = df.select("series_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("step")).alias("ds"), "y")
    return metrics.evaluate(df.drop("y"), df.select("series_id", "step", "y"), train, custom=lambda: F.lit(0.952)).cache()


def test_metrics(spark, scored):
    each = {r.series_id: r for r in scored.collect()}
    mean = metrics.averaged(scored).first()
    weighted = metrics.averaged(scored, spark.createDataFrame([("a", 10.0), ("b", 1.0), ("c", 1.0)], "series_id string, weight double")).first()
    for line in EXPECT.strip().split("\n"):
        name, *values = line.split()
        for got, value in zip((mean[name], weighted[name], each["b"][name]), values):
            assert got == pytest.approx(float(value), abs=6e-4), (name, got, value)
    assert scored.columns == ["series_id", *metrics.NAMES] and each["a"].custom == 0.952
    empty = each["c"]
    assert all(empty[m] is None for m in ("smape", "mae", "rmse", "made", "mle", "imle", "spl", "mqae", "smoothness", "wasserstein", "dwd"))
    assert all(empty[m] == 0 for m in ("containment", "contour", "maxe", "oda", "ewmae", "uwmse", "underestimate", "overestimate", "mate")) and empty.dwae == 1


def test_metrics_of_constant_series(spark):
    df = spark.createDataFrame([("k", i, 5.0) for i in range(1, 4)], "series_id string, step int, y double")
    train = spark.createDataFrame([("k", i, 5.0) for i in range(9)], "series_id string, i int, y double").select("series_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("ds"), "y")
    got = metrics.evaluate(df.select("series_id", "step", (F.col("y") + 1).alias("forecast"), F.col("y").alias("lower"), (F.col("y") + 2).alias("upper")), df, train).first()
    assert got.mae == 1 and got.made is not None and got.spl is not None


def panel(spark, columns):
    n = len(next(iter(columns.values())))
    rows = [(k, i, None if v is None else float(v)) for k, vs in columns.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series_id string, i int, y double")
    return df.select("series_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("ds"), "y"), n


def values(df):
    out = {}
    for r in df.orderBy("series_id", "ds").collect():
        out.setdefault(r.series_id, []).append(r.y)
    return out


GAPS = {"a": [5, 10, 15, None, 10], "b": [5, 50, 15, None, 10]}


@pytest.mark.parametrize(
    "method, a, b",
    [
        ("ffill", [5, 10, 15, 15, 10], [5, 50, 15, 15, 10]),
        ("mean", [5, 10, 15, 10, 10], [5, 50, 15, 20, 10]),
        ("median", [5, 10, 15, 10, 10], [5, 50, 15, 12.5, 10]),
        ("fake date", [5, 5, 10, 15, 10], [5, 5, 50, 15, 10]),
        ("interpolate", [5, 10, 15, 12.5, 10], [5, 50, 15, 12.5, 10]),
        ("nearest", [5, 10, 15, 15, 10], [5, 50, 15, 15, 10]),
        ("unknown", [5, 10, 15, None, 10], [5, 50, 15, None, 10]),
    ],
)
def test_imputation(spark, method, a, b):
    assert values(impute(panel(spark, GAPS)[0], method)) == {"a": a, "b": b}


def test_imputation_by_slices_and_of_nothing(spark):
    assert values(fake_date(panel(spark, GAPS)[0], "slice")) == {"a": [5, 10, 15, 10], "b": [5, 50, 15, 10]}
    none = panel(spark, {"x": [None] * 4})[0]
    for method in ("ffill", "bfill", "mean", "median", "rolling mean", "interpolate", "nearest", "fake date", "zero"):
        assert values(impute(none, method)) == {"x": [0] * 4}


def test_imputation_of_long_series_is_quick(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("s").alias("series_id"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("ds"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("y"))
    for method in ("ffill", "interpolate", "bfill"):
        assert impute(df, method).where("y IS NOT NULL").count() == n


@pytest.mark.parametrize("q", [0, 13, 25, 50, 77, 99])
def test_quantiles(spark, q):
    x = np.random.default_rng(0).normal(size=101)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "y double")
    assert df.agg(F.percentile("y", F.lit(q / 100))).first()[0] == pytest.approx(np.nanpercentile(x, q))


def test_constraints(spark):
    rows = [(k, t + 1, float(v), float(v) - 1, float(v) + 3) for k, vs in {"a": [-10, 10, 10, -10, 0], "b": [0, 0, 0, 10, 10]}.items() for t, v in enumerate(vs)]
    fc = spark.createDataFrame(rows, "series_id string, step int, forecast double, lower double, upper double")
    train = fc.select("series_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("step")).alias("ds"), (F.col("forecast") + 1).alias("y"))
    low = risk.constrain(fc, train, "quantile", 0.0, "lower")
    least = {r.series_id: r for r in low.groupBy("series_id").agg(F.min("forecast").alias("f"), F.min("lower").alias("l"), F.min("upper").alias("u")).collect()}
    assert all(least[k].f == least[k].l == v for k, v in {"a": -9.0, "b": 1.0}.items())
    cut = risk.constrain(low, train, "absolute", 5.0, "upper", bounds=False)
    assert sum(r[1] for r in cut.groupBy("series_id").agg(F.max("forecast")).collect()) == 10.0


@pytest.mark.parametrize("name, given, expect", [
    ("positive_shift", [3, 5], [3, 5]), ("positive_shift", [-3, 5], [1, 9]), ("positive_shift", [0.25, 1], [1, 1.75]),
    ("center_last", [2, 4], [0.5, 1]), ("center_last", [2, 0], [1, 0]), ("pct_change", [2, 0, 4], [0, 0, 1]), ("pct_change", [0, 0], [0, 0]),
])
def test_transformations(spark, name, given, expect):
    assert values(transforms.transform(panel(spark, {"s": given})[0], name))["s"] == pytest.approx(expect)


def test_rounding_is_half_to_even(spark):
    assert values(transforms.transform(panel(spark, {"s": [0.5, 1.5, 2.5]})[0], "round", on_transform=True))["s"] == [0, 2, 2]


def test_level_shift_is_taken_out(spark):
    series = panel(spark, {"s": [100.0] * 150 + [200.0] * 150})[0]
    got = values(transforms.transform(series, "level_shift", window=30))["s"]
    assert sum(abs(v - 200) < 15 for v in got) >= 299  # the row at the shift itself may fall on either side
