"""Steps of a pipeline are written one by one, so a plan holds the work of one step only."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewright import catalog
from tidewright.operators import models, transforms

STEPS = ["clip_outliers", "seasonal_difference", "standard", "difference", "center_last", "detrend"]


def sorts_and_windows(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return sum("Window [" in x or "Sort [" in x or "Aggregate [" in x for x in plan)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(s, datetime.date(2024, 1, 1) + datetime.timedelta(i), None if i % 11 == 4 else 20.0 + k + i % 7 + i / 10) for k, s in enumerate("ab") for i in range(60)]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def test_round_trip_pipeline_leaves_no_step_to_the_last_plan(spark):
    df = catalog.queries()["round_trip_pipeline"](spark, SF)
    assert sorts_and_windows(df) <= 1 and not df.inputFiles()


def test_a_plan_does_not_grow_with_the_steps(panel):
    for n in (1, 3, 6):
        p = transforms.Pipeline([(s, {}) for s in STEPS[:n]])
        made = p.fit_apply(panel)
        back = p.invert(made, "original")
        assert sorts_and_windows(made) == 0 and sorts_and_windows(back) == 0
        filled = transforms.impute(panel, "ffill").withColumnRenamed("y", "was")
        both = back.join(filled, ["series_id", "ds"])
        assert both.count() == 120 and both.where(F.abs(F.col("y") - F.col("was")) > 1e-6).count() == 0


def test_forecast_behind_a_pipeline_reads_its_panel_once(spark, panel):
    seen = spark.sparkContext.accumulator(0)

    def passed(x):
        seen.add(1)
        return x

    counted = panel.withColumn("y", F.udf(passed, "double")("y"))
    said = {"fillna": "ffill", "transformations": {str(i): s for i, s in enumerate(STEPS[:3])}}
    got = models.model_forecast(counted, 7, "LastValueNaive", transforms=said)
    assert len(got.collect()) == 14 and seen.value == 120 and sorts_and_windows(got) <= 1
