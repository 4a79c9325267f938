"""The loop of search on series whose course is known."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import search

N, H = 140, 14
T = np.arange(N + H)
WEEKS = np.column_stack([50 + 5 * np.sin(2 * np.pi * T / 7), 30 + 4 * np.cos(2 * np.pi * T / 7)])


@pytest.fixture(scope="module")
def panel(spark):
    rows = pd.DataFrame({"series_id": np.repeat(["a", "b"], N), "ds": np.tile(pd.date_range("2020-01-01", periods=N).date, 2), "y": WEEKS[:N].T.ravel()})
    return spark.createDataFrame(rows, "series_id string, ds date, y double").cache()


def test_a_template_that_fails_is_a_row(panel):
    splits = search.split_table(panel, "backwards", H, 1)
    plain = {"fillna": "ffill", "transformations": {}}
    got = search.run(panel, [("LastValueNaive", {}, plain, 0), ("NoSuchModel", {}, plain, 0)], splits, H, [0]).toPandas()
    assert sorted(got["series_id"].dropna()) == ["a", "b"] and got["exception"].notna().sum() == 1


def test_search_finds_the_season(panel, tmp_path):
    found = search.Search(H, validations=1, population=3, generations=1, names=["SeasonalNaive", "LastValueNaive"], seed=1).fit(panel)
    assert found.chosen[0] == "SeasonalNaive"
    assert found.results.where("exception IS NULL").select(F.count_distinct("split")).first()[0] == 2
    out = found.predict().toPandas().pivot(index="step", columns="series_id", values="forecast").to_numpy()
    assert out.shape == (H, 2) and np.abs(out - WEEKS[N:]).max() < 1e-6
    found.export(str(tmp_path / "best"))
    assert search.import_templates(panel.sparkSession, str(tmp_path / "best")).first()["model"] == "SeasonalNaive"
