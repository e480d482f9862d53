"""Exact quantiles by ranges against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.operators import profile

CASES = {
    "one": [3.5],
    "two": [1.0, 2.0],
    "equal": [7.0] * 50,
    "hot": [5.0] * 400 + [float(k) for k in range(100)],
    "signs": [-1e12, -3.0, -1e-9, 0.0, 0.0, 1e-9, 2.0, 1e300],
    "close": [1.7e9 + k / 1000 for k in range(997)],
    "spread": [(-1) ** k * 1.07**k for k in range(800)],
}


@pytest.mark.parametrize("name", CASES)
def test_quantiles(spark, name):
    values = CASES[name]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None)], "x double, nothing double").repartition(3)
    got = profile.quantiles(df, ["x", "nothing"], (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)).first()["__q"]
    assert set(got) == {"x"}
    assert np.allclose(got["x"], np.quantile(values, [0, 0.25, 0.5, 0.75, 0.9, 1]), rtol=1e-12, atol=0)


def test_empty(spark):
    df = spark.createDataFrame([], "x double")
    assert profile.quantiles(df, ["x"]).first()["__q"] == {}
    assert profile.five_numbers(df, ["x"]).first().asDict() == dict.fromkeys(["min", "q1", "median", "q3", "max", "iqr", "lower_bound", "upper_bound"]) | {"column": "x"}
    assert profile.numeric_profile(df, "t", ["x"]).first()["count"] == 0


def test_outliers_come_out(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x")).union(spark.createDataFrame([(1e6,), (-1e6,)], "x double"))
    assert sorted(r.x for r in profile.outlier_rows(df, "x").collect()) == [-1e6, 1e6]
    assert profile.skew_profile(spark.createDataFrame([(float(k),) for k in range(9)], "x double"), ["x"]).first()["direction"] == "Approximately symmetric"
