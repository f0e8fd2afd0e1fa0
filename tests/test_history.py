"""Entity windows against pandas and on edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.functions import history as H
from skyledger.operators import baselines as B
from skyledger.operators.panel import base_panel


@pytest.fixture(scope="module")
def frame():
    """Three cities: gaps and missing values, one single row, one constant."""
    rng = np.random.default_rng(7)
    months = pd.date_range("2019-01-01", periods=40, freq="MS")
    a = pd.DataFrame({"city": "a", "date": months, "x": np.round(rng.gamma(2, 20, 40), 2)})
    a.loc[[3, 17], "x"] = None
    a = a.drop(index=[10, 11, 25])
    b = pd.DataFrame({"city": "b", "date": months[:1], "x": [5.0]})
    c = pd.DataFrame({"city": "c", "date": months[:14], "x": 7.0})
    return pd.concat([a, b, c], ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [(r.city, r.date.date(), None if pd.isna(r.x) else float(r.x)) for r in frame.itertuples()]
    return spark.createDataFrame(rows, "city string, date date, x double")


def compare(df, frame, column, expected):
    got = df.withColumn("y", column).orderBy("city", "date").toPandas()["y"].astype(float).to_numpy()
    np.testing.assert_allclose(got, expected.astype(float).to_numpy(), rtol=1e-9, atol=1e-9)


CASES = {
    "mean3": (lambda: H.rolling("x", 3, F.avg, 3, lagged=False), lambda s: s.rolling(3).mean()),
    "std6": (lambda: H.rolling("x", 6, F.stddev_samp, 2), lambda s: s.shift(1).rolling(6, min_periods=2).std()),
    "median3": (lambda: H.rolling_median("x", 3), lambda s: s.shift(1).rolling(3, min_periods=2).median()),
    "sum6": (lambda: H.rolling("x", 6, F.sum, 1), lambda s: s.shift(1).rolling(6, min_periods=1).sum()),
    "lag": (lambda: H.lag("x", 3), lambda s: s.shift(3)),
    "lead": (lambda: H.lead("x"), lambda s: s.shift(-1)),
    "lagged_change": (lambda: H.lagged_change("x"), lambda s: s.shift(1).diff()),
    "change": (lambda: H.change("x"), lambda s: s.diff()),
    "fill": (lambda: H.fill_both_ways("x"), lambda s: s.bfill().ffill()),
}


@pytest.mark.parametrize("name", CASES)
def test_window_agrees_with_pandas(df, frame, name):
    column, reference = CASES[name]
    compare(df, frame, column(), frame.groupby("city")["x"].transform(reference))


def test_cv_is_zero_without_history(df, frame):
    def cv(s):
        r = s.shift(1).rolling(3, min_periods=2)
        return (r.std() / (r.mean() + 1e-6)).clip(0, 10)

    compare(df, frame, H.rolling_cv("x", 3), frame.groupby("city")["x"].transform(cv).fillna(0))


def test_streaks_reset_and_ignore_missing(df, frame):
    def run(s):
        out, n = [], 0
        for flag in s.shift(1) < 30:
            n = n + 1 if flag else 0
            out.append(n)
        return pd.Series(out, index=s.index)

    got = H.add_streaks(df, {"run": H.lag("x") < 30.0}).orderBy("city", "date").toPandas()["run"]
    assert list(got) == list(frame.groupby("city")["x"].transform(run))


def test_percentile_labels_on_edges(spark):
    rows = [("a", i, float(i)) for i in range(5)] + [("b", 0, 1.0)]
    df = spark.createDataFrame(rows, "city string, date int, s double")
    cuts, labels = (0.5, 0.75), ("Low", "Medium", "High")
    got = df.withColumn("left", H.percentile_labels("s", cuts, labels, "left")).withColumn(
        "right", H.percentile_labels("s", cuts, labels, "right")
    ).orderBy("city", "date").toPandas()
    assert list(got["left"]) == ["Low", "Low", "Medium", "High", "High", "High"]
    assert list(got["right"]) == ["Low", "Low", "Low", "Medium", "High", "Low"]


def test_previous_month_of_january_is_december(spark):
    rows = [("a", 12, 30.0), ("a", 1, 10.0), ("a", 1, 14.0)]
    df = spark.createDataFrame(rows, "city string, month int, x double")
    got = {r["month"]: r["p"] for r in df.withColumn("p", B.previous_month_mean("x")).collect()}
    assert got == {1: 30.0, 12: None}


def test_min_max_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "c double, v double")
    got = B.add_min_max(df, {"c_n": F.col("c"), "v_n": F.col("v")}).orderBy("v").collect()
    assert [(r["c_n"], r["v_n"]) for r in got] == [(0.0, 0.0), (0.0, 1.0)]


def test_zero_and_missing_deviation(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 5.0, 0.2), ("b", 1, 4.0, 4.0, 0.2), ("b", 1, 4.0, 4.0, 0.2)],
                               "city string, month int, temperature_c double, rainfall_mm double, soil_moisture double")
    got = {r["city"]: r["temp_climo_std"] for r in B.place_month_climatology(df).collect()}
    assert got == {"a": None, "b": 0.1}


def test_panel_uses_one_exchange_by_city(tables):
    plan = base_panel(tables.raw_panel)._jdf.queryExecution().executedPlan().toString()
    by_city = [line for line in plan.splitlines() if "Exchange hashpartitioning(city" in line]
    assert len(by_city) == 1
    assert "SinglePartition" not in plan.split("Window")[0]


def test_panel_is_complete_and_positional(panel, tables):
    df = panel.toPandas()
    assert not df.isna().any().any()
    raw = tables.raw_panel.toPandas().sort_values(["city", "date"])
    raw["prev"] = raw.groupby("city")["tp"].shift(1) * 1000.0
    merged = df.merge(raw[["city", "date", "prev"]], on=["city", "date"])
    np.testing.assert_allclose(merged["rainfall_prev_1"], merged["prev"])
    assert len(merged) == len(raw) - 6 * raw["city"].nunique()
