"""Ranks, percentiles, nearest places and skew-safe joins against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.operators.cleaning import first_per_key, last_per_key
from skyledger.operators.geo import nearest_place, nearest_values
from skyledger.operators.ordering import exact_percentiles, positions, value_ranks
from skyledger.operators.quality import iqr_outliers, profile, spearman
from skyledger.operators.skew import attach_by_key


@pytest.fixture(scope="module")
def skewed():
    """A third of the values equal, the rest spread over several magnitudes."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(1000, 5.0), rng.lognormal(1, 2, 2000)])
    return pd.DataFrame({"x": rng.permutation(x), "y": rng.normal(0, 1, 3000).round(1)})


def test_ranks_and_percentiles(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    for c, ranges in (("x", 1), ("x", 16), ("y", 16), ("x", 300)):
        ranks = value_ranks(df, ["x", "y"], ranges).toPandas()
        got = ranks[ranks.name == c].set_index("value").sort_index()
        expected = skewed[c].rank(method="min").groupby(skewed[c]).first() - 1
        assert list(got["below"]) == list(expected)
        assert set(got["total"]) == {3000}
    probs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0]
    got = exact_percentiles(df, ["x", "y"], probs).toPandas().sort_values(["name", "p"])
    expected = [skewed[c].quantile(p) for c in ("x", "y") for p in probs]
    np.testing.assert_allclose(got["value"], expected, rtol=1e-12)


def test_spearman_and_profile(spark, skewed):
    df = spark.createDataFrame(skewed)
    assert spearman(df, ["x", "y"]).head()["spearman"] == pytest.approx(skewed.corr(method="spearman").loc["x", "y"])
    got = profile(df, ["x"]).head()
    assert got["skew"] == pytest.approx(skewed["x"].skew())
    assert got["p90"] == pytest.approx(skewed["x"].quantile(0.9))
    q1, q3 = skewed["x"].quantile([0.25, 0.75])
    fence = q3 + 3 * (q3 - q1)
    out = iqr_outliers(df, "x").head()
    assert (out["fence"], out["outliers"]) == (pytest.approx(fence), int((skewed["x"] > fence).sum()))


def test_positions_with_one_large_group(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": ["big"] * 900 + ["small"] * 30 + ["one"], "s": rng.integers(0, 4, 931), "id": range(931)})
    got = positions(spark.createDataFrame(pdf).repartition(7), ["k"], [F.desc("s"), F.asc("id")]).toPandas()
    pdf = pdf.sort_values(["k", "s", "id"], ascending=[True, False, True])
    pdf["position"] = pdf.groupby("k").cumcount() + 1
    merged = got.merge(pdf, on="id")
    assert list(merged["position_x"]) == list(merged["position_y"])
    assert len(merged) == 931


@pytest.mark.parametrize("small", [0, 10_000])
def test_nearest_place_both_ways(spark, small):
    rng = np.random.default_rng(11)
    # A third of the places in one tiny spot, the rest anywhere; some points far from all.
    spot = np.column_stack([28.6 + rng.random(100) / 500, 77.2 + rng.random(100) / 500])
    wide = np.column_stack([rng.uniform(-80, 80, 200), rng.uniform(-179, 179, 200)])
    places = np.round(np.vstack([spot, wide]), 4)
    points = np.round(np.vstack([spot[:20] + 0.001, wide[:40] + 3, [[0.0, 0.0], [89.9, 179.9], [28.6, 77.2]]]), 4)
    p = spark.createDataFrame([(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(places)],
                              "city string, latitude double, longitude double")
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)],
                              "id int, latitude double, longitude double")
    got = {r["id"]: r["nearest"] for r in nearest_place(q, p, small=small).collect()}
    for i, (a, b) in enumerate(points):
        d = (places[:, 0] - a) ** 2 + (places[:, 1] - b) ** 2
        assert got[i] == f"p{int(d.argmin()):03d}"


@pytest.mark.parametrize("small", [0, 100])
def test_nearest_tie_takes_the_first_name(spark, small):
    places = spark.createDataFrame([("z", 0.0, 1.0), ("a", 0.0, -1.0), ("m", 0.0, 1.0)], "city string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id int, latitude double, longitude double")
    got = {r["id"]: r["nearest"] for r in nearest_place(points, places, small=small).collect()}
    assert got == {1: "a", 2: None}


def test_nearest_grid_line_halfway_takes_the_larger(spark):
    axis = spark.createDataFrame([(10.0,), (11.0,), (12.0,)], "value double")
    points = spark.createDataFrame([(9.0,), (10.4,), (10.5,), (11.51,), (20.0,)], "v double")
    got = {r["v"]: r["g"] for r in nearest_values(points, "v", axis, "g").collect()}
    assert got == {9.0: 10.0, 10.4: 10.0, 10.5: 11.0, 11.51: 12.0, 20.0: 12.0}


def test_nearest_place_on_wide_axes(spark):
    """Coordinates in metres: the cells start as wide as the places spread."""
    rng = np.random.default_rng(4)
    xy, at = rng.integers(-10**6, 10**6, (60, 2)).astype(float), rng.integers(-10**6, 10**6, (25, 2)).astype(float)
    places = spark.createDataFrame([(f"p{i:02}", *map(float, p)) for i, p in enumerate(xy)], "city string, latitude double, longitude double")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id int, latitude double, longitude double")
    got = {r["id"]: r["nearest"] for r in nearest_place(points, places, small=0).collect()}
    assert got == {i: f"p{int(((xy - p) ** 2).sum(axis=1).argmin()):02}" for i, p in enumerate(at)}


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_hot_keys_change_nothing(spark, hot_rows):
    rows = spark.createDataFrame([("hot", i) for i in range(100)] + [("b", 100), (None, 101), ("c", 102)], "k string, i int")
    lookup = spark.createDataFrame([("hot", 1.0, 100), ("b", 2.0, 1)], "k string, v double, n long")
    got = sorted((r["i"], r["v"]) for r in attach_by_key(rows, lookup, ["k"], "n", hot_rows).collect())
    assert got == [(i, 1.0) for i in range(100)] + [(100, 2.0), (101, None), (102, None)]


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([(" A ", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, id int, v string")
    assert {r["id"] for r in first_per_key(df, [F.lower(F.trim("k"))], ["id"]).collect()} == {1, 2}
    assert {r["v"] for r in last_per_key(df, ["k"], ["id"]).collect()} == {"x", "y", "z"}
