"""Baselines fitted on earlier years only, and correlations over many columns with gaps."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.operators import drought as DR
from skyledger.operators import extreme as EX
from skyledger.operators import quality as Q
from skyledger.operators import rainfall as RF
from skyledger.operators.carry import carried_history
from skyledger.operators import fitted as FT
from skyledger.operators.fitted import apply_drought, fit_drought
from skyledger.operators.panel import base_panel

UNTIL = 1999
BUNDLES = {
    "drought": DR.drought_features,
    "extreme": EX.extreme_features,
    "rainfall": lambda df, until_year=None: RF.rainfall_dataset(df, ["ASIA", "EUROPE"], until_year),
    "carried": carried_history,
}
MEASURES = ("temperature_c", "rainfall_mm", "soil_moisture", "evabs", "sro")


def changed_after(df, year, columns):
    late = F.col("year") > year
    return df.withColumns({c: F.when(late, F.col(c) * 3.0 + 1.0).otherwise(F.col(c)) for c in columns})


def early(df):
    rows = df.filter(F.col("year") <= UNTIL).drop("target_rainfall_next_month", "target_temperature_next_month").toPandas()
    keys = [c for c in ("city", "latitude", "longitude", "year", "month") if c in rows]
    return rows.sort_values(keys).reset_index(drop=True)


@pytest.mark.parametrize("name", BUNDLES)
def test_later_years_leave_earlier_rows_alone(panel, name):
    other = changed_after(panel, UNTIL, MEASURES)
    a, b = (early(BUNDLES[name](df, until_year=UNTIL)) for df in (panel, other))
    pd.testing.assert_frame_equal(a, b, check_like=True)
    # Without the year the later rows do leak into the normals.
    assert not early(BUNDLES[name](panel)).equals(early(BUNDLES[name](other)))


def test_later_years_leave_earlier_labels_alone(tables):
    raw = tables.raw_panel.withColumn("year", F.year("date"))
    other = changed_after(raw, UNTIL, ("t2m", "tp", "swvl1", "swvl2"))
    a, b = (early(base_panel(df.drop("year"), UNTIL)) for df in (raw, other))
    # The last rows of the year look ahead to the next one for their targets only.
    pd.testing.assert_frame_equal(a, b)


def gappy(seed, columns, rows=120):
    rng = random.Random(seed)
    frame = pd.DataFrame({c: [float(rng.randint(0, 9)) for _ in range(rows)] for c in columns})
    frame["b"] = frame["a"] * 2 + [rng.random() for _ in range(rows)]
    for c in columns[2:]:
        frame[c] = frame[c] + rng.random() * frame["a"]
    return frame, rng


def test_correlations_of_columns_with_shared_and_own_gaps(spark):
    columns = list("abcdefg")
    frame, rng = gappy(3, columns)
    shared = [rng.random() < 0.3 for _ in range(len(frame))]
    for c in "cd":
        frame.loc[shared, c] = None
    for c in "ef":
        frame.loc[[rng.random() < 0.2 for _ in range(len(frame))], c] = None
    frame["g"] = np.nan
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    plain = frame.corr()
    got = {(r.left, r.right): r.abs_corr for r in Q.collinear_pairs(df, columns, -1.0).collect()}
    for a, b in combinations(columns[:-1], 2):
        assert got[a, b] == pytest.approx(abs(plain.loc[a, b]), abs=1e-9)
    assert not [k for k in got if "g" in k]
    ranked = {(r.left, r.right): r.spearman for r in Q.spearman(df, columns).collect()}
    assert set(ranked) == set(combinations(columns, 2))
    for a, b in combinations(columns[:-1], 2):
        both = frame[[a, b]].dropna().rank()
        assert ranked[a, b] == pytest.approx(both[a].corr(both[b]), abs=1e-9)
    assert all(v is None for k, v in ranked.items() if "g" in k)


def test_work_grows_with_columns_and_not_with_pairs(spark, monkeypatch):
    columns = [f"c{i}" for i in range(70)]
    frame, _ = gappy(5, ["a", "b", *columns])
    df = spark.createDataFrame(frame)
    # Two blocks of columns; every pair once.
    got = {(r.left, r.right): r.abs_corr for r in Q.collinear_pairs(df, columns, -1.0).collect()}
    plain = frame[columns].corr().abs()
    assert len(got) == 70 * 69 // 2 and all(got[p] == pytest.approx(plain.loc[p], abs=1e-9) for p in got)
    seen = []
    ranks = Q.value_ranks
    monkeypatch.setattr(Q, "value_ranks", lambda d, names: seen.append(len(names)) or ranks(d, names))
    Q.spearman(df, columns[:4]).collect()
    Q.spearman(df, columns[:20]).collect()
    assert seen == [4, 20]


@pytest.mark.parametrize("name", ["drought", "extreme", "rainfall"])
def test_stored_baselines_equal_a_fit_in_place(panel, tmp_path, name):
    path = str(tmp_path / "fit")
    fit, apply = {
        "drought": (FT.fit_drought, FT.apply_drought),
        "extreme": (FT.fit_extreme, FT.apply_extreme),
        "rainfall": (FT.fit_rainfall, lambda df, p: FT.apply_rainfall(df, p, ["ASIA", "EUROPE"])),
    }[name]
    # A panel that lacks the later rows gives the same fit; a second fit replaces the first.
    fit(panel.filter(F.col("year") <= 1995), path)
    fit(panel.filter(F.col("year") <= UNTIL), path)
    keys = ["city", "year", "month"]
    got = apply(panel, path).toPandas().sort_values(keys).reset_index(drop=True)
    want = BUNDLES[name](panel, until_year=UNTIL).toPandas().sort_values(keys).reset_index(drop=True)
    assert len(got) and set(got.columns) == set(want.columns)
    pd.testing.assert_frame_equal(got, want, check_like=True, check_exact=False, rtol=1e-9, atol=1e-9, check_dtype=False)


def test_unseen_places_have_no_extreme_score_and_no_training_row(panel, tmp_path):
    heat, rain = str(tmp_path / "heat"), str(tmp_path / "rain")
    some = panel.select("city").distinct().orderBy("city").limit(2).toPandas()["city"].tolist()
    both, known = panel.filter(F.col("city").isin(some)), panel.filter(F.col("city") == some[0])
    FT.fit_extreme(known, heat)
    FT.fit_rainfall(known, rain)
    counts = [F.count(c).alias(c) for c in (*FT.EXTREME_SCORES.values(), "heatwave_category", "extreme_rainfall_category")]
    got = {r.city: r for r in FT.apply_extreme(both, heat).groupBy("city").agg(F.count("*").alias("n"), *counts).collect()}
    assert set(got[some[0]][1:]) == {got[some[0]].n} and set(got[some[1]][2:]) == {0} and got[some[1]].n > 0
    assert {r.city for r in FT.apply_rainfall(both, rain).select("city").distinct().collect()} == {some[0]}
    assert FT.apply_extreme(panel.limit(0), heat).count() == FT.apply_rainfall(panel.limit(0), rain).count() == 0


def test_unseen_places_get_no_score(panel, tmp_path):
    path = str(tmp_path / "fit")
    some = panel.select("city").distinct().orderBy("city").limit(3).toPandas()["city"].tolist()
    fit_drought(panel.filter(F.col("city").isin(some[:2])), path)
    got = {r.city: r for r in apply_drought(panel.filter(F.col("city").isin(some)), path).groupBy("city").agg(
        F.count("drought_severity_score").alias("scores"), F.count("drought_category").alias("labels"), F.count("*").alias("rows")).collect()}
    assert got[some[2]].scores == got[some[2]].labels == 0 < got[some[2]].rows
    assert all(got[c].scores == got[c].labels == got[c].rows for c in some[:2])
    assert apply_drought(panel.limit(0), path).count() == 0
