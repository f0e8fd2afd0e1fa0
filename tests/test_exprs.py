"""Scalar expressions on hand-made values."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_clip_keeps_null_and_bounds(spark):
    rows = [(None,), (-1.0,), (0.5,), (9.0,)]
    got = values(spark, "x double", rows, X.clip("x", 0.0, 1.0), X.clip("x", low=0.0), X.clip("x", high=1.0))
    assert got == [(None, None, None), (0.0, 0.0, -1.0), (0.5, 0.5, 0.5), (1.0, 9.0, 1.0)]


def test_ratio_and_finite(spark):
    got = values(spark, "x double, y double", [(1.0, 1.0), (1.0, -1.0), (None, 1.0)], X.ratio("x", "y", 1.0))
    assert got == [(0.5,), (None,), (None,)]
    rows = [(math.nan,), (math.inf,), (-math.inf,), (1.5,), (None,)]
    assert values(spark, "x double", rows, X.finite("x")) == [(None,), (None,), (None,), (1.5,), (None,)]


def test_dates_in_four_formats(spark):
    rows = [("2024-03-05",), (" 05-03-2024 ",), ("2024/3/5",), ("05/03/2024",), ("05.03.2024",), ("2024-13-01",), ("",)]
    day = date(2024, 3, 5)
    assert [r[0] for r in values(spark, "d string", rows, X.parse_date("d"))] == [day] * 4 + [None] * 3


def test_month_and_year_from_text(spark):
    rows = [("0",), ("13",), ("7",), ("6.9",), ("June",), (None,)]
    got = values(spark, "m string", rows, X.valid_month("m"), X.as_int("m", 2024))
    assert got == [(1, 0), (12, 13), (7, 7), (6, 6), (6, 2024), (6, 2024)]


def test_seasons_cover_every_month_once(spark):
    flags = [X.season_flag("m", n) for n in K.SEASON_MONTHS]
    got = values(spark, "m int", [(m,) for m in range(1, 13)], sum(flags[1:], flags[0]), X.monsoon_phase("m"))
    assert [g[0] for g in got] == [1] * 12
    assert [g[1] for g in got] == list(K.MONSOON_PHASE)


def test_bands_and_first_match(spark):
    rows = [(9.99,), (10.0,), (20.0,), (40.0,), (None,)]
    got = values(
        spark, "x double", rows, X.bands("x", K.RISK_BANDS, "Low"), X.bands("x", K.RISK_BANDS, "Low", strict=True)
    )
    assert got == [("Low", "Low"), ("Moderate", "Low"), ("High", "Moderate"), ("Critical", "High"), ("Low", "Low")]


def test_one_hot_and_back(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string")
    df = df.withColumns(X.one_hot("k", ["a", "b"], "is_")).withColumn("back", X.one_hot_label(["a", "b"], "is_"))
    assert [tuple(r)[1:] for r in df.collect()] == [(1, 0, "a"), (0, 1, "b"), (0, 0, None), (0, 0, None)]


def test_rounding_halves(spark):
    rows = [(2.675,), (0.125,), (-0.125,), (-0.00001,), (15.649999999999999,), (None,)]
    got = [r[0] for r in values(spark, "x double", rows, X.round_to("x", 2))]
    assert got == [2.68, 0.13, -0.13, 0.0, 15.65, None]
    assert not math.copysign(1.0, got[3]) < 0


def test_texts(spark):
    rows = [("Low", "High", 0.05), ("High", "Medium", -0.1234), ("Low", "Low", 0.0)]
    got = values(spark, "a string, b string, c double", rows, X.level_change("a", "b"), X.signed_text("c"))
    assert got == [("+2 levels", "+0.05"), ("-1 level", "-0.123"), ("No change", "+0.0")]
    assert values(spark, "y int, m int", [(2025, 6)], X.month_start_text("y", "m")) == [("2025-06-01",)]


def test_top_names_order_and_fallback(spark):
    scores = lambda: [("a", F.col("x")), ("b", F.col("y")), ("c", F.lit(1.0))]
    rows = [(1.0, 2.0), (-1.0, 0.0)]
    got = values(spark, "x double, y double", rows, X.top_names(scores(), 3, "none"), X.top_names(scores()[:2], 3, "none"))
    assert got == [(["b", "a", "c"], ["b", "a"]), (["c"], ["none"])]


def test_exact_mean_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (1e9,), (None,)], "x double")
    results = {df.repartition(n).agg(X.exact_mean("x")).head()[0] for n in (1, 2, 3, 5)}
    assert results == {(0.6 + 1e9) / 4}


def test_exact_mean_keeps_small_values(spark):
    rows = [(3e-7, 0.1234567891, 5e-10), (4e-7, 0.1234567893, -5e-10), (None, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = df.agg(*[X.exact_mean(c) for c in "xyz"]).head()
    assert got[0] == pytest.approx(3.5e-7, rel=1e-9) and got[1] == pytest.approx(0.1234567892, rel=1e-14) and got[2] == 0.0
    assert df.filter("x is null").agg(X.exact_mean("x")).head()[0] is None


def test_rounding_leaves_values_below_the_half(spark):
    rows = [(0.4999995, 24.994999995, 1.005)]
    assert values(spark, "a double, b double, c double", rows, X.round_to("a", 0), X.round_to("b", 2), X.round_to("c", 2)) == [(0.0, 24.99, 1.01)]


def test_names_ignore_case_and_blanks(spark):
    rows = [(" Pune ", "pune"), ("PUNE", "Pune")]
    got = values(spark, "a string, b string", rows, X.match_key("a") == X.match_key("b"), X.contains_ignoring_case("a", "uN"))
    assert got == [(True, True), (True, True)]


@pytest.mark.parametrize("month, expected", [(4, 0.0), (7, 1.0), (10, 0.0), (1, 0.0)])
def test_monsoon_factor(spark, month, expected):
    assert values(spark, "m int", [(month,)], X.monsoon_factor("m"))[0][0] == pytest.approx(expected, abs=1e-12)
