"""Lookup, rules, scenarios and rankings on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.models.standin import class_probabilities
from skyledger.operators import carry as CY
from skyledger.operators import lookup as L
from skyledger.operators import rankings as RK
from skyledger.operators import rules as R
from skyledger.operators import scenario as S

HISTORY = "city string, year int, month int, temperature_c double"


@pytest.fixture(scope="module")
def history(spark):
    rows = [("a", 2020, 6, 1.0), ("a", 2023, 6, 2.0), ("a", 2023, 12, 3.0), ("a", 2024, 2, 4.0), ("b", 2020, 1, 5.0)]
    return spark.createDataFrame(rows, HISTORY)


@pytest.mark.parametrize(
    "city, year, month, expected",
    [
        ("a", 2020, 6, (2020, 6, 0, 1.0)),
        ("a", 2030, 6, (2023, 6, 1, 2.0)),
        ("a", 2010, 6, (2023, 6, 1, 2.0)),
        ("a", 2024, 1, (2023, 12, 2, 3.0)),  # one month before and one after: the earlier one
        ("a", 2024, 3, (2024, 2, 2, 4.0)),
        ("a", 2000, 1, (2020, 6, 2, 1.0)),
        ("b", 2050, 12, (2020, 1, 2, 5.0)),
        ("nowhere", 2024, 6, (None, None, None, None)),
    ],
)
def test_history_fallback(spark, history, city, year, month, expected):
    asked = spark.createDataFrame([(city, year, month)] * 2, "city string, year int, month int")
    got = L.with_history(asked, history).collect()
    assert [(r["record_year"], r["record_month"], r["match"], r["temperature_c"]) for r in got] == [expected] * 2


def test_drift_only_after_the_last_record(spark):
    rows = [(2030, 2024, 30.0, 100.0, 0.2), (2020, 2024, 30.0, 100.0, 0.2), (2024, None, 30.0, 100.0, 0.2)]
    df = spark.createDataFrame(rows, "year int, record_year int, temperature_c double, rainfall_mm double, soil_moisture double")
    got = [tuple(r)[2:5] for r in L.drift(df).collect()]
    assert got[0] == pytest.approx((30.24, 101.2, 0.1988))
    assert got[1] == got[2] == (30.0, 100.0, 0.2)


def test_state_row_overrides_defaults_and_month_clamp(spark, panel):
    city = panel.select("city", "climate_zone").head()
    rows = [(1, city[0], city[1], "2000", "13", 99.0), (2, city[0], city[1], None, "x", None)]
    requests = spark.createDataFrame(rows, "id int, city string, climate_zone string, year string, month string, t double")
    got = {r["id"]: r for r in L.state_rows(requests, panel, given={"temperature_c": "t"}).collect()}
    assert (got[1]["month"], got[1]["temperature_c"]) == (12, 99.0)
    assert (got[2]["year"], got[2]["month"]) == (2024, 6)
    history = panel.filter(F.col("city") == city[0]).orderBy("date").toPandas()
    at = history.index[(history.year == got[2]["record_year"]) & (history.month == 6)][0]
    assert got[2]["temperature_c"] != 99.0
    assert got[2]["rolling_sm_3m"] == pytest.approx(history.soil_moisture[:at].tail(3).mean() * (1 - 0.001 * got[2]["years_ahead"]))
    # Long after the last row: the record's month answers, with its own streaks.
    assert got[2]["carried_age"] is None and got[2]["er_cumulative_rain_3m"] == pytest.approx(history.rainfall_mm[:at].tail(3).sum())
    assert got[1]["lag1_climatology"] == pytest.approx(history.rainfall_prev_1[history.month == 12].mean()) and got[1]["rain_climo_mean"] > 0


def test_as_of_takes_the_last_row_and_never_a_later_one(spark):
    rows = [("a", 2020, 1, 1.0), ("a", 2020, 3, 3.0), ("a", 2021, 1, None), ("b", 2020, 6, 6.0)]
    history = spark.createDataFrame(rows, "city string, year int, month int, v double")
    months = [("a", y, m) for y in (2019, 2020, 2021, 2022) for m in range(1, 13)] * 2 + [("c", 2020, 1)]
    got = CY.as_of(spark.createDataFrame(months, "city string, year int, month int"), history, ["v"], max_age=6).collect()
    assert len(got) == len(set(months))
    for r in got:
        now = r["year"] * 12 + r["month"]
        past = [(y * 12 + m, v) for c, y, m, v in rows if c == r["city"] and y * 12 + m <= now]
        known = max(past, key=lambda p: p[0]) if past else None
        fresh = known and now - known[0] <= 6
        assert (r["v"], r["carried_age"]) == ((known[1], now - known[0]) if fresh else (None, None))


def test_state_rows_follow_their_history(spark):
    """Two cities with the same weather in the months asked for, but a dry and a wet past."""
    rows = []
    for city, past in (("dry", 1.0), ("wet", 90.0)):
        for k in range(48):
            y, m = 2000 + k // 12, k % 12 + 1
            rain = past if k in range(40, 46) else 40.0
            rows.append((city, "Z", 20.0, 80.0, date(y, m, 1), y, m, 25.0, rain, 0.01 if past < 5 and k >= 40 else 0.3, -0.001, 0.001, *[20.0] * 9))
    schema = "city string, climate_zone string, latitude double, longitude double, date date, year int, month int, temperature_c double, rainfall_mm double, soil_moisture double, evabs double, sro double, " + ", ".join(
        f"{c} double" for c in ("temperature_prev_1", "temperature_prev_3", "rainfall_prev_1", "rainfall_prev_3", "soil_moisture_prev_1", "rolling_temp_3m", "rolling_rainfall_3m", "rolling_temp_6m", "rolling_rainfall_6m"))
    panel = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(c, "Z", y, m) for c in ("dry", "wet") for y, m in ((2003, 11), (2004, 3), (2005, 3))], "city string, climate_zone string, year int, month int")
    got = {(r["city"], r["year"], r["month"]): r for r in L.state_rows(asked, panel).collect()}
    # Months 40 to 45 are dry: in month 46 (November 2003) the run is six rows long; month 47 is the last known row.
    assert [got["dry", 2003, 11][c] for c in ("dry_month_streak", "carried_age")] == [6, 0]
    assert got["wet", 2003, 11]["dry_month_streak"] == 0
    assert got["dry", 2004, 3]["carried_age"] == 3
    assert got["dry", 2004, 3]["cumulative_deficit_6m"] == pytest.approx(5 * (1.0 - 30.25))
    assert got["wet", 2004, 3]["cumulative_deficit_6m"] == pytest.approx(5 * (90.0 - 52.5))
    # Over a year later nothing recent is known: the record of March 2003 answers.
    assert got["dry", 2005, 3]["carried_age"] is None and got["dry", 2005, 3]["dry_month_streak"] == 0


def test_source_precedence(spark):
    state = spark.createDataFrame(
        [(i, 2024, 6, 30.0, 10.0, 0.2, u) for i, u in ((1, True), (2, True), (3, True), (4, False))],
        "district_id long, year int, month int, temperature_c double, rainfall_mm double, soil_moisture double, use_live boolean",
    )
    live = spark.createDataFrame(
        [(1, 41.0, None, 20.0, 0.5, "2024-06-02T10:00"), (1, 40.0, 1.0, 1.0, 0.1, "2024-06-01T10:00"), (2, None, 7.0, 20.0, 0.5, "t"), (4, 50.0, 1.0, 1.0, 1.0, "t")],
        "district_id long, temperature double, rainfall double, humidity double, soil_moisture double, observed_at string",
    )
    seen = spark.createDataFrame(
        [(1, 2, 22.0, 3.0, 60.0, date(2024, 5, 1)), (2, 2, 23.0, 4.0, 61.0, date(2024, 5, 2)), (3, 2, 1.0, 1.0, 1.0, date(2023, 5, 2))],
        "id long, district_id long, temperature double, rainfall double, humidity double, observation_date date",
    )
    got = {r["district_id"]: r for r in L.resolve_sources(state, live, seen).collect()}
    pick = lambda i: tuple(got[i][c] for c in ("source", "confidence_source", "temperature_c", "rainfall_mm", "soil_moisture", "humidity", "last_updated"))
    assert pick(1) == ("LIVE", 1.0, 41.0, 10.0, 0.5, 20.0, "2024-06-02T10:00")
    assert pick(2) == ("DATABASE", 0.8, 23.0, 4.0, 0.2, 61.0, "2024-05-02")
    assert pick(3) == pick(4) == ("HISTORICAL", 0.5, 30.0, 10.0, 0.2, None, "2024-06-01")


@pytest.mark.parametrize(
    "inputs, score",
    [
        ((0.0, 0.0, 0.0, 0.0, 0.0), 0.0),
        ((1.0, 100.0, 1.0, 1.0, 100.0), 100.0),
        ((0.5, 0.0, 0.0, 0.0, 0.0), 12.5),
        ((5.0, 500.0, 5.0, 5.0, 500.0), 100.0),
        ((-5.0, -500.0, 0.0, 0.0, 0.0), 0.0),
    ],
)
def test_hotspot_score(spark, inputs, score):
    names = "drought_severity_score, heatwave_severity, water_stress_index, crop_stress_index, extreme_rainfall_severity"
    df = spark.createDataFrame([inputs], ", ".join(f"{n.strip()} double" for n in names.split(",")))
    assert S.with_hotspot_score(df).head()["hotspot_score"] == score


@pytest.mark.parametrize(
    "score, code, documented",
    [(9.99, "Low", "Low"), (24.9, "High", "Low"), (25.0, "High", "Moderate"), (50.0, "Critical", "High"), (75.0, "Critical", "Critical")],
)
def test_both_band_sets(spark, score, code, documented):
    df = spark.createDataFrame([(score,)], "s double")
    got = df.select(X.bands("s", K.RISK_BANDS, "Low"), X.bands("s", K.RISK_BANDS_DOCUMENTED, "Low")).head()
    assert tuple(got) == (code, documented)


def test_probabilities_add_up_and_classes_follow(spark):
    df = spark.createDataFrame([(i / 20,) for i in range(21)], "s double").withColumn("p", class_probabilities("s"))
    got = df.withColumns({"total": F.aggregate("p", F.lit(0.0), lambda a, x: a + x), "c": R.classify("p")}).collect()
    assert all(r["total"] == pytest.approx(1.0) for r in got)
    order = [K.RISK_ORDINAL[r["c"]] for r in got]
    assert order == sorted(order) and order[0] == 0 and order[-1] == 3


def test_warnings_and_tiers(spark):
    rows = [([0.1, 0.1, 0.4, 0.4], 0.0, 0.0), ([0.2, 0.6, 0.2, 0.0], 0.0, -6.0), ([1.0, 0.0, 0.0, 0.0], 0.0, 0.0), ([0.45, 0.25, 0.3, 0.0], 0.0, 0.0)]
    df = spark.createDataFrame(rows, "drought_probs array<double>, drought_momentum double, drought_trend double")
    got = [(r["drought_warning_level"], r["drought_warning"], r["drought_message"]) for r in R.drought_warning(df).collect()]
    assert got[0] == ("Critical", True, "Elevated Extreme Drought probability: 40.0%.")
    assert got[1][:2] == ("Medium", True) and got[1][2].startswith("Drought severity is rapidly")
    assert got[2] == ("Low", False, "No active drought hazards detected.")
    assert got[3] == ("Medium", True, "Drought risk is building. Monitoring is advised.")
    both = spark.createDataFrame([([0.0, 0.0, 0.4, 0.6], [0.0, 0.0, 0.4, 0.6]), ([1.0, 0.0, 0.0, 0.0], [0.0, 0.6, 0.0, 0.0])],
                                 "heatwave_probs array<double>, extreme_rainfall_probs array<double>")
    got = [(r["extreme_warning_level"], r["event_type"]) for r in R.extreme_warning(both).collect()]
    assert got == [("Critical", "Compound Heat-Rainfall"), ("Medium", "Extreme Rainfall")]


def test_overall_risk_adds_for_compound_events(spark):
    rows = [(50.0, 40.0, [0.0, 0.0, 0.5, 0.5], [0.0, 0.0, 0.5, 0.5]), (50.0, 40.0, [0.0, 0.0, 0.5, 0.5], [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "heatwave_severity double, extreme_rainfall_severity double, heatwave_probs array<double>, extreme_rainfall_probs array<double>")
    got = [(r["overall_risk_score"], r["overall_risk_category"]) for r in R.overall_risk(df).collect()]
    assert got == [(59.0, "Medium"), (49.0, "Medium")]


def test_monsoon_and_confidence(spark):
    df = spark.createDataFrame([(6, 70.0, 100.0, 2035, 1.0), (7, 130.0, 100.0, 2045, None), (8, 100.0, 100.0, 2024, 1.0), (1, 1.0, 100.0, 2024, 1.0), (6, 1.0, 0.0, 2024, 1.0)],
                               "month int, p double, n double, year int, rainfall_prev_1 double")
    got = df.select(R.monsoon_status(F.col("p"), F.col("n")), R.rainfall_confidence(F.lit(5.0)), R.rainfall_confidence(F.lit(21.0))).collect()
    assert [r[0] for r in got] == ["Weak Monsoon", "Strong Monsoon", "Normal Monsoon", "Non-Monsoon Period", "Normal Monsoon"]
    assert [r[1] for r in got] == ["Medium", "Low", "High", "High", "High"]
    assert {r[2] for r in got} == {"Medium"}


@pytest.mark.parametrize(
    "frame, base, first, n",
    [("7day", date(2024, 12, 30), date(2024, 12, 30), 7), ("1month", date(2024, 12, 30), date(2025, 1, 1), 1),
     ("1year", date(2024, 1, 31), date(2024, 2, 1), 12), ("2050", date(2024, 1, 1), date(2050, 1, 1), 12)],
)
def test_target_dates(spark, frame, base, first, n):
    got = spark.createDataFrame([(base,)], "d date").select(S.target_dates(F.col("d"), frame)).head()[0]
    assert (got[0], len(got)) == (first, n)


@pytest.mark.parametrize("frame", ["2019", "2101", "soon"])
def test_unknown_timeframe(spark, frame):
    with pytest.raises(ValueError):
        S.target_dates(F.lit(date(2024, 1, 1)), frame)


def test_districts_of_one_name_count_once(spark):
    rows = [(3, " Pune", "MH", 1.0, 1.0), (1, "pune ", "mh", 1.0, 1.0), (2, "Pune", "KA", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "district_id long, district_name string, state string, latitude double, longitude double")
    assert {r["district_id"] for r in S.unique_districts(df).collect()} == {1, 2}


@pytest.fixture(scope="module")
def evaluated(spark):
    scores = {2025: {1: 50.0, 2: 50.0, 3: 12.0, 4: 5.0, 6: 15.0}, 2035: {1: 10.0, 2: 60.0, 3: 12.0, 5: 99.0, 6: 30.0}}
    rows = [(i, f"D{i}", "S", y, "baseline", s, s, s / 100, s / 100, s) for y, d in scores.items() for i, s in d.items()]
    df = spark.createDataFrame(
        rows,
        "district_id long, district_name string, state string, year int, scenario string, hotspot_score double, "
        "predicted_temperature_c double, drought_severity_score double, water_stress_index double, heatwave_severity double",
    )
    return df.withColumn("hotspot_risk_band", X.bands("hotspot_score", K.RISK_BANDS, "Low"))


def ids(df, name):
    return [r["district_id"] for r in df.filter(F.col("list_name") == name).orderBy("place").collect()]


def test_ranking_lists_break_ties_by_id(evaluated):
    got = RK.hotspot_ranking(evaluated, 2025, 3)
    assert ids(got, "top_vulnerable") == [1, 2, 6] and ids(got, "least_vulnerable") == [4, 3, 6]
    got = RK.hotspots(evaluated, 2025)
    assert ids(got, "vulnerable_hotspots") == [1, 2] and ids(got, "emerging_hotspots") == [6, 3]


def test_movement_covers_districts_of_both_years(evaluated):
    got = {r["district_id"]: (r["base_rank"], r["target_rank"], r["rank_change"]) for r in RK.movements(evaluated, 2025, 2035).collect()}
    assert got == {1: (1, 5, -4), 2: (2, 2, 0), 3: (4, 4, 0), 6: (3, 3, 0)}
    lists = RK.rank_movement(evaluated, 2025, 2035, 2)
    assert ids(lists, "most_worsened") == [2, 3] and ids(lists, "most_improved") == [1, 2]


def test_trends_and_emerging(evaluated):
    got = {r["district_id"]: r for r in RK.trend_records(evaluated, 2025, 2035).collect()}
    assert got[6]["warming_rate_per_year"] == 1.5 and got[1]["hotspot_emergence_rate"] == -4.0
    assert ids(RK.emerging(evaluated, 2025, 2035), "emerging_risks") == [6, 2, 3, 1]
    same = {r["district_id"]: r["hotspot_emergence_rate"] for r in RK.trend_records(evaluated, 2025, 2025).collect()}
    assert set(same.values()) == {0.0}


def test_profile_by_part_of_the_name(evaluated):
    assert {r["district_id"] for r in RK.district_profile(evaluated, "d").collect()} == {1}
    assert RK.district_profile(evaluated, "nobody").count() == 0


def test_state_record_nests_everything(tables):
    from skyledger.plans.catalog import _chained

    record = S.state_record(_chained(tables)).head().asDict(recursive=True)
    assert set(record["drought_prediction"]["drought_category"].split()) <= set(K.RISK_CLASSES)
    assert len(record["drivers"]["drought_drivers"]) in (1, 2, 3)
    assert record["heat_impact"]["heat_recommendations"]


def test_histories_are_built_for_the_cities_asked_for(spark, tables, monkeypatch):
    """Values equal those of all cities built together, and no other city's history is built."""
    panel = tables.panel
    cities = panel.select("city").distinct().orderBy("city").limit(2)
    names = [r["city"] for r in cities.collect()]
    whole = CY.carried_history(panel).filter(F.col("city").isin(*names))
    some = CY.carried_history(panel, cities=cities)
    assert some.count() == whole.count() > 0 and some.exceptAll(whole).isEmpty()

    built, build = [], CY.carried_history
    monkeypatch.setattr(CY, "carried_history", lambda *a, **k: built.append(build(*a, **k)) or built[-1])
    asked = spark.createDataFrame([(n, "ASIA", 2000, 6) for n in names], "city string, climate_zone string, year int, month int")
    assert L.state_rows(asked, panel).count() == 2
    assert sorted(r["city"] for r in built[0].select("city").distinct().collect()) == names


def test_scored_rows_are_not_stored_whole(tables):
    from skyledger.plans import catalog

    assert not any("/chained-" in f for f in catalog._chained(tables).inputFiles())
