"""Scenarios with five changes, and nested what-if records stored by run."""

import json

import pytest
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.operators import scenario as S
from skyledger.operators import serving as V
from skyledger.operators import simulation as SM
from skyledger.operators.lookup import state_rows
from skyledger.session import materialize


def test_scenarios_take_up_to_five_changes(spark):
    one = spark.createDataFrame([(1,)], "district_id long")
    got = {r.scenario: tuple(r[d] for d in V.DELTAS) for r in S.scenario_grid(one, {"a": (1,), "b": (1, 2, 3, 4, 5)}).collect()}
    assert got == {"a": (1.0, 0.0, 0.0, 0.0, 0.0), "b": (1.0, 2.0, 3.0, 4.0, 5.0)}
    with pytest.raises(ValueError):
        S.scenario_grid(one, {"c": (1, 2, 3, 4, 5, 6)})


@pytest.fixture(scope="module")
def compared(spark, tables):
    placed = S.for_periods(S.place_requests(tables.districts.where("district_id <= 20"), tables.panel), [2000], 6)
    scored = S.chain(state_rows(S.scenario_grid(placed, K.WATER_SCENARIOS), tables.panel), local=False)
    humidity = spark.createDataFrame([(1, 80.0)], "district_id long, average_humidity double")
    return materialize(S.compare_scenarios(scored, humidity), "compared")


def test_records_hold_both_states_and_the_changes(spark, compared):
    counts = spark.createDataFrame([(1, 7)], "district_id long, observation_count long")
    rows = SM.with_json(SM.simulation_records(compared, counts)).collect()
    assert len(rows) == compared.count() > 0
    plain = {(r.district_id, r.scenario): r for r in compared.collect()}
    for r in rows:
        result, want = json.loads(r.result_json), plain[r.district_id, r.scenario]
        assert result["baseline"]["observation_count"] == (7 if r.district_id == 1 else 0)
        assert result["baseline"]["humidity"] == (80.0 if r.district_id == 1 else 60.0)
        assert result["scenario_state"]["temperature"] == pytest.approx(want.scenario_state.temperature)
        assert result["projections"]["humidity"] == want.scenario_humidity
        assert result["impacts"]["flood_risk"] == want.scenario_state.extreme_rainfall_category
        assert result["risk_change"] == want.risk_change
        assert (r.temperature_delta, r.runoff_delta) == (K.WATER_SCENARIOS[r.scenario][0], K.WATER_SCENARIOS[r.scenario][4])


def test_runs_are_kept_replaced_and_read_back(spark, compared, tmp_path):
    counts = spark.createDataFrame([], "district_id long, observation_count long")
    records, path = materialize(SM.simulation_records(compared, counts), "records"), str(tmp_path / "saved")
    n = records.count()
    SM.store_simulations(records, path, "007")
    SM.store_simulations(records.where("scenario = 'runoff_gone'").withColumn("runoff_delta", F.lit(-99.0)), path, "008")
    SM.store_simulations(records, path, "007")
    stored = SM.read_simulations(spark, path)
    assert {r["run"]: r["count"] for r in stored.groupBy("run").count().collect()} == {"007": n, "008": n // 4}
    assert stored.drop("run").where("runoff_delta <> -99").exceptAll(records).count() == 0
    last = SM.latest_simulations(stored)
    assert last.count() == n
    assert {(r.scenario, r.run) for r in last.collect()} == {(s, "008" if s == "runoff_gone" else "007") for s in K.WATER_SCENARIOS if s != "baseline"}
    with pytest.raises(ValueError):
        SM.store_simulations(records, path, "a/b")
