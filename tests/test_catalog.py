"""The registry, and a sample of queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registry
from skyledger.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL
from tools.check import TABLES, differing, text

SAMPLE = [
    "monsoon_calendar", "rain_momentum", "district_summary", "period_trend_week", "top_driest", "gap_fill", "class_balance",
    "iqr_outliers", "payload_explode", "import_summary", "ingest_summary", "grid_nearest", "history_fallback",
    "resolve_source", "rank_movement", "stream_ingest", "stream_trend", "confident_errors",
    "scenario_water", "simulation_records",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    # The optional queries of training data are not counted here.
    assert set(ORACLES) <= set(QUERIES) <= set(registry.queries())
    trained = {
        "train_classifiers", "train_regressors", "batch_score", "train_hazards", "predict_temperature", "predict_rainfall",
        "predict_heatwave", "predict_extreme_rainfall", "search_drought", "feature_importance", "fitted_hotspots",
    }
    assert set(QUERIES) - set(ORACLES) == trained | {"state_record"}


def test_every_sql_twin_parses(db):
    for sql in registry.oracle_sql().values():
        db.sql(f"EXPLAIN {sql}")


def test_entry(spark):
    df = registry.entry(spark)
    assert df.count() == 10 and df.columns == ["city", "date", "rainfall_anomaly", "z", "run"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    want = db.sql(registry.oracle_sql()[name]).df()
    assert differing(text(got), text(want)) == ""
    assert len(got)
