"""Readers, sinks, validation, de-duplication, upsert and streams."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from skyledger import session
from skyledger.sources import ingest as I
from skyledger.sources import readers as RD
from skyledger.sources import schemas as S
from skyledger.streaming import jobs as ST


def test_csv_panel_round_trip(spark, panel, tmp_path):
    I.write_text(panel.coalesce(1), str(tmp_path / "csv"))
    back = RD.read_panel(spark, str(tmp_path / "csv"))
    assert back.count() == panel.count()
    assert back.exceptAll(panel.select(*back.columns)).count() == 0
    I.write_table(panel, str(tmp_path / "table"))
    assert (tmp_path / "table" / "year=1997").exists()
    plan = spark.read.parquet(str(tmp_path / "table")).filter("year = 1997").select("city")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_locations_map(spark, tmp_path):
    path = tmp_path / "locations.json"
    path.write_text(json.dumps({"Pune": {"lat": 18.5, "lon": 73.9, "climate_zone": "W"}, "Leh": {"lat": 34.2, "lon": 77.6, "climate_zone": "H"}}, indent=1))
    got = {tuple(r) for r in RD.read_locations(spark, str(path)).collect()}
    assert got == {("Pune", 18.5, 73.9, "W"), ("Leh", 34.2, 77.6, "H")}


def test_payload_short_null_and_future_days(spark):
    daily = {"time": ["2024-01-01", "2024-01-02", "bad", "2024-01-04"], "rain_sum": [1.5, None],
             "temperature_2m_max": [30.0, 31.0, 32.0, 33.0], "relative_humidity_2m_mean": []}
    df = spark.createDataFrame([(7, json.dumps({"daily": daily})), (8, "{}")], "district_id long, payload string")
    got = [(r["observation_date"].day, r["rainfall"], r["temperature"], r["humidity"])
           for r in RD.daily_rows(df, F.lit(date(2024, 1, 4))).collect()]
    assert got == [(1, 1.5, 30.0, 50.0), (2, 0.0, 31.0, 50.0)]
    failed = {tuple(r) for r in RD.failed_payloads(df).collect()}
    assert failed == {(7, 1, "not a date"), (8, 0, "no days")}


ROWS = [
    # row, district, rainfall, temperature, humidity, date -> status, error
    (1, "1", "1.0", "20", "50", "2024-01-01", "accepted", None),
    (2, "1", "9.0", "20", "50", "01-01-2024", "duplicate", None),
    (3, "1", "x", "20", "50", "2024/01/01", "duplicate", None),
    (4, "", "1.0", "20", "50", "2024-01-02", "failed", "missing key"),
    (5, "1", "1.0", "20", "50", None, "failed", "missing key"),
    (6, "one", "1.0", "20", "50", "2024-01-02", "failed", "district is not a number"),
    (7, "99", "1.0", "20", "50", "2024-01-02", "failed", "unknown district"),
    (8, "99", "1.0", "20", "50", "soon", "failed", "unknown district"),
    (9, "2", "1.0", "20", "50", "2024-02-30", "failed", "invalid date"),
    (10, "2", "", "20", "50", "2024-01-05", "failed", "rainfall is not a number"),
    (11, "2", "1.0", "20", "101", "2024-01-05", "failed", "humidity out of range"),
    (12, "2", "1.0", "20", "100", "05/01/2024", "accepted", None),
    (13, "2", "1.0", "20", "-1", "2024-01-05", "duplicate", None),
    (14, "2", "1.0", "20", "0", "2024-03-03", "duplicate", None),
]


@pytest.fixture
def validated(spark):
    columns = "row long, district_id string, rainfall string, temperature string, humidity string, observation_date string"
    rows = spark.createDataFrame([r[:6] for r in ROWS], columns).repartition(3)
    districts = spark.createDataFrame([(1,), (2,)], "district_id long")
    store = spark.createDataFrame([(2, date(2024, 3, 3))], "district_id long, observation_date date")
    return I.validate(rows, districts, store)


def test_import_rules(validated):
    got = sorted((r["row"], r["status"], r["error"]) for r in validated.collect())
    assert got == [(r[0], r[6], r[7]) for r in ROWS]


def test_import_outputs(validated):
    assert tuple(I.import_summary(validated).head()) == (14, 2, 4, 8)
    assert {(r["district_id"], r["observation_date"]) for r in I.accepted_rows(validated).collect()} == {
        (1, date(2024, 1, 1)), (2, date(2024, 1, 5))}
    bad = {r["row"]: json.loads(r["raw_data"]) for r in I.quarantine(validated).collect()}
    assert bad[6]["district_id"] == "one" and len(bad) == 8


def test_absent_measure_column_counts_as_zero(spark):
    rows = spark.createDataFrame([(1, "1", "5", "2024-01-01")], "row long, district_id string, rainfall string, observation_date string")
    districts = spark.createDataFrame([(1,)], "district_id long")
    store = spark.createDataFrame([], "district_id long, observation_date date")
    got = I.accepted_rows(I.validate(rows, districts, store)).head()
    assert (got["rainfall"], got["temperature"], got["humidity"]) == (5.0, 0.0, 0.0)


def test_upsert(spark):
    schema = "district_id long, forecast_date date, predicted_rainfall double"
    d = date(2024, 1, 1)
    old = spark.createDataFrame([(1, d, 1.0), (2, d, 2.0)], schema)
    new = spark.createDataFrame([(1, d, 10.0, 1), (1, d, None, 2), (3, d, 3.0, 3)], schema + ", pos int")
    got = {r["district_id"]: r["predicted_rainfall"] for r in I.upsert(new, old, ["district_id", "forecast_date"], ["pos"]).collect()}
    assert got == {1: None, 2: 2.0, 3: 3.0}


def test_ingest_summary_counts_repeats_and_stored(spark):
    d, e = date(2024, 1, 1), date(2024, 1, 2)
    rows = spark.createDataFrame([(1, d), (1, d), (1, e), (2, d)], "district_id long, observation_date date")
    store = spark.createDataFrame([(2, d)], "district_id long, observation_date date")
    got = {r[0]: tuple(r)[1:] for r in I.ingest_summary(rows, store).collect()}
    assert got == {1: (3, 2, 1), 2: (1, 0, 1), None: (4, 2, 2)}


def _land(spark, folder, name, rows):
    schema = "id long, district_id long, temperature double, observation_date date, ts timestamp"
    df = spark.createDataFrame([(i, k, t, d, datetime(d.year, d.month, d.day, 12)) for i, k, t, d in rows], schema)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return df.schema


def test_streams_pick_up_where_they_stopped(spark, tmp_path):
    land, store, latest = str(tmp_path / "land"), str(tmp_path / "store"), str(tmp_path / "latest")
    checkpoints = [str(tmp_path / c) for c in ("c1", "c2")]
    schema = _land(spark, land, "day1", [(1, 1, 10.0, date(2024, 1, 1)), (2, 1, 11.0, date(2024, 1, 1)), (3, 2, 5.0, date(2024, 1, 1))])

    def run():
        stream = lambda: ST.read_stream(spark, f"{land}/*", schema)
        ST.ingest_stream(stream(), store, checkpoint=checkpoints[0]).awaitTermination()
        ST.latest_stream(stream().drop("ts"), latest, checkpoint=checkpoints[1]).awaitTermination()
        rows = ST.read_store(spark, store, schema).collect()
        kept = {(r["district_id"], r["observation_date"].day) for r in rows}
        now = {r["district_id"]: r["temperature"] for r in ST.latest_state(spark, latest).collect()}
        return len(rows), kept, now

    assert run() == (2, {(1, 1), (2, 1)}, {1: 11.0, 2: 5.0})
    # A repeat of a stored key far behind the watermark, and a new day.
    _land(spark, land, "day2", [(4, 2, 6.0, date(2024, 3, 1)), (5, 1, 99.0, date(2024, 1, 1)), (6, 1, 12.0, date(2024, 3, 1))])
    assert run() == (4, {(1, 1), (2, 1)}, {1: 12.0, 2: 6.0})
    # Nothing new: nothing changes.
    assert run() == (4, {(1, 1), (2, 1)}, {1: 12.0, 2: 6.0})


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_schemas_are_complete():
    assert len(S.PANEL) == 28 and S.RAW_PANEL.names == [
        "city", "climate_zone", "latitude", "longitude", "date", "t2m", "tp", "swvl1", "swvl2", "evabs", "sro"]


def test_ingest_keeps_rows_of_other_runs_and_imports(spark, tmp_path):
    """Two runs with their own checkpoints and a batch import share one store."""
    from skyledger.streaming import jobs as ST

    schema = "id long, district_id long, temperature double, observation_date date, ts timestamp"
    store = str(tmp_path / "store")

    def put(name, rows):
        day = "2024-01-0{}"
        data = [(i, d, float(i), day.format(n), f"{day.format(n)} 00:00:00") for i, d, n in rows]
        df = spark.createDataFrame(data, "id long, district_id long, temperature double, day string, at string")
        df = df.selectExpr("id", "district_id", "temperature", "date(day) observation_date", "timestamp(at) ts")
        df.repartition(2).write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    imported = put("first", [(1, 10, 1)])
    spark.read.parquet(imported).write.parquet(store)
    for folder in (put("a", [(2, 10, 1), (3, 11, 1)]), put("b", [(4, 11, 1), (5, 12, 2)])):
        stream = ST.read_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_trigger=1)
        ST.ingest_stream(stream, store).awaitTermination()
    kept = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(store)
    assert sorted((r.id, r.district_id) for r in kept.collect()) == [(1, 10), (3, 11), (5, 12)]


def test_rows_are_numbered_by_file_then_line(spark, tmp_path):
    """The second file is larger, so Spark reads it first."""
    from skyledger.sources.ingest import number_rows

    (tmp_path / "part-1.csv").write_text("v\na1\na2\n")
    (tmp_path / "part-2.csv").write_text("v\n" + "".join(f"b{i:05}\n" for i in range(5000)))
    rows = number_rows(spark.read.option("header", True).csv(str(tmp_path))).orderBy("row").collect()
    values = [r.v for r in rows]
    assert values == ["a1", "a2", *(f"b{i:05}" for i in range(5000))]
    assert len({r.row for r in rows}) == 5002


def test_ingest_keeps_first_sights_however_late(spark, tmp_path):
    """Rows two months and two years behind the newest one, over several batches and a restart."""
    land, store, checkpoint = str(tmp_path / "land"), str(tmp_path / "store"), str(tmp_path / "c")
    schema = _land(spark, land, "a", [(1, 1, 1.0, date(2024, 3, 1))])

    def run():
        stream = ST.read_stream(spark, f"{land}/*", schema, files_per_trigger=1)
        ST.ingest_stream(stream, store, checkpoint=checkpoint).awaitTermination()
        return sorted(r["id"] for r in ST.read_store(spark, store, schema).collect())

    assert run() == [1]
    _land(spark, land, "b", [(2, 1, 2.0, date(2024, 1, 1))])
    _land(spark, land, "c", [(3, 2, 3.0, date(2024, 3, 2)), (4, 2, 4.0, date(2022, 1, 1)), (5, 1, 5.0, date(2024, 1, 1)), (6, 2, 6.0, date(2022, 1, 1))])
    assert run() == [1, 2, 3, 4]
    _land(spark, land, "d", [(7, 2, 7.0, date(2022, 1, 1)), (8, 3, 8.0, date(2021, 1, 1))])
    assert run() == [1, 2, 3, 4, 8]
    # A batch reads only the days that it touches.
    assert sorted(n for n in ST.folders(spark, store)) == [f"day={d}" for d in ("2021-01-01", "2022-01-01", "2024-01-01", "2024-03-01", "2024-03-02")]


def test_trend_has_every_week_and_late_rows(spark, tmp_path):
    land, path, checkpoint = str(tmp_path / "land"), str(tmp_path / "trend"), str(tmp_path / "c")
    rows = [(1, 1, 10.1, date(2024, 1, 1)), (2, 1, 0.2, date(2024, 3, 4)), (3, 2, 5.0, date(2024, 3, 10))]
    late = [(4, 1, 11.3, date(2024, 1, 7)), (5, 2, None, date(2020, 1, 1))]
    schema = _land(spark, land, "a", rows)

    def run():
        ST.trend_stream(ST.read_stream(spark, f"{land}/*", schema), path, checkpoint=checkpoint).awaitTermination()
        return {(r["district_id"], str(r["period"])): (r["average_temperature"], r["n"]) for r in ST.trend_state(spark, path).collect()}

    assert run() == {(1, "2024-01-01"): (10.1, 1), (1, "2024-03-04"): (0.2, 1), (2, "2024-03-04"): (5.0, 1)}
    _land(spark, land, "b", late)
    want = {(1, "2024-01-01"): (10.7, 2), (1, "2024-03-04"): (0.2, 1), (2, "2024-03-04"): (5.0, 1), (2, "2019-12-30"): (None, 0)}
    assert run() == want
    assert ST.compact_trend(spark, path) == 2 and run() == want


def test_versions_are_compacted_and_replays_do_not_count_twice(spark, tmp_path):
    from skyledger.streaming.store import batch_folder, read_versions

    land, path, checkpoint = str(tmp_path / "land"), str(tmp_path / "latest"), str(tmp_path / "c")
    for k in range(10):
        schema = _land(spark, land, f"day{k}", [(k * 10 + d, d, float(k), date(2024, 1, 1 + k)) for d in range(5)])
        ST.latest_stream(ST.read_stream(spark, f"{land}/*", schema).drop("ts"), path, checkpoint=checkpoint).awaitTermination()
        if k % 3 == 2:
            ST.compact_latest(spark, path)
    now = {r["district_id"]: r["temperature"] for r in ST.latest_state(spark, path).collect()}
    assert now == dict.fromkeys(range(5), 9.0)
    assert read_versions(spark, path).count() == 10  # the live keys, and one batch after the last compaction
    run = [n for n in ST.folders(spark, path) if n.startswith("run=")][0].removeprefix("run=")
    # Batch 2 is written again after it was merged.
    spark.createDataFrame([(1, 99, 99.0, date(2030, 1, 1))], "district_id long, id long, temperature double, observation_date date").write.parquet(batch_folder(path, run, 2))
    assert {r["district_id"]: r["temperature"] for r in ST.latest_state(spark, path).collect()} == now
    assert ST.compact_latest(spark, path) == 2 and ST.compact_latest(spark, path) == 1


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    import os

    path, keys = str(tmp_path / "forecasts"), ["district_id", "forecast_date"]
    schema = "district_id long, forecast_date date, predicted_rainfall double, pos int"
    frame = lambda *rows: spark.createDataFrame([(i, date(2024, 1, d), v, p) for i, d, v, p in rows], schema)
    I.upsert_table(frame((1, 1, 1.0, 0), (2, 1, 2.0, 0), (1, 2, 3.0, 0)), path, keys, ["pos"], "forecast_date")
    before = set(os.listdir(f"{path}/forecast_date=2024-01-02"))
    touched = I.upsert_table(frame((1, 1, 10.0, 1), (1, 1, 11.0, 2), (3, 1, 4.0, 0), (1, 5, 5.0, 0)), path, keys, ["pos"], "forecast_date")
    assert touched == ["forecast_date=2024-01-01", "forecast_date=2024-01-05"]
    assert set(os.listdir(f"{path}/forecast_date=2024-01-02")) == before
    got = {(r["district_id"], r["forecast_date"].day): r["predicted_rainfall"] for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1): 11.0, (2, 1): 2.0, (3, 1): 4.0, (1, 2): 3.0, (1, 5): 5.0}


def test_summary_counts_failed_payloads(spark):
    payload = lambda days: json.dumps({"daily": {"time": days, "rain_sum": [1.0] * len(days)}})
    rows = [(1, payload(["2024-01-01", "bad", None])), (1, payload(["2024-01-01"])), (2, "{}"), (3, payload(["2024-01-02"]))]
    payloads = spark.createDataFrame(rows, "district_id long, payload string")
    store = spark.createDataFrame([], "district_id long, observation_date date")
    got = {r[0]: tuple(r)[1:] for r in I.ingest_summary(RD.daily_rows(payloads), store, RD.failed_payloads(payloads)).collect()}
    assert got == {1: (2, 1, 1, 1, 2, ["not a date"]), 2: (0, 0, 0, 1, 0, ["no days"]), 3: (1, 1, 0, 0, 0, []), None: (3, 2, 1, 2, 2, ["no days", "not a date"])}


def test_ingest_summary_collects_errors_from_few_rows(spark):
    rows = spark.range(900).select(F.when(F.col("id") % 9 > 0, F.col("id") % 3).alias("district_id"), F.expr("date_add(date'2001-01-01', cast(id % 100 as int))").alias("observation_date"))
    failures = spark.range(600).select((F.col("id") % 4).alias("district_id"), (F.col("id") % 2).alias("failed_days"), F.when(F.col("id") % 5 == 0, "no days").otherwise("not a date").alias("error"))
    summary = I.ingest_summary(rows, rows.limit(0), failures)
    got = sorted(map(tuple, summary.collect()), key=str)
    assert len(got) == 6 and all(r[1] == r[2] + r[3] for r in got)
    assert (None, 900, 400, 500, 600, 300, ["no days", "not a date"]) in got
    assert (3, 0, 0, 0, 150, 150, ["no days", "not a date"]) in got
    # What reaches the collecting step was summed per district before.
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Expand") :].count("Aggregate [district_id") >= 3


def test_payloads_are_one_aggregation(tables):
    plan = tables.payloads._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
