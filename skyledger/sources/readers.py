"""Readers with fixed schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.operators.geo import nearest_values
from skyledger.sources import schemas as S


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A table in Parquet, ORC, JSON or CSV (with header)."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_panel(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The monthly panel; NaN and infinities become NULL."""
    return X.finite_columns(read_table(spark, path, S.PANEL, fmt))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of city to coordinates and zone, as rows."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.map_entries(F.from_json("value", S.LOCATIONS)))
    return text.select(entries.alias("e")).select(
        F.col("e.key").alias("city"),
        F.col("e.value.lat").alias("latitude"),
        F.col("e.value.lon").alias("longitude"),
        F.col("e.value.climate_zone").alias("climate_zone"),
    )


def extract_cells(grid: DataFrame, locations: DataFrame) -> DataFrame:
    """Raw city panel: every time step of the grid cell nearest to each location.

    Latitude and longitude are matched independently; halfway between two grid
    lines the larger one counts.
    """
    lats = grid.select(F.col("latitude").alias("value")).distinct()
    lons = grid.select(F.col("longitude").alias("value")).distinct()
    placed = nearest_values(locations, "latitude", lats, "__lat")
    placed = nearest_values(placed, "longitude", lons, "__lon")
    cells = grid.withColumnsRenamed({"latitude": "__lat", "longitude": "__lon", "valid_time": "date"})
    return placed.join(cells, ["__lat", "__lon"]).select(*[f.name for f in S.RAW_PANEL.fields])


def district_dimension(
    panel: DataFrame, states: Mapping[str, str], default_state: str = "India"
) -> DataFrame:
    """One district per city with its first coordinates and its state."""
    lookup = F.create_map(*[F.lit(x) for pair in states.items() for x in pair]) if states else None
    state: Column = F.try_element_at(lookup, F.col("city")) if lookup is not None else F.lit(None)
    first = F.min_by(F.struct("latitude", "longitude"), F.col("date"))
    return (
        panel.groupBy("city")
        .agg(first.alias("f"))
        .select(
            F.col("city").alias("district_name"),
            F.coalesce(state, F.lit(default_state)).alias("state"),
            "f.latitude",
            "f.longitude",
        )
    )


def page_of(df: DataFrame, key: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of a table in key order."""
    return df.orderBy(key).offset(skip).limit(limit)


def daily_rows(payloads: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Observation rows from daily weather payloads (column ``payload``: JSON text).

    The parallel arrays are matched by position; a missing or short array takes
    the default measure. Days from ``as_of`` on are left out, and so are days
    that are not dates; :func:`failed_payloads` reports those.
    """
    daily = F.col("p.daily")
    defaults = K.INGEST_DEFAULTS

    def at(field: str, name: str) -> Column:
        return F.coalesce(F.get(daily[field], F.col("i")), F.lit(defaults[name])).alias(name)

    rows = (
        payloads.withColumn("p", F.from_json("payload", S.DAILY_PAYLOAD))
        .select("*", F.posexplode(daily["time"]).alias("i", "day"))
        .select(
            "district_id",
            F.col("i").alias("day_index"),
            F.try_to_timestamp(F.col("day"), F.lit("yyyy-MM-dd")).cast("date").alias("observation_date"),
            at("rain_sum", "rainfall"),
            at("temperature_2m_max", "temperature"),
            at("relative_humidity_2m_mean", "humidity"),
        )
        .filter(F.col("observation_date").isNotNull())
    )
    return rows if as_of is None else rows.filter(F.col("observation_date") < as_of)


def failed_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads that :func:`daily_rows` cannot read in full: district_id, failed_days, error.

    Without a list of days the whole payload fails and ``failed_days`` is 0.
    """
    days = F.from_json("payload", S.DAILY_PAYLOAD)["daily"]["time"]
    bad = F.size(F.filter("days", lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNull()))
    error = F.when(F.isnull("days"), F.lit("no days")).when(F.col("failed_days") > 0, F.lit("not a date"))
    read = payloads.select("district_id", days.alias("days")).withColumn("failed_days", F.coalesce(F.when(F.col("days").isNotNull(), bad), F.lit(0)).cast("long"))
    return read.select("district_id", "failed_days", error.alias("error")).filter(F.col("error").isNotNull())


def live_rows(payloads: DataFrame) -> DataFrame:
    """Current conditions from live payloads (column ``payload``: JSON text); other columns are kept."""
    current = F.col("p.current")
    return payloads.withColumn("p", F.from_json("payload", S.LIVE_PAYLOAD)).select(
        *[c for c in payloads.columns if c != "payload"],
        current["temperature_2m"].alias("temperature"),
        current["rain"].alias("rainfall"),
        current["relative_humidity_2m"].alias("humidity"),
        current["soil_moisture_0_to_7cm"].alias("soil_moisture"),
        current["time"].alias("observed_at"),
    )
