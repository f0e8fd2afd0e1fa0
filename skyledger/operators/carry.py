"""What a state row carries from history: streaks, deficits, momentum and past variability.

:func:`carried_history` computes these once per city and month from the panel.
:func:`as_of` finds, for any target month, the last row at or before it. Values older than an age bound
are not used: a dry run that was three months long ten years ago says nothing about today.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import history as H
from skyledger.operators import baselines as B
from skyledger.operators.drought import evolution, persistence, rain_deficit, soil_features
from skyledger.session import materialize

# Values that belong to a moment and grow stale.
MOMENTARY = (
    "dry_month_streak", "deficit_streak", "low_sm_streak", "cumulative_deficit_3m", "cumulative_deficit_6m",
    "cumulative_sm_deficit_3m", "cumulative_sm_deficit_6m", "drought_acceleration", "deficit_volatility_3m",
    "consecutive_hot_months", "consecutive_wet_months", "dry_months_streak", "wet_months_streak",
    "soil_moisture_trend", "evabs_trend", "sro_trend", "hw_rolling_heat_3m", "hw_rolling_heat_6m",
    "er_rainfall_variability_3m", "er_rainfall_variability_6m", "er_cumulative_rain_3m", "er_cumulative_rain_6m",
    "er_antecedent_soil_moisture",
)
# Values that follow the season, like the measures themselves.
SEASONAL = ("rolling_sm_3m", "rolling_sm_6m", "soil_moisture_zone_anomaly")
MAX_AGE = 12  # months


def carried_history(panel: DataFrame, until_year: int | None = None, cities: DataFrame | None = None) -> DataFrame:
    """The panel with the columns of ``MOMENTARY`` and ``SEASONAL``; one row per city and month.

    All windows share the panel's hashing by city; the zone's normals are one small joined table. With ``cities``, a
    frame with the column city, only their histories are built. The normals of a zone come from all of its cities
    either way, and nothing else of a history depends on another city.
    """
    df, zoned = B.ensure_group_stats(panel, ["climate_zone", "month"], B.zone_normals(["rain", "sm"], until_year))
    if cities is not None:
        df = df.join(cities.select("city"), "city", "left_semi")
    df, added = B.ensure(H.by_entity(df), B.place_normals(["rain", "rain_lag", "sm", "temp"], until_year))
    df = evolution(persistence(soil_features(rain_deficit(df, until_year), until_year)))
    rain, sm = F.col("rainfall_mm"), F.col("soil_moisture")
    hot = F.col("temperature_c") - F.col("__temp_mean")
    unusual = B.std_or(B.place_month_std("temperature_c", until_year), zero=B.ZERO_STD["temperature_c"])
    df = df.withColumns(
        {
            "soil_moisture_zone_anomaly": F.col("sm_zone_anomaly"),
            "soil_moisture_trend": H.lagged_change("soil_moisture"),
            "evabs_trend": H.lagged_change("evabs"),
            "sro_trend": H.lagged_change("sro"),
            "__hot": hot,
            "__unusual": unusual,
            "hw_rolling_heat_3m": H.rolling(hot, 3, F.avg, 1),
            "hw_rolling_heat_6m": H.rolling(hot, 6, F.avg, 1),
            "er_rainfall_variability_3m": H.rolling_cv(rain, 3),
            "er_rainfall_variability_6m": H.rolling_cv(rain, 6),
            "er_cumulative_rain_3m": H.rolling(rain, 3, F.sum, 1),
            "er_cumulative_rain_6m": H.rolling(rain, 6, F.sum, 1),
            "er_antecedent_soil_moisture": F.coalesce(H.lag(sm), F.col("__sm_mean")),
        }
    )
    df = H.add_streaks(
        df,
        {
            "consecutive_hot_months": H.lag("__hot") > F.col("__unusual"),
            "consecutive_wet_months": H.lag(rain) > F.col("__rain_mean"),
            "dry_months_streak": H.lag(rain) < 5.0,
            "wet_months_streak": H.lag(rain) > 50.0,
        },
    )
    return df.select(*panel.columns, *[c for c in (*MOMENTARY, *SEASONAL) if c not in panel.columns])


def serial(year: Column, month: Column) -> Column:
    """Months as one number."""
    return (year * F.lit(12) + month).cast("long")


def as_of(
    requests: DataFrame, history: DataFrame, columns: Sequence[str], max_age: int = MAX_AGE, key: str = "city"
) -> DataFrame:
    """For each distinct (``key``, year, month) of ``requests`` the last row of ``history`` at or before that month.

    Returns the key, year, month, ``carried_age`` in months and ``columns``. All are NULL where there is no such row
    or it is more than ``max_age`` months old, so a request never sees a later month. ``history`` has
    one row per key and month. Requests and rows of a key are merged into one timeline, which is as long as the
    calendar, however often a key is asked for.
    """
    asked = requests.select(key, "year", "month").distinct()
    nothing = F.lit(None)
    row = F.struct(serial(F.col("year"), F.col("month")).alias("known_at"), *columns)
    marks = history.select(
        key, serial(F.col("year"), F.col("month")).alias("at"), nothing.cast("int").alias("year"),
        nothing.cast("int").alias("month"), row.alias("row"),
    )
    open_ = asked.select(
        key, serial(F.col("year"), F.col("month")).alias("at"), F.col("year").cast("int"), F.col("month").cast("int"),
        nothing.cast(marks.schema["row"].dataType).alias("row"),
    )
    # A range frame: a row of the month itself counts.
    past = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = open_.unionByName(marks).withColumn("last", F.last("row", ignorenulls=True).over(past)).filter("year IS NOT NULL")
    age = F.col("at") - F.col("last.known_at")
    fresh = age <= F.lit(max_age)
    return known.select(
        key, "year", "month", F.when(fresh, age).alias("carried_age"),
        *[F.when(fresh, F.col(f"last.{c}")).alias(c) for c in columns],
    )


def with_carried(state: DataFrame, history: DataFrame, max_age: int = MAX_AGE) -> DataFrame:
    """``state`` with its momentary columns replaced by the last known ones, where those are fresh enough.

    Elsewhere the values of the record that answers the request stay.
    """
    columns = [c for c in MOMENTARY if c in history.columns]
    if not columns:
        return state
    last = materialize(as_of(state, history, columns, max_age), "carried")
    last = last.select("city", "year", "month", "carried_age", *[F.col(c).alias(f"__last_{c}") for c in columns])
    df = state.join(last, ["city", "year", "month"], "left")
    return df.withColumns({c: F.coalesce(F.col(f"__last_{c}"), F.col(c)) for c in columns}).drop(
        *[f"__last_{c}" for c in columns]
    )
