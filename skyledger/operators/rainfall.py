"""Rainfall feature bundles. Each adds columns to the monthly panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.functions import history as H
from skyledger.operators import baselines as B
from skyledger.operators.cleaning import complete_rows, drop_leakage

REQUIRED = ["rainfall_mm", "target_rainfall_next_month"]


def monsoon(panel: DataFrame) -> DataFrame:
    df = panel.withColumns({name: X.season_flag("month", name) for name in K.SEASON_MONTHS}).withColumn(
        "monsoon_phase", X.monsoon_phase("month")
    )
    sine, cosine = X.cyclic("monsoon_phase", 6)
    return df.withColumns({"monsoon_phase_sin": sine, "monsoon_phase_cos": cosine})


def rain_anomaly(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """Departure from the local normal, past variability, and dry and wet runs."""
    df, added = B.ensure(H.by_entity(panel), B.place_normals(["rain"], until_year))
    df = df.withColumn("rainfall_climatology", F.col("__rain_mean")).drop(*added).withColumns(
        {
            "rainfall_anomaly": F.col("rainfall_mm") - F.col("rainfall_climatology"),
            "rolling_rainfall_std_3m": H.rolling("rainfall_mm", 3, F.stddev_samp, 2),
            "rolling_rainfall_std_6m": H.rolling("rainfall_mm", 6, F.stddev_samp, 2),
            "rolling_rainfall_median_3m": H.rolling_median("rainfall_mm", 3),
            "rolling_rainfall_median_6m": H.rolling_median("rainfall_mm", 6),
        }
    ).withColumns(
        {
            "rainfall_anomaly_pct": X.ratio("rainfall_anomaly", "rainfall_climatology"),
            "rolling_rainfall_cv_3m": X.ratio("rolling_rainfall_std_3m", "rolling_rainfall_3m"),
        }
    )
    return H.add_streaks(
        df,
        {
            "dry_months_streak": H.lag("rainfall_mm") < 5.0,
            "wet_months_streak": H.lag("rainfall_mm") > 50.0,
        },
    )


def rain_momentum(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """How rainfall changed over the last months, against the local normal."""
    helpers = {
        "__rain_mean": B.place_month_mean("rainfall_mm", until_year),
        "__previous_normal": B.previous_month_mean("rainfall_mm", until_year),
    }
    df, added = B.ensure(H.by_entity(panel), helpers)
    last, third = F.col("rainfall_prev_1"), F.col("rainfall_prev_3")
    short, long = F.col("rolling_rainfall_3m"), F.col("rolling_rainfall_6m")
    return df.withColumns(
        {
            "rainfall_trend": last - third,
            "rainfall_acceleration": (last - short) - (short - long),
            "rainfall_growth_rate": X.clip(X.ratio(last - third, third), -10.0, 10.0),
            "rainfall_momentum": last - F.col("__rain_mean"),
            "rainfall_seasonal_deviation": last - F.col("__previous_normal"),
        }
    ).drop(*added)


def temperature_anomaly(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    df, added = B.ensure(H.by_entity(panel), {"__temp_mean": B.place_month_mean("temperature_c", until_year)})
    df = df.withColumn("temperature_climatology", F.col("__temp_mean")).drop(*added)
    return df.withColumns(
        {
            "temperature_anomaly": F.col("temperature_c") - F.col("temperature_climatology"),
            "temp_trend_3m": F.col("rolling_temp_3m") - F.col("rolling_temp_6m"),
        }
    )


def land_trends(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """Past change of soil moisture, evaporation and runoff, and wetness against the zone."""
    df, added = B.ensure_group_stats(panel, ["climate_zone", "month"], {"__zone_sm_mean": F.avg(B.fit_rows("soil_moisture", until_year))})
    return (
        H.by_entity(df)
        .withColumns(
            {
                "soil_moisture_trend": H.lagged_change("soil_moisture"),
                "evabs_trend": H.lagged_change("evabs"),
                "sro_trend": H.lagged_change("sro"),
                "soil_moisture_zone_anomaly": F.col("soil_moisture") - F.col("__zone_sm_mean"),
            }
        )
        .drop(*added)
    )


def zone_relative_rain(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """Rainfall against the zone's normal for the month."""
    df, added = B.ensure_group_stats(panel, ["climate_zone", "month"], B.zone_normals(["rain"], until_year))
    df = df.withColumns(
        {
            "zone_rainfall_climatology": F.col("__zone_rain_mean"),
            "zone_rainfall_anomaly": F.col("rainfall_mm") - F.col("__zone_rain_mean"),
        }
    )
    return df.withColumns(
        {
            "zone_rainfall_anomaly_pct": X.ratio("zone_rainfall_anomaly", "zone_rainfall_climatology"),
            "zone_rainfall_zscore": X.ratio("zone_rainfall_anomaly", "__zone_rain_std"),
        }
    ).drop(*added)


def rainfall_dataset(
    panel: DataFrame, zones: Sequence[str] = K.CLIMATE_ZONES, until_year: int | None = None
) -> DataFrame:
    """All rainfall features, one-hot zones, leakage columns and incomplete rows removed."""
    df = complete_rows(panel, REQUIRED)
    # All normals first: one small zone table, one stage of month windows.
    zones_ = B.zone_normals(["rain"], until_year) | {"__zone_sm_mean": F.avg(B.fit_rows("soil_moisture", until_year))}
    df, zoned = B.ensure_group_stats(df, ["climate_zone", "month"], zones_)
    helpers = B.place_normals(["rain", "temp"], until_year) | {"__previous_normal": B.previous_month_mean("rainfall_mm", until_year)}
    df, added = B.ensure(H.by_entity(df), helpers)
    df = zone_relative_rain(temperature_anomaly(rain_momentum(monsoon(df))))
    df = land_trends(rain_anomaly(df)).drop(*zoned, *added)
    df = df.withColumns(X.one_hot("climate_zone", zones, "climate_zone_"))
    return drop_leakage(df, K.LEAKAGE_RAINFALL).na.drop()
