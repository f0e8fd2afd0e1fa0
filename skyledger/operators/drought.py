"""Drought feature bundles, score and category. Each adds columns to the monthly panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.functions import history as H
from skyledger.operators import baselines as B
from skyledger.operators.cleaning import complete_rows, drop_leakage
from skyledger.session import materialize

# Weights of the drought severity score.
SCORE_WEIGHTS = (0.30, 0.25, 0.15, 0.15, 0.15)
AVAILABILITY_WEIGHTS = (0.40, 0.40, 0.20)
CATEGORY_CUTS = (0.30, 0.60, 0.85)
REQUIRED = ["rainfall_mm", "soil_moisture", "temperature_c"]
PLACE_NORMALS = ["rain", "rain_lag", "sm", "temp"]


def water_balance(panel: DataFrame) -> DataFrame:
    rain, evaporation, runoff = F.col("rainfall_mm"), X.evaporation_mm(), X.millimetres("sro")
    return panel.withColumns(
        {
            "water_balance": rain - evaporation - runoff,
            "rainfall_evap_ratio": X.clip(X.ratio(rain, evaporation), 0.0, 20.0),
            "rainfall_runoff_ratio": X.clip(X.ratio(rain, runoff), 0.0, 500.0),
            "evaporation_pressure": X.clip(X.ratio(evaporation, rain, 1.0), 0.0, 100.0),
            "runoff_efficiency": X.clip(X.ratio(runoff, rain), 0.0, 1.0),
        }
    )


def rain_deficit(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """Shortfall against the local normal, standardised and accumulated."""
    df, added = B.ensure(H.by_entity(panel), B.place_normals(["rain", "rain_lag"], until_year))
    df = df.withColumns(
        {
            "rainfall_climatology": F.col("__rain_mean"),
            "rainfall_deficit": F.col("rainfall_mm") - F.col("__rain_mean"),
        }
    )
    return df.withColumns(
        {
            "rainfall_deficit_pct": X.clip(
                X.ratio("rainfall_deficit", "rainfall_climatology") * F.lit(100.0), -200.0, 200.0
            ),
            "rainfall_spi": X.clip(X.ratio("rainfall_deficit", "__rain_std"), -4.0, 4.0),
            "rainfall_deficit_lag1": F.col("rainfall_prev_1") - F.col("__rain_lag_mean"),
            "cumulative_deficit_3m": H.rolling("rainfall_deficit", 3, F.sum, 1),
            "cumulative_deficit_6m": H.rolling("rainfall_deficit", 6, F.sum, 1),
        }
    ).drop(*added)


def soil_features(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """Soil moisture against the local and zone normal, its trend and its dry runs."""
    sm = F.col("soil_moisture")
    df, zoned = B.ensure_group_stats(panel, ["climate_zone", "month"], B.zone_normals(["sm"], until_year))
    helpers = B.place_normals(["sm"], until_year) | {"__sm_p25": F.percentile(B.fit_rows(sm, until_year), 0.25).over(H.group("city"))}
    df, added = B.ensure(H.by_entity(df), helpers)
    df = df.withColumns(
        {
            "rolling_sm_3m": H.rolling(sm, 3, F.avg, 2),
            "rolling_sm_6m": H.rolling(sm, 6, F.avg, 2),
        }
    ).withColumns(
        {
            "sm_anomaly": sm - F.col("__sm_mean"),
            "sm_deficit": X.floor_zero(F.col("__sm_mean") - sm),
            "sm_trend": F.col("rolling_sm_3m") - F.col("rolling_sm_6m"),
            "sm_zone_anomaly": sm - F.col("__zone_sm_mean"),
        }
    ).withColumns(
        {
            "sm_zscore": X.clip(X.ratio("sm_anomaly", "__sm_std"), -4.0, 4.0),
            "sm_deficit_pct": X.ratio("sm_deficit", "__sm_mean") * F.lit(100.0),
        }
    )
    df = H.add_streaks(df, {"low_sm_streak": H.lag(sm) <= F.col("__sm_p25")})
    return df.drop(*zoned, *added)


def temp_stress(
    panel: DataFrame, until_year: int | None = None, fitted: Mapping[str, Column] | None = None
) -> DataFrame:
    """Heat against the local normal, and heat combined with missing rain; ``fitted`` may give the mean ``rain``."""
    overall = fitted or B.global_stats(panel, {"rain": F.avg(B.fit_rows("rainfall_mm", until_year))})
    df, added = B.ensure(H.by_entity(panel), B.place_normals(["temp"], until_year))
    df = df.withColumn("temperature_anomaly", F.col("temperature_c") - F.col("__temp_mean"))
    rain = X.clip(X.ratio("rainfall_mm", overall["rain"]), 0.0, 2.0)
    return df.withColumns(
        {
            "temperature_zscore": X.clip(X.ratio("temperature_anomaly", "__temp_std"), -4.0, 4.0),
            "temperature_stress": F.col("temperature_anomaly") * (F.lit(1.0) - rain),
            "heat_excess": X.floor_zero(F.col("temperature_c") - F.lit(K.HEAT_THRESHOLD_C)),
        }
    ).drop(*added)


def persistence(df: DataFrame) -> DataFrame:
    """How long and how deep; needs :func:`rain_deficit` and :func:`soil_features`."""
    df = H.by_entity(df).withColumns(
        {
            "cumulative_sm_deficit_3m": H.rolling("sm_deficit", 3, F.sum, 1),
            "cumulative_sm_deficit_6m": H.rolling("sm_deficit", 6, F.sum, 1),
            "drought_recovery": H.change("rainfall_deficit"),
        }
    )
    return H.add_streaks(
        df,
        {
            "dry_month_streak": H.lag("rainfall_mm") < 10.0,
            "deficit_streak": H.lag("rainfall_deficit") < 0.0,
        },
    )


def evolution(df: DataFrame) -> DataFrame:
    """Whether the shortfall deepens or eases; needs :func:`rain_deficit`."""
    df = H.by_entity(df).withColumns(
        {
            "drought_momentum": H.rolling("rainfall_deficit", 3, F.avg, 2) - H.rolling("rainfall_deficit", 6, F.avg, 2),
            "drought_trend": H.lagged_change("rainfall_deficit"),
            "deficit_volatility_3m": H.rolling("rainfall_deficit", 3, F.stddev_samp, 2),
        }
    )
    return df.withColumn("drought_acceleration", H.change("drought_momentum"))


def zone_drought(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """Shortfall against the zone's normal, and the zone's aridity."""
    df, added = B.ensure_group_stats(panel, ["climate_zone", "month"], B.zone_normals(["rain", "sm"], until_year))
    df, _ = B.ensure_group_stats(df, ["climate_zone"], {"zone_aridity_index": B.zone_aridity(until_year)})
    df = df.withColumns(
        {
            "zone_rain_deficit": F.col("rainfall_mm") - F.col("__zone_rain_mean"),
            "zone_sm_deficit": F.col("__zone_sm_mean") - F.col("soil_moisture"),
        }
    )
    return df.withColumns(
        {
            "zone_rain_zscore": X.clip(X.ratio("zone_rain_deficit", "__zone_rain_std"), -4.0, 4.0),
            "zone_sm_zscore": X.clip(X.ratio(F.col("soil_moisture") - F.col("__zone_sm_mean"), "__zone_sm_std"), -4.0, 4.0),
        }
    ).drop(*added)


def supply_parts() -> dict[str, Column]:
    """What :func:`water_stress` scales."""
    return {"__n_sm": F.col("soil_moisture"), "__n_rain": F.col("rainfall_mm"), "__n_sro": F.col("sro")}


def score_parts() -> dict[str, Column]:
    """The signals that :func:`drought_score` scales, in the order of their weights."""
    return {
        "__rain": -F.col("rainfall_spi"), "__soil": -F.col("sm_zscore"), "__heat": F.col("temperature_zscore"),
        "__evap": F.col("evaporation_stress"), "__water": F.col("hydrological_stress"),
    }


def water_stress(
    df: DataFrame, until_year: int | None = None, fitted: Mapping[str, Column] | None = None
) -> DataFrame:
    """Water availability and the stresses derived from it; needs soil, deficit and temperature bundles.

    ``fitted`` may give the ends of :func:`supply_parts`.
    """
    df = B.add_min_max(df, supply_parts(), eps=K.EPS, until_year=until_year, ends=fitted)
    df = df.withColumn(
        "water_availability_index", X.weighted(zip(AVAILABILITY_WEIGHTS, ("__n_sm", "__n_rain", "__n_sro")))
    ).drop("__n_sm", "__n_rain", "__n_sro")
    supply = F.col("rainfall_mm") + F.col("soil_moisture") * F.lit(100.0)
    return df.withColumns(
        {
            "hydrological_stress": F.lit(1.0) - F.col("water_availability_index"),
            "moisture_stress": F.col("sm_deficit")
            * (F.lit(1.0) + X.floor_zero("temperature_anomaly") / F.lit(10.0)),
            "evaporation_stress": X.clip(X.ratio(X.evaporation_mm(), supply, 1.0), 0.0, 20.0),
            "compound_drought_stress": F.abs(X.clip("rainfall_deficit", high=0.0)) * F.col("sm_deficit"),
        }
    )


def drought_score(
    df: DataFrame, until_year: int | None = None, fitted: Mapping[str, Column] | None = None
) -> DataFrame:
    """Severity in [0, 1] from five scaled signals; needs :func:`water_stress`. ``fitted`` may give their ends."""
    names = list(score_parts())
    scaled = B.add_min_max(df, score_parts(), eps=K.EPS, until_year=until_year, ends=fitted)
    return scaled.withColumn("drought_severity_score", X.weighted(zip(SCORE_WEIGHTS, names))).drop(*names)


def drought_category(df: DataFrame, until_year: int | None = None) -> DataFrame:
    """Low to Extreme against the city's own 30th, 60th and 85th percentile."""
    labelled = H.by_entity(df).withColumn(
        "drought_category",
        H.percentile_labels("drought_severity_score", CATEGORY_CUTS, K.RISK_CLASSES, closed="left", until_year=until_year),
    )
    return labelled.withColumn("drought_category_ordinal", X.encode("drought_category", K.RISK_ORDINAL))


def drought_signals(
    panel: DataFrame, until_year: int | None = None, fitted: Mapping[str, Column] | None = None
) -> DataFrame:
    """All drought columns before the score, stored, because the score needs their ranges first.

    Normals that the panel carries under their helper names are used as they are; ``fitted`` may give the
    mean ``rain`` and the ends of :func:`supply_parts`.
    """
    df = complete_rows(panel, REQUIRED)
    # All normals first: one stage of month windows, one small zone table.
    zone, place = B.zone_normals(["rain", "sm"], until_year), B.place_normals(PLACE_NORMALS, until_year)
    df, _ = B.ensure_group_stats(df, ["climate_zone", "month"], zone)
    df, _ = B.ensure(H.by_entity(df), place)
    df = temp_stress(zone_drought(water_balance(df), until_year), until_year, fitted)
    df = evolution(persistence(soil_features(rain_deficit(df, until_year), until_year)))
    return materialize(water_stress(df, until_year, fitted).drop(*zone, *place, "__sm_p25"), "drought-features")


def drought_features(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """All drought columns, the score and the category.

    With ``until_year`` everything that is fitted, from normals to category edges, comes from the years up to it.
    """
    return drought_category(drought_score(drought_signals(panel, until_year), until_year), until_year)


def drought_dataset(
    panel: DataFrame, zones: Sequence[str] = K.CLIMATE_ZONES, until_year: int | None = None
) -> DataFrame:
    """Training table: one-hot zones, leakage columns and incomplete rows removed."""
    df = drought_features(panel, until_year).withColumns(X.one_hot("climate_zone", zones, "climate_zone_"))
    return drop_leakage(df, K.LEAKAGE_DROUGHT).drop("climate_zone").na.drop()
