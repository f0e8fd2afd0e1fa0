"""Heatwave and extreme-rainfall bundles, scores, categories and zone insights."""

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

# Weights of the two severity scores and the category percentiles.
HEATWAVE_WEIGHTS = (0.35, 0.25, 0.15, 0.15, 0.10)
EXTREME_RAIN_WEIGHTS = (0.35, 0.25, 0.20, 0.10, 0.10)
CATEGORY_CUTS = (0.50, 0.75, 0.90)
REQUIRED = ["rainfall_mm", "soil_moisture", "temperature_c"]


def climatology_baselines(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """Twelve helper columns: normals per city and month, zone and month, and month."""
    df = B.attach_group_stats(panel, ["climate_zone", "month"], B.zone_stats(until_year))
    df = df.join(B.group_stats(panel, ["month"], B.seasonal_stats(until_year)), "month", "left")
    normals = {}
    for short, measure in (("temp", "temperature_c"), ("rain", "rainfall_mm"), ("sm", "soil_moisture")):
        normals[f"{short}_climo_mean"] = B.place_month_mean(measure, until_year)
        normals[f"{short}_climo_std"] = B.std_or(B.place_month_std(measure, until_year), zero=B.ZERO_STD[measure])
    return H.by_entity(df).withColumns(normals)


def _relative_rain() -> Column:
    """Rain as a share of the local normal, limited to [0, 2]."""
    return X.clip(X.ratio("rainfall_mm", "rain_climo_mean"), 0.0, 2.0)


def heatwave_features(df: DataFrame, until_year: int | None = None, fitted: Mapping[str, Column] | None = None) -> DataFrame:
    """The ``hw_`` columns; needs :func:`climatology_baselines`. ``fitted`` brings the coldest value ``low`` of a stored fit."""
    t, sm = F.col("temperature_c"), F.col("soil_moisture")
    coldest = B.global_stats(df, {"low": F.min(B.fit_rows("temperature_c", until_year))}) if fitted is None else fitted
    df = H.by_entity(df).withColumns(
        {
            "hw_temperature_anomaly": t - F.col("temp_climo_mean"),
            "hw_heat_excess": X.floor_zero(t - F.lit(K.HEAT_THRESHOLD_C)),
            "hw_climate_zone_heat_anomaly": t - F.col("zone_temp_mean"),
            "hw_seasonal_heat_deviation": t - F.col("seasonal_temp_mean"),
            "hw_rolling_temp_trend_3m": F.col("rolling_temp_3m") - F.col("rolling_temp_6m"),
            "hw_evaporation_heat_ratio": X.clip(X.ratio(X.evaporation_mm(), F.abs(t), 1.0), 0.0, 20.0),
            "__rain": _relative_rain(),
            "__dry": X.floor_zero(F.col("sm_climo_mean") - sm),
            "__felt": X.apparent_temperature(t, sm),
        }
    )
    anomaly = F.col("hw_temperature_anomaly")
    df = df.withColumns(
        {
            "__hot": X.floor_zero(anomaly),
            "__rainless": X.floor_zero(F.lit(1.0) - F.col("__rain")),
            "hw_temperature_zscore": X.clip(F.try_divide(anomaly, F.col("temp_climo_std")), -5.0, 5.0),
            "hw_heat_stress": anomaly * X.floor_zero(F.lit(2.0) - F.col("__rain")),
            "hw_dry_heat_indicator": F.col("hw_heat_excess") * (F.lit(1.0) - X.clip(sm / F.lit(0.5), 0.0, 1.0)),
            "hw_zone_temp_zscore": X.clip(X.ratio("hw_climate_zone_heat_anomaly", "zone_temp_std"), -5.0, 5.0),
            "hw_apparent_temperature": X.clip("__felt", coldest["low"], 55.0),
            "hw_rolling_heat_3m": H.rolling(anomaly, 3, F.avg, 1),
            "hw_rolling_heat_6m": H.rolling(anomaly, 6, F.avg, 1),
        }
    ).withColumns(
        {
            "hw_heatwave_intensity": X.clip(X.ratio("__hot", "zone_temp_std"), 0.0, 5.0),
            "hw_heat_acceleration": F.col("hw_rolling_heat_3m") - F.col("hw_rolling_heat_6m"),
            "hw_rainfall_heat_interaction": F.col("__hot") * F.col("__rainless"),
            "hw_soil_heat_interaction": F.col("__hot") * F.col("__dry"),
            "hw_apparent_temp_anomaly": F.col("hw_apparent_temperature") - F.col("temp_climo_mean"),
            "hw_compound_heat_drought": F.col("__hot") * F.col("__dry") * F.col("__rainless"),
        }
    )
    df = H.add_streaks(df, {"hw_consecutive_hot_months": H.lag(anomaly) > F.col("temp_climo_std")})
    return df.drop("__rain", "__dry", "__felt", "__hot", "__rainless")


def extreme_rain_features(df: DataFrame) -> DataFrame:
    """The ``er_`` columns; needs :func:`climatology_baselines`."""
    rain, runoff = F.col("rainfall_mm"), X.millimetres("sro")
    short, long = F.col("rolling_rainfall_3m"), F.col("rolling_rainfall_6m")
    df = H.by_entity(df).withColumns(
        {
            "er_rainfall_anomaly": rain - F.col("rain_climo_mean"),
            "er_rainfall_intensity": rain / F.lit(K.DAYS_IN_MONTH),
            "er_rainfall_surge": rain - short,
            "er_rainfall_momentum": rain - long,
            "er_rainfall_acceleration": (rain - short) - (short - long),
            "er_rainfall_variability_3m": H.rolling_cv(rain, 3),
            "er_rainfall_variability_6m": H.rolling_cv(rain, 6),
            "er_runoff_pressure": X.clip(X.ratio(runoff, rain), 0.0, 5.0),
            "er_runoff_response": X.clip(runoff, 0.0, 50.0),
            "er_soil_saturation": X.clip(F.col("soil_moisture") / F.lit(0.45), 0.0, 1.0),
            "er_antecedent_soil_moisture": F.coalesce(H.lag("soil_moisture"), F.col("sm_climo_mean")),
            "er_water_surplus": X.clip(rain - X.evaporation_mm() - runoff, low=-500.0),
            "er_zone_rainfall_anomaly": rain - F.col("zone_rain_mean"),
            "er_seasonal_rainfall_deviation": rain - F.col("seasonal_rain_mean"),
            "er_cumulative_rain_3m": H.rolling(rain, 3, F.sum, 1),
            "er_cumulative_rain_6m": H.rolling(rain, 6, F.sum, 1),
            "er_is_monsoon": X.season_flag("month", "is_monsoon"),
            "er_monsoon_phase_factor": X.monsoon_factor("month"),
            "er_evaporation_demand_ratio": X.clip(X.ratio(X.evaporation_mm(), rain), 0.0, 20.0),
            "__share": X.clip(X.ratio(rain, "rain_climo_mean"), 0.0, 5.0),
        }
    ).withColumn(
        "er_rainfall_zscore", X.clip(F.try_divide("er_rainfall_anomaly", "rain_climo_std"), -5.0, 5.0)
    )
    df = df.withColumns(
        {
            "er_extreme_precipitation_index": X.floor_zero("er_rainfall_zscore"),
            "er_flood_potential_proxy": X.clip(
                F.col("__share") * X.clip("er_runoff_pressure", 0.0, 3.0) * F.col("er_soil_saturation"), 0.0, 10.0
            ),
            "er_zone_rainfall_zscore": X.clip(X.ratio("er_zone_rainfall_anomaly", "zone_rain_std"), -5.0, 5.0),
        }
    ).withColumn(
        "er_compound_rainfall_saturation",
        X.clip(F.col("er_extreme_precipitation_index") * F.col("er_soil_saturation"), 0.0, 5.0),
    )
    return H.add_streaks(df, {"er_consecutive_wet_months": H.lag(rain) > F.col("rain_climo_mean")}).drop("__share")


def _scored(
    df: DataFrame, name: str, weights: Sequence[float], parts: Mapping[str, Column], until_year: int | None,
    fitted: Mapping[str, Column] | None,
) -> DataFrame:
    scaled = B.add_min_max(df, parts, until_year=until_year, ends=fitted)
    return scaled.withColumn(name, X.clip(X.weighted(zip(weights, parts)), 0.0, 1.0)).drop(*parts)


def heatwave_parts() -> dict[str, Column]:
    """What the heatwave score weighs, before scaling."""
    return {
        "__heat_anomaly": X.floor_zero("hw_temperature_anomaly"),
        "__heat_stress": X.floor_zero("hw_heat_stress"),
        "__heat_soil": X.floor_zero(F.col("sm_climo_mean") - F.col("soil_moisture")),
        "__heat_rain": X.floor_zero(F.col("rain_climo_mean") - F.col("rainfall_mm")),
        "__heat_demand": X.clip(X.ratio(X.evaporation_mm(), "rainfall_mm", 1.0), 0.0, 50.0),
    }


def extreme_rain_parts() -> dict[str, Column]:
    """What the extreme-rain score weighs, before scaling."""
    return {
        "__wet_anomaly": X.floor_zero("er_rainfall_anomaly"),
        "__wet_intensity": F.col("er_rainfall_intensity"),
        "__wet_runoff": F.col("er_runoff_pressure"),
        "__wet_soil": F.col("er_soil_saturation"),
        "__wet_acceleration": X.floor_zero("er_rainfall_acceleration"),
    }


def heatwave_score(df: DataFrame, until_year: int | None = None, fitted: Mapping[str, Column] | None = None) -> DataFrame:
    """Severity in [0, 1]; needs :func:`heatwave_features`. ``fitted`` brings stored ranges of :func:`heatwave_parts`."""
    return _scored(df, "heatwave_severity_score", HEATWAVE_WEIGHTS, heatwave_parts(), until_year, fitted)


def extreme_rain_score(df: DataFrame, until_year: int | None = None, fitted: Mapping[str, Column] | None = None) -> DataFrame:
    """Severity in [0, 1]; needs :func:`extreme_rain_features`. ``fitted`` brings stored ranges of :func:`extreme_rain_parts`."""
    return _scored(df, "extreme_rainfall_score", EXTREME_RAIN_WEIGHTS, extreme_rain_parts(), until_year, fitted)


def extreme_categories(df: DataFrame, until_year: int | None = None) -> DataFrame:
    """Both categories against the city's own 50th, 75th and 90th percentile."""
    df = H.by_entity(df)
    for name, score in (("heatwave", "heatwave_severity_score"), ("extreme_rainfall", "extreme_rainfall_score")):
        df = df.withColumn(
            f"{name}_category", H.percentile_labels(score, CATEGORY_CUTS, K.RISK_CLASSES, closed="right", until_year=until_year)
        ).withColumn(f"{name}_category_ordinal", X.encode(f"{name}_category", K.RISK_ORDINAL))
    return df


def extreme_features(panel: DataFrame, until_year: int | None = None) -> DataFrame:
    """All heat and rain columns, both scores and both categories; features are stored before scoring.

    With ``until_year`` everything that is fitted comes from the years up to it.
    """
    df = complete_rows(panel, REQUIRED)
    df = extreme_rain_features(heatwave_features(climatology_baselines(df, until_year), until_year))
    df = heatwave_score(materialize(df, "extreme-features"), until_year)
    return extreme_categories(extreme_rain_score(df, until_year), until_year)


# Helper columns that do not belong to the training table.
BASELINE_COLUMNS = (
    "temp_climo_mean", "temp_climo_std", "rain_climo_mean", "rain_climo_std", "sm_climo_mean", "sm_climo_std",
    "zone_temp_mean", "zone_temp_std", "zone_rain_mean", "zone_rain_std", "seasonal_temp_mean", "seasonal_rain_mean",
)


def extreme_dataset(
    panel: DataFrame, zones: Sequence[str] = K.CLIMATE_ZONES, until_year: int | None = None
) -> DataFrame:
    """Training table for both tasks."""
    df = extreme_features(panel, until_year).withColumns(X.one_hot("climate_zone", zones, "climate_zone_"))
    return drop_leakage(df, K.LEAKAGE_EXTREME + BASELINE_COLUMNS).na.drop()


def score_by_zone(df: DataFrame, score: str, category: str) -> DataFrame:
    """Mean, deviation and maximum of a score and the share of Extreme rows, per zone."""
    extreme = F.when(F.col(category) == "Extreme", F.lit(1.0)).otherwise(F.lit(0.0))
    return df.groupBy("climate_zone").agg(
        F.avg(score).alias("mean_score"),
        F.stddev_samp(score).alias("std_score"),
        F.max(score).alias("max_score"),
        (F.avg(extreme) * F.lit(100.0)).alias("extreme_pct"),
    )


def score_by_month(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    return df.groupBy("month").agg(*[F.avg(s).alias(f"mean_{s}") for s in scores])


def zone_insights(df: DataFrame) -> dict[str, DataFrame]:
    """The six summary frames, from most to least affected."""
    out = {}
    for name, score in (("heatwave", "heatwave_severity_score"), ("extreme_rainfall", "extreme_rainfall_score")):
        zones = score_by_zone(df, score, f"{name}_category")
        out[f"{name}_by_zone"] = zones.select("climate_zone", "mean_score", "std_score", "max_score").orderBy(
            F.desc("mean_score"), "climate_zone"
        )
        out[f"extreme_{name}_pct_by_zone"] = zones.select("climate_zone", "extreme_pct").orderBy(
            F.desc("extreme_pct"), "climate_zone"
        )
        out[f"{name}_by_month"] = score_by_month(df, [score]).orderBy(F.desc(f"mean_{score}"), "month")
    return out
