"""Scenarios, chained evaluation of state rows, projections and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.models.standin import STAND_IN, Scorer
from skyledger.operators import rules as R
from skyledger.operators import serving as V
from skyledger.operators.geo import nearest_place
from skyledger.operators.lookup import distinct_places, state_rows
from skyledger.session import materialize

# Weights of the hotspot score and its two stress indices.
HOTSPOT_WEIGHTS = {"drought": 0.25, "heatwave": 0.25, "water": 0.20, "crop": 0.15, "extreme_rainfall": 0.15}
WATER_WEIGHTS = (0.45, 0.35, 0.20)
CROP_WEIGHTS = (0.40, 0.30, 0.30)


def scenario_grid(df: DataFrame, scenarios: Mapping[str, Sequence[float]] = K.SCENARIO_PRESETS) -> DataFrame:
    """Every row once per scenario, with its name and five deltas. The short list is a literal array.

    A scenario gives its changes in the order of ``serving.DELTAS``: degrees, then percent of rain, soil
    moisture, evaporation and runoff; those it leaves out at the end are 0.
    """
    for name, changes in scenarios.items():
        if len(changes) > len(V.DELTAS):
            raise ValueError(f"scenario {name} has {len(changes)} changes, at most {len(V.DELTAS)} are known")

    def entry(name: str, changes: Sequence[float]) -> Column:
        padded = [*changes, *[0.0] * (len(V.DELTAS) - len(changes))]
        return F.struct(F.lit(name).alias("scenario"), *[F.lit(float(c)).alias(d) for d, c in zip(V.DELTAS, padded, strict=True)])

    entries = F.array(*[entry(name, changes) for name, changes in scenarios.items()])
    return df.withColumn("__s", F.explode(entries)).select(*df.columns, "__s.*")


def for_periods(df: DataFrame, years: Sequence[int], month: int) -> DataFrame:
    """Every row once per year, in the given month."""
    return df.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years]))).withColumn("month", F.lit(month))


def unique_districts(districts: DataFrame) -> DataFrame:
    """One district per name and state (blanks and case ignored): the one with the lowest id."""
    from skyledger.operators.cleaning import first_per_key

    return first_per_key(districts, [X.match_key("district_name"), X.match_key("state")], ["district_id"])


def place_requests(districts: DataFrame, panel: DataFrame) -> DataFrame:
    """Districts with their nearest city and its zone.

    A district without coordinates is placed at the default ones.
    """
    places = materialize(distinct_places(panel), "places")
    located = districts.withColumns(
        {c: F.coalesce(F.col(c), F.lit(K.STATE_DEFAULTS[c])) for c in ("latitude", "longitude")}
    )
    near = nearest_place(located, places, out="city")
    return near.join(places.select("city", "climate_zone"), "city", "left")


def local_terms(df: DataFrame) -> DataFrame:
    """Small fixed differences between neighbours, and cooling towards the north."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.withColumns(
        {
            "local_temperature": F.sin(lat * F.lit(11.0) + lon * F.lit(7.0)) * F.lit(1.5)
            + F.when(lat > 28.0, (lat - F.lit(28.0)) * F.lit(-2.2)).otherwise(F.lit(0.0)),
            "local_rainfall": F.cos(lat * F.lit(13.0) + lon * F.lit(17.0)) * F.lit(12.0),
            "local_soil_moisture": F.sin(lat * lon) * F.lit(0.04),
        }
    )


def chain(state: DataFrame, scorer: Scorer = STAND_IN, local: bool = True) -> DataFrame:
    """Temperature, rainfall, drought and extreme weather in sequence on state rows.

    Scenario deltas are applied once: degrees to the predicted temperature,
    percent to predicted rainfall and to soil moisture.
    """
    zero = F.lit(0.0)
    df = local_terms(state) if local else state.withColumns(
        {"local_temperature": zero, "local_rainfall": zero, "local_soil_moisture": zero}
    )
    df = df.withColumns(
        {d: F.coalesce(F.col(d), zero) if d in df.columns else zero for d in V.DELTAS}
    )

    def percent(d: str) -> Column:
        return F.lit(1.0) + F.col(d) / F.lit(100.0)

    df = scorer.temperature(df).withColumn(
        "temperature_c", F.col("predicted_temperature_c") + F.col("temperature_delta") + F.col("local_temperature")
    )
    df = scorer.rainfall(df)
    df = df.withColumns(
        {
            "rainfall_mm": X.floor_zero(
                F.col("predicted_rainfall_mm") * percent("rainfall_delta") + F.col("local_rainfall")
            ),
            "soil_moisture": X.clip(
                F.col("soil_moisture") * percent("soil_moisture_delta") + F.col("local_soil_moisture"), 0.0, 1.0
            ),
            "evabs": F.col("evabs") * percent("evaporation_delta"),
            "sro": X.floor_zero(F.col("sro") * percent("runoff_delta")),
        }
    )
    df = scorer.drought(V.drought_inputs(df))
    df = scorer.extreme(V.extreme_rain_inputs(V.heatwave_inputs(df)))
    score, level = R.drought_confidence()
    df = df.withColumns(
        {
            "drought_risk": R.severe("drought_probs"),
            "drought_category": R.classify("drought_probs"),
            "drought_confidence": score,
            "drought_confidence_level": level,
        }
    ).withColumn("drought_severity_score", X.round_to("drought_risk", 3))
    for hazard in ("heatwave", "extreme_rainfall"):
        df = df.withColumns(
            {
                f"{hazard}_category": R.classify(f"{hazard}_probs"),
                f"{hazard}_severity": X.round_to(X.clip(F.col(f"{hazard}_raw") * F.lit(100.0), 0.0, 100.0), 1),
                f"{hazard}_confidence": X.round_to(F.array_max(f"{hazard}_probs"), 3),
            }
        )
    return R.overall_risk(df)


def hotspot(df: DataFrame, bands: Sequence[tuple[float, str]] = K.RISK_BANDS) -> DataFrame:
    """Independent water and crop stress, the composite hotspot score and its band."""
    dry = X.clip((F.lit(0.40) - F.col("soil_moisture")) / F.lit(0.40), 0.0, 1.0)
    thirst = X.clip(F.abs("evabs") / F.lit(0.006), 0.0, 1.0)
    runoff = X.clip(F.lit(1.0) - F.col("sro") / F.lit(0.15), 0.0, 1.0)
    warm = X.clip((F.col("temperature_c") - F.lit(25.0)) / F.lit(20.0), 0.0, 1.0)
    df = df.withColumns(
        {
            "water_stress_index": X.round_to(X.clip(X.weighted(zip(WATER_WEIGHTS, (dry, thirst, runoff))), 0.0, 1.0), 4),
            "crop_stress_index": X.round_to(X.clip(X.weighted(zip(CROP_WEIGHTS, (dry, warm, warm * dry))), high=1.0), 4),
        }
    )
    return with_hotspot_score(df, bands)


def with_hotspot_score(df: DataFrame, bands: Sequence[tuple[float, str]] = K.RISK_BANDS) -> DataFrame:
    w = HOTSPOT_WEIGHTS
    score = X.weighted(
        [
            (w["drought"] * 100, "drought_severity_score"),
            (w["heatwave"], "heatwave_severity"),
            (w["water"] * 100, "water_stress_index"),
            (w["crop"] * 100, "crop_stress_index"),
            (w["extreme_rainfall"], "extreme_rainfall_severity"),
        ]
    )
    df = df.withColumn("hotspot_score", X.round_to(X.clip(score, 0.0, 100.0), 2))
    return df.withColumn("hotspot_risk_band", X.bands("hotspot_score", bands, "Low"))


def evaluate(
    requests: DataFrame,
    panel: DataFrame,
    features: DataFrame | None = None,
    scorer: Scorer = STAND_IN,
    local: bool = True,
) -> DataFrame:
    """Score placed requests (city, climate_zone, latitude, longitude, year, month, deltas)."""
    return hotspot(chain(state_rows(requests, panel, features), scorer, local))


EVALUATED_COLUMNS = (
    "district_id", "district_name", "state", "latitude", "longitude", "year", "month",
    "predicted_temperature_c", "predicted_rainfall_mm", "soil_moisture",
    "drought_category", "drought_severity_score", "drought_confidence",
    "heatwave_category", "heatwave_severity", "extreme_rainfall_category", "extreme_rainfall_severity",
    "overall_risk_category", "overall_risk_score", "water_stress_index", "crop_stress_index",
    "hotspot_score", "hotspot_risk_band",
)


def evaluate_all(
    districts: DataFrame,
    panel: DataFrame,
    years: Sequence[int],
    month: int,
    scenarios: Mapping[str, Sequence[float]] | None = None,
    features: DataFrame | None = None,
    scorer: Scorer = STAND_IN,
) -> DataFrame:
    """One row per district, year and scenario, stored for the rankings that read it several times.

    A district whose data gives no score is kept with a NULL ``hotspot_score``;
    :func:`scored` and :func:`unscored` split the rows.
    """
    requests = for_periods(place_requests(unique_districts(districts), panel), years, month)
    requests = scenario_grid(requests, scenarios or {"baseline": (0.0, 0.0, 0.0)})
    df = evaluate(requests, panel, features, scorer)
    df = df.withColumns(
        {
            "predicted_temperature_c": X.round_to("temperature_c", 2),
            "predicted_rainfall_mm": X.round_to("rainfall_mm", 2),
            "soil_moisture": X.round_to("soil_moisture", 4),
            "drought_severity_score": X.round_to("drought_severity_score", 4),
        }
    )
    # Written before it is split: pushed into the long expression chain, a filter would copy it.
    return materialize(df.select(*EVALUATED_COLUMNS, "scenario"), "evaluated")


def scored(evaluated: DataFrame) -> DataFrame:
    """The rows of :func:`evaluate_all` that rankings use."""
    return evaluated.na.drop(subset=["hotspot_score"])


def unscored(evaluated: DataFrame) -> DataFrame:
    """The other rows of :func:`evaluate_all`: district, year, scenario and the names of the values that are missing."""
    values = [c for c in EVALUATED_COLUMNS if c not in ("district_id", "year")]
    missing = F.filter(F.array(*[F.when(F.isnull(c), F.lit(c)) for c in values]), lambda c: c.isNotNull())
    rows = evaluated.filter(F.isnull("hotspot_score") | F.isnan("hotspot_score"))
    return rows.select("district_id", "year", "scenario", missing.alias("missing"))


def coverage(evaluated: DataFrame) -> DataFrame:
    """Rows asked for, scored and unscored per year and scenario, and which values the unscored ones miss."""
    keys = ["year", "scenario"]
    counts = evaluated.groupBy(*keys).agg(F.count("*").alias("asked"))
    gaps = unscored(evaluated).groupBy(*keys).agg(
        F.count("*").alias("unscored"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))).alias("missing")
    )
    df = counts.join(gaps, keys, "left").withColumn("unscored", F.coalesce("unscored", F.lit(0)))
    return df.select(
        *keys, "asked", (F.col("asked") - F.col("unscored")).alias("scored"), "unscored",
        F.coalesce(F.array_join("missing", "|"), F.lit("")).alias("missing"),
    )


def evaluate_districts(
    districts: DataFrame,
    panel: DataFrame,
    years: Sequence[int],
    month: int,
    scenarios: Mapping[str, Sequence[float]] | None = None,
    features: DataFrame | None = None,
    scorer: Scorer = STAND_IN,
) -> DataFrame:
    """The scored rows of :func:`evaluate_all`, for callers that need no quarantine."""
    return scored(evaluate_all(districts, panel, years, month, scenarios, features, scorer))


def target_dates(base: Column, timeframe: str) -> Column:
    """Dates of a timeframe: ``7day``, ``1month``, ``1year`` from a base date, or a year 2020 to 2100."""
    frame = timeframe.lower()
    first = F.trunc(base, "month")
    if frame == "7day":
        return F.sequence(base, F.date_add(base, 6))
    if frame == "1month":
        return F.array(F.add_months(first, 1))
    if frame == "1year":
        return F.array(*[F.add_months(first, i) for i in range(1, 13)])
    if frame.isdigit() and 2020 <= int(frame) <= 2100:
        return F.array(*[F.make_date(F.lit(int(frame)), F.lit(m), F.lit(1)) for m in range(1, 13)])
    raise ValueError(f"unknown timeframe {timeframe!r}")


def projections(
    districts: DataFrame,
    observations: DataFrame,
    panel: DataFrame,
    timeframe: str,
    as_of: Column,
    deltas: Sequence[float] = (0.0, 0.0, 0.0),
    features: DataFrame | None = None,
    scorer: Scorer = STAND_IN,
    rmse: float = 2.0,
) -> DataFrame:
    """Projected measures and risks per district and date.

    Dates start at the district's latest observation, else at ``as_of``. Days
    of one month share one prediction: months are scored, dates joined back.
    """
    newest = observations.groupBy("district_id").agg(F.max("observation_date").alias("base"))
    dated = (
        districts.join(newest, "district_id", "left")
        .withColumn("date", F.explode(target_dates(F.coalesce("base", as_of), timeframe)))
        .withColumns({"year": F.year("date"), "month": F.month("date")})
        .drop("base")
    )
    months = place_requests(dated.drop("date").distinct(), panel)
    months = scenario_grid(months, {"projection": deltas})
    state = state_rows(months, panel, features).withColumn("__std", F.col("rain_climo_std") * F.lit(1.2))
    scored = chain(state.withColumn("temperature_confidence", R.temperature_confidence(state)), scorer, local=False)
    rain = F.col("predicted_rainfall_mm")
    scored = scored.select(
        "district_id", "year", "month",
        X.round_to("temperature_c", 2).alias("temperature_out"),
        "temperature_confidence",
        X.round_to("rainfall_mm", 2).alias("rainfall_out"),
        R.rainfall_confidence(F.col("__std")).alias("rainfall_confidence"),
        R.rainfall_confidence_score(rain, rmse).alias("rainfall_confidence_score"),
        R.monsoon_status(rain, F.col("rain_climo_mean")).alias("monsoon_status"),
        "drought_category",
        F.col("drought_confidence_level").alias("drought_confidence"),
        F.col("overall_risk_category").alias("extreme_weather_risk"),
        F.col("overall_risk_score").alias("extreme_weather_score"),
    ).withColumnsRenamed({"temperature_out": "predicted_temperature_c", "rainfall_out": "predicted_rainfall_mm"})
    return dated.select("district_id", "date", "year", "month").join(scored, ["district_id", "year", "month"])


def generate_forecasts(
    districts: DataFrame,
    panel: DataFrame,
    first_day: Column,
    days: int = 7,
    scorer: Scorer = STAND_IN,
    features: DataFrame | None = None,
) -> DataFrame:
    """Forecast rows (district_id, forecast_date, predicted measures) for consecutive days; feed them to ``upsert``."""
    dated = districts.withColumn(
        "forecast_date", F.explode(F.sequence(first_day, F.date_add(first_day, days - 1)))
    ).withColumns({"year": F.year("forecast_date"), "month": F.month("forecast_date")})
    months = place_requests(dated.drop("forecast_date").distinct(), panel)
    state = state_rows(months, panel, features)
    scored = scorer.temperature(state).withColumn("temperature_c", F.col("predicted_temperature_c"))
    scored = scorer.rainfall(scored).select(
        "district_id", "year", "month",
        X.round_to("predicted_rainfall_mm", 2).alias("predicted_rainfall"),
        X.round_to("predicted_temperature_c", 2).alias("predicted_temperature"),
    )
    return dated.select("district_id", "forecast_date", "year", "month").join(
        scored, ["district_id", "year", "month"]
    ).drop("year", "month")


def comfort(temperature: Column, humidity: Column) -> Column:
    return (
        F.when((temperature > 32.0) & (humidity > 70.0), F.lit("Uncomfortable"))
        .when(temperature.between(20.0, 26.0), F.lit("Pleasant"))
        .otherwise(F.lit("Moderate"))
    )


def compare_scenarios(scored: DataFrame, humidity: DataFrame, default_humidity: float = 60.0) -> DataFrame:
    """Each scenario against the district's baseline, as nested structs plus the changes.

    ``scored`` is the output of :func:`chain` with a ``scenario`` column that
    includes ``baseline``; ``humidity`` has district_id and average_humidity.
    """
    confidence = (
        F.col("drought_confidence") + F.col("heatwave_confidence") + F.col("extreme_rainfall_confidence")
    ) / F.lit(3.0)
    state = F.struct(
        F.col("temperature_c").alias("temperature"), F.col("rainfall_mm").alias("rainfall"),
        "drought_category", F.col("drought_severity_score").alias("drought_score"),
        "heatwave_category", "heatwave_severity", "extreme_rainfall_category", "extreme_rainfall_severity",
        "overall_risk_score", "overall_risk_category", confidence.alias("confidence"),
    )
    rows = materialize(scored.select("district_id", "scenario", *V.DELTAS, state.alias("state")), "scenario-states")
    base = rows.filter(F.col("scenario") == "baseline").select("district_id", F.col("state").alias("baseline_state"))
    moist = humidity.select("district_id", F.col("average_humidity").alias("__humidity"))
    df = (
        rows.filter(F.col("scenario") != "baseline")
        .join(base, "district_id")
        .join(moist, "district_id", "left")
        .withColumn("baseline_humidity", F.coalesce("__humidity", F.lit(default_humidity)))
    )
    wet = F.col("baseline_humidity") * (F.lit(1.0) + F.col("soil_moisture_delta") / F.lit(100.0))
    df = df.withColumn("scenario_humidity", X.round_to(X.clip(wet, 0.0, 100.0), 2))
    return df.select(
        "district_id", "scenario", *V.DELTAS, "baseline_state", F.col("state").alias("scenario_state"),
        "baseline_humidity", "scenario_humidity",
        X.level_change(F.col("baseline_state.overall_risk_category"), F.col("state.overall_risk_category")).alias("risk_change"),
        X.level_change(F.col("baseline_state.drought_category"), F.col("state.drought_category")).alias("drought_change"),
        X.signed_text(F.col("state.confidence") - F.col("baseline_state.confidence")).alias("confidence_change"),
        comfort(F.col("state.temperature"), F.col("scenario_humidity")).alias("comfort_index"),
    )


def state_record(scored: DataFrame) -> DataFrame:
    """Everything about a state row as nested structs: prediction, drivers, water, crops, impacts, warnings."""
    df = R.drought_warning(R.crop_outlook(R.water_outlook(R.drought_drivers(scored))))
    df = R.extreme_warning(R.rain_impact(R.heat_impact(R.extreme_drivers(df))))
    keys = [c for c in ("district_id", "city", "year", "month", "scenario") if c in df.columns]
    return df.select(
        *keys,
        F.struct("drought_category", "drought_severity_score", "drought_confidence", "drought_confidence_level",
                 F.col("drought_probs").alias("probabilities")).alias("drought_prediction"),
        F.struct(F.col("heatwave_category").alias("category"), F.col("heatwave_severity").alias("severity"),
                 F.col("heatwave_confidence").alias("confidence")).alias("heatwave_prediction"),
        F.struct(F.col("extreme_rainfall_category").alias("category"), F.col("extreme_rainfall_severity").alias("severity"),
                 F.col("extreme_rainfall_confidence").alias("confidence")).alias("rainfall_extreme_prediction"),
        F.struct("overall_risk_category", "overall_risk_score").alias("overall_extreme_weather"),
        F.struct("drought_drivers", "extreme_drivers").alias("drivers"),
        F.struct("water_stress_index", "reservoir_risk", "groundwater_risk", "water_availability_status").alias(
            "water_intelligence"
        ),
        F.struct("crop_stress_index", "irrigation_need", "agricultural_risk").alias("agriculture_intelligence"),
        F.struct("health_risk", "outdoor_exposure_risk", "heat_alert_level", "heat_recommendations").alias("heat_impact"),
        F.struct("flash_flood_risk", "surface_runoff_risk", "drainage_overload_risk", "rain_recommendations").alias(
            "rain_impact"
        ),
        F.struct("drought_warning", "drought_warning_level", "drought_message").alias("drought_early_warning"),
        F.struct("extreme_warning", "extreme_warning_level", "event_type", "extreme_message").alias(
            "extreme_early_warning"
        ),
        F.struct("temperature_c", "rainfall_mm", "soil_moisture", F.col("evabs").alias("evaporation"),
                 F.col("sro").alias("runoff")).alias("resolved_state"),
    )
