"""Fixed values of the climate model: labels, seasons, thresholds and weights."""

# Ordered risk labels.
RISK_CLASSES = ("Low", "Medium", "High", "Extreme")
RISK_ORDINAL = {"Low": 0, "Medium": 1, "High": 2, "Extreme": 3}
PANEL_LABELS = ("Low", "Medium", "High")
PANEL_LABEL_SCORE = {"Low": 0.0, "Medium": 0.5, "High": 1.0}

# Climate zones.
CLIMATE_ZONES = (
    "Central Plateau Region",
    "Eastern Coastal Region",
    "Himalayan Region",
    "Indo-Gangetic Plains",
    "North-East Region",
    "Southern Peninsular Region",
    "Thar Desert Region",
    "Western Coastal Region",
    "Western Ghats Region",
)

# Seasons by calendar month.
SEASON_MONTHS = {
    "is_monsoon": (6, 7, 8, 9),
    "pre_monsoon": (3, 4, 5),
    "post_monsoon": (10, 11),
    "is_winter_dry": (12, 1, 2),
}
# Monsoon phase 0 to 5 by month 1 to 12.
MONSOON_PHASE = (0, 0, 1, 1, 1, 2, 3, 3, 4, 5, 5, 0)

# Physical constants.
KELVIN_OFFSET = 273.15
EVAPORATION_MM = 30 * 1000
DAYS_IN_MONTH = 30.44
HEAT_THRESHOLD_C = 35.0
EPS = 1e-6

# Apparent-temperature polynomial, (coefficient, power of T, power of h).
APPARENT_TEMPERATURE = (
    (-8.78469475556, 0, 0),
    (1.61139411, 1, 0),
    (2.33854883889, 0, 1),
    (-0.14611605, 1, 1),
    (-0.012308094, 2, 0),
    (-0.0164248277778, 0, 2),
    (0.002211732, 2, 1),
    (0.00072546, 1, 2),
    (-0.000003582, 2, 2),
)

# Columns of the monthly panel, in order.
PANEL_COLUMNS = (
    "city", "climate_zone", "latitude", "longitude", "date", "year", "month",
    "temperature_c", "rainfall_mm", "soil_moisture", "evabs", "sro",
    "month_sin", "month_cos",
    "temperature_prev_1", "temperature_prev_3",
    "rainfall_prev_1", "rainfall_prev_3", "soil_moisture_prev_1",
    "rolling_temp_3m", "rolling_rainfall_3m",
    "rolling_temp_6m", "rolling_rainfall_6m",
    "target_temperature_next_month", "target_rainfall_next_month",
    "drought_risk", "heatwave_risk", "climate_risk_score",
)

# Columns dropped before training, per feature set.
LEAKAGE_RAINFALL = ("target_temperature_next_month", "drought_risk", "heatwave_risk", "climate_risk_score", "date")
LEAKAGE_DROUGHT = (
    "target_temperature_next_month", "target_rainfall_next_month",
    "drought_risk", "heatwave_risk", "climate_risk_score", "date", "city",
)
LEAKAGE_EXTREME = (
    "target_temperature_next_month", "target_rainfall_next_month",
    "drought_risk", "heatwave_risk", "climate_risk_score",
)

# Global importances used as weights of the drought drivers.
DROUGHT_IMPORTANCE = {
    "rainfall_spi": 11724, "rainfall_deficit": 3573, "rainfall_deficit_pct": 5369,
    "sm_zscore": 12856, "sm_anomaly": 2818, "sm_deficit": 828, "moisture_stress": 1360,
    "temperature_zscore": 10448, "temperature_anomaly": 5516, "temperature_stress": 3654, "heat_excess": 3,
    "evaporation_pressure": 6020, "evaporation_stress": 5982,
    "hydrological_stress": 843, "water_balance": 1926,
}
# Global importances used as weights of the extreme-weather drivers.
EXTREME_IMPORTANCE = {
    "hw_temperature_anomaly": 0.033, "hw_heat_stress": 0.116,
    "hw_soil_heat_interaction": 0.043, "hw_rainfall_heat_interaction": 0.087,
    "er_rainfall_anomaly": 2230, "er_runoff_pressure": 737,
    "er_soil_saturation": 908, "er_rainfall_intensity": 201,
}

# Named what-if scenarios (temperature in degrees, the rest in percent).
SCENARIO_PRESETS = {
    "baseline": (0.0, 0.0, 0.0),
    "temperature_plus_1": (1.0, 0.0, 0.0),
    "temperature_plus_2": (2.0, 0.0, 0.0),
    "rainfall_minus_10": (0.0, -10.0, 0.0),
    "rainfall_plus_10": (0.0, 10.0, 0.0),
}

# Named what-if scenarios that also change evaporation and runoff (degrees, then percent of rain, soil moisture,
# evaporation and runoff).
WATER_SCENARIOS = {
    "baseline": (0.0, 0.0, 0.0, 0.0, 0.0),
    "evaporation_plus_20": (0.0, 0.0, 0.0, 20.0, 0.0),
    "runoff_plus_50": (0.0, 0.0, 0.0, 0.0, 50.0),
    "runoff_gone": (0.0, 0.0, 0.0, 0.0, -100.0),
    "hot_and_dry": (2.0, -20.0, -10.0, 15.0, -30.0),
}

# Hotspot risk bands, (lower bound, label) from the top.
RISK_BANDS = ((40.0, "Critical"), (20.0, "High"), (10.0, "Moderate"))
RISK_BANDS_DOCUMENTED = ((75.0, "Critical"), (50.0, "High"), (25.0, "Moderate"))

# What a state row holds where nothing is known.
STATE_DEFAULTS = {
    "latitude": 20.0, "longitude": 80.0,
    "temperature_c": 30.0, "rainfall_mm": 10.0, "soil_moisture": 0.20, "evabs": -0.001, "sro": 0.001,
    "temperature_prev_1": 29.0, "temperature_prev_3": 28.0,
    "rainfall_prev_1": 5.0, "rainfall_prev_3": 2.0, "soil_moisture_prev_1": 0.18,
    "rolling_temp_3m": 28.5, "rolling_rainfall_3m": 15.0, "rolling_temp_6m": 25.0, "rolling_rainfall_6m": 30.0,
    "rolling_sm_3m": 0.22, "rolling_sm_6m": 0.25,
    "dry_month_streak": 0.0, "deficit_streak": 0.0, "low_sm_streak": 0.0,
    "cumulative_deficit_3m": -10.0, "cumulative_deficit_6m": -25.0,
    "cumulative_sm_deficit_3m": 0.05, "cumulative_sm_deficit_6m": 0.10,
    "lag1_climatology": 10.0,
    "zone_rain_climatology": 10.0, "zone_rain_climatology_std": 4.0,
    "zone_sm_climatology": 0.20, "zone_sm_climatology_std": 0.04,
    "zone_aridity_index": 1.5, "drought_acceleration": 0.0, "deficit_volatility_3m": 5.0,
    "consecutive_hot_months": 0.0, "consecutive_wet_months": 0.0,
}
CLIMATOLOGY_DEFAULTS = {
    "rain_climo_mean": 12.0, "rain_climo_std": 5.0, "sm_climo_mean": 0.25, "sm_climo_std": 0.05,
    "temp_climo_mean": 28.0, "temp_climo_std": 2.0,
    "zone_temp_mean": 28.0, "zone_temp_std": 2.0, "zone_rain_mean": 12.0, "zone_rain_std": 5.0,
    "seasonal_temp_mean": 28.0, "seasonal_rain_mean": 12.0,
}
INGEST_DEFAULTS = {"rainfall": 0.0, "temperature": 25.0, "humidity": 50.0}

# Accepted date formats, tried in this order.
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "yyyy/M/d", "d/M/yyyy")
