"""Fixed schemas; nothing is inferred."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_D, _I, _L, _S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()

RAW_PANEL = _struct(
    ("city", _S), ("climate_zone", _S), ("latitude", _D), ("longitude", _D), ("date", T.DateType()),
    ("t2m", _D), ("tp", _D), ("swvl1", _D), ("swvl2", _D), ("evabs", _D), ("sro", _D),
)
GRID = _struct(
    ("latitude", _D), ("longitude", _D), ("valid_time", T.DateType()),
    ("t2m", _D), ("tp", _D), ("swvl1", _D), ("swvl2", _D), ("evabs", _D), ("sro", _D),
)
PANEL = _struct(
    ("city", _S), ("climate_zone", _S), ("latitude", _D), ("longitude", _D), ("date", T.DateType()),
    ("year", _I), ("month", _I),
    *[
        (n, _D)
        for n in (
            "temperature_c", "rainfall_mm", "soil_moisture", "evabs", "sro", "month_sin", "month_cos",
            "temperature_prev_1", "temperature_prev_3", "rainfall_prev_1", "rainfall_prev_3", "soil_moisture_prev_1",
            "rolling_temp_3m", "rolling_rainfall_3m", "rolling_temp_6m", "rolling_rainfall_6m",
            "target_temperature_next_month", "target_rainfall_next_month",
        )
    ],
    ("drought_risk", _S), ("heatwave_risk", _S), ("climate_risk_score", _D),
)
LOCATIONS = T.MapType(_S, _struct(("lat", _D), ("lon", _D), ("climate_zone", _S)))
DISTRICTS = _struct(("id", _L), ("state", _S), ("district_name", _S), ("latitude", _D), ("longitude", _D))
OBSERVATIONS = _struct(
    ("id", _L), ("district_id", _L), ("rainfall", _D), ("temperature", _D), ("humidity", _D),
    ("observation_date", T.DateType()),
)
FORECASTS = _struct(
    ("id", _L), ("district_id", _L), ("predicted_rainfall", _D), ("predicted_temperature", _D),
    ("forecast_date", T.DateType()),
)
IMPORT_CSV = _struct(
    ("district_id", _S), ("rainfall", _S), ("temperature", _S), ("humidity", _S), ("observation_date", _S)
)
DAILY_PAYLOAD = _struct(
    (
        "daily",
        _struct(
            ("time", T.ArrayType(_S)),
            ("rain_sum", T.ArrayType(_D)),
            ("temperature_2m_max", T.ArrayType(_D)),
            ("relative_humidity_2m_mean", T.ArrayType(_D)),
        ),
    )
)
LIVE_PAYLOAD = _struct(
    (
        "current",
        _struct(
            ("time", _S), ("temperature_2m", _D), ("rain", _D), ("relative_humidity_2m", _D),
            ("soil_moisture_0_to_7cm", _D),
        ),
    )
)
