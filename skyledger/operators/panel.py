"""The monthly panel: one row per city and month with lags, rolling means, targets and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.functions import history as H
from skyledger.operators.baselines import fit_rows, global_stats
from skyledger.functions.exprs import finite_columns


def convert_units(raw: DataFrame) -> DataFrame:
    """Kelvin to Celsius, metres to millimetres, two soil layers to one, calendar parts."""
    converted = raw.withColumns(
        {
            "temperature_c": X.celsius("t2m"),
            "rainfall_mm": X.millimetres("tp"),
            "soil_moisture": (F.col("swvl1") + F.col("swvl2")) / F.lit(2.0),
            "year": F.year("date"),
            "month": F.month("date"),
        }
    )
    sine, cosine = X.cyclic("month", 12)
    return converted.withColumns({"month_sin": sine, "month_cos": cosine})


def base_panel(raw: DataFrame, until_year: int | None = None) -> DataFrame:
    """The 28-column panel. Rows without a full six-row history or a next row are left out.

    With ``until_year`` the labels' edges and the score's range come from the years up to it.
    """
    raw = finite_columns(raw)
    df = H.by_entity(convert_units(raw))
    df = df.withColumns(
        {
            "temperature_prev_1": H.lag("temperature_c", 1),
            "temperature_prev_3": H.lag("temperature_c", 3),
            "rainfall_prev_1": H.lag("rainfall_mm", 1),
            "rainfall_prev_3": H.lag("rainfall_mm", 3),
            "soil_moisture_prev_1": H.lag("soil_moisture", 1),
            "rolling_temp_3m": H.rolling("temperature_c", 3, F.avg, 3, lagged=False),
            "rolling_rainfall_3m": H.rolling("rainfall_mm", 3, F.avg, 3, lagged=False),
            "rolling_temp_6m": H.rolling("temperature_c", 6, F.avg, 6, lagged=False),
            "rolling_rainfall_6m": H.rolling("rainfall_mm", 6, F.avg, 6, lagged=False),
            "target_temperature_next_month": H.lead("temperature_c"),
            "target_rainfall_next_month": H.lead("rainfall_mm"),
            "__dryness": F.lit(-1.0) * (F.col("rainfall_mm") + F.col("soil_moisture") * F.lit(100.0)),
        }
    )
    df = df.withColumns(
        {
            "heatwave_risk": H.percentile_labels("temperature_c", (0.75, 0.90), K.PANEL_LABELS, closed="right", until_year=until_year),
            "drought_risk": H.percentile_labels("__dryness", (0.75, 0.90), K.PANEL_LABELS, closed="right", until_year=until_year),
        }
    )
    known = fit_rows("t", until_year)
    ends = global_stats(raw.select(X.celsius("t2m").alias("t"), F.year("date").alias("year")), {"low": F.min(known), "high": F.max(known)})
    scaled = F.try_divide(F.col("temperature_c") - ends["low"], ends["high"] - ends["low"])
    score = X.weighted(
        [
            (0.30, scaled),
            (0.35, X.encode("heatwave_risk", K.PANEL_LABEL_SCORE)),
            (0.35, X.encode("drought_risk", K.PANEL_LABEL_SCORE)),
        ]
    )
    df = df.withColumn("climate_risk_score", X.round_to(X.clip(score * F.lit(100.0), 0.0, 100.0), 2))
    return df.select(*K.PANEL_COLUMNS).na.drop().dropDuplicates()


def absolute_risk_labels(panel: DataFrame) -> DataFrame:
    """Drought and heat labels by fixed thresholds."""
    t, r3 = F.col("temperature_c"), F.col("rolling_rainfall_3m")
    return panel.withColumns(
        {
            "absolute_drought_risk": X.first_match(
                [((r3 < 30) & (t > 35), "High"), ((r3 < 60) & (t > 30), "Medium")], "Low"
            ),
            "absolute_heatwave_risk": X.bands(t, [(45.0, "Critical"), (40.0, "High"), (36.0, "Medium")], "Low"),
        }
    )
