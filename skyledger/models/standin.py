"""The scoring interface, and a transparent scorer that needs no training.

A scorer is four steps, each a function from frame to frame. They run in the
order temperature, rainfall, drought, extreme weather; each sees what the steps
before it put into the state row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import exprs as X

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Scorer:
    """``temperature`` adds predicted_temperature_c, ``rainfall`` predicted_rainfall_mm,
    ``drought`` drought_probs, ``extreme`` heatwave_probs, heatwave_raw,
    extreme_rainfall_probs and extreme_rainfall_raw (severity in [0, 1])."""

    temperature: Step
    rainfall: Step
    drought: Step
    extreme: Step


def class_probabilities(severity: str | Column) -> Column:
    """Four class probabilities from one severity in [0, 1]; they add up to 1."""
    s = X.col(severity)
    r = F.lit(1.0) - s
    three = F.lit(3.0)
    return F.array(r * r * r, three * s * r * r, three * s * s * r, s * s * s)


def _drought(df: DataFrame) -> DataFrame:
    severity = X.weighted(
        [
            (0.30, (F.lit(4.0) - F.col("rainfall_spi")) / F.lit(8.0)),
            (0.25, (F.lit(4.0) - F.col("sm_zscore")) / F.lit(8.0)),
            (0.15, (F.lit(4.0) + F.col("temperature_zscore")) / F.lit(8.0)),
            (0.15, F.col("evaporation_stress") / F.lit(20.0)),
            (0.15, F.col("hydrological_stress")),
        ]
    )
    df = df.withColumn("__s", X.clip(severity, 0.0, 1.0))
    return df.withColumn("drought_probs", class_probabilities("__s")).drop("__s")


def _extreme(df: DataFrame) -> DataFrame:
    heat = X.weighted(
        [
            (0.60, X.floor_zero("hw_temperature_zscore") / F.lit(5.0)),
            (0.40, F.col("hw_heatwave_intensity") / F.lit(5.0)),
        ]
    )
    rain = X.weighted(
        [
            (0.60, F.col("er_extreme_precipitation_index") / F.lit(5.0)),
            (0.25, X.clip("er_runoff_pressure", 0.0, 1.0)),
            (0.15, F.col("er_soil_saturation")),
        ]
    )
    return df.withColumns(
        {"heatwave_raw": X.clip(heat, 0.0, 1.0), "extreme_rainfall_raw": X.clip(rain, 0.0, 1.0)}
    ).withColumns(
        {
            "heatwave_probs": class_probabilities("heatwave_raw"),
            "extreme_rainfall_probs": class_probabilities("extreme_rainfall_raw"),
        }
    )


STAND_IN = Scorer(
    temperature=lambda df: df.withColumn("predicted_temperature_c", F.col("temperature_c")),
    rainfall=lambda df: df.withColumn("predicted_rainfall_mm", X.floor_zero("rainfall_mm")),
    drought=_drought,
    extreme=_extreme,
)
