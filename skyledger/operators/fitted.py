"""Baselines fitted once, stored as tables, and applied to rows that took no part in the fit.

The folder of a fit holds one Parquet table per group of rows. Drought: ``place_month`` and ``zone_month`` (normals),
``zone`` (aridity), ``place`` (dry edge of the soil), ``overall`` and ``signals`` (one line each: means and ends of ranges)
and ``edges`` (category edges of each city). Heat and extreme rain: ``place_month``, ``zone_month`` and ``month`` (normals),
``overall`` (coldest value), ``signals`` and ``edges``. Rainfall: ``place_month`` and ``zone_month``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.functions import history as H
from skyledger.operators import baselines as B
from skyledger.operators import drought as DR
from skyledger.operators import extreme as EX
from skyledger.operators import rainfall as RF
from skyledger.operators.cleaning import complete_rows
from skyledger.session import materialize


def _place_stats(names: Sequence[str] = DR.PLACE_NORMALS) -> dict[str, Column]:
    """Mean and deviation of each measure, as aggregates of a city and month."""
    out = {}
    for n in names:
        out[f"__{n}_mean"] = F.avg(B.MEASURE[n])
        if B.MEASURE[n] in B.MISSING_STD:
            out[f"__{n}_std"] = B.std_or(F.stddev_samp(B.MEASURE[n]), missing=B.MISSING_STD[B.MEASURE[n]])
    return out


def _ends(parts: dict[str, Column]) -> list[Column]:
    return [f(c).cast("double").alias(f"{n}_{end}") for n, c in parts.items() for end, f in (("min", F.min), ("max", F.max))]


def fit_drought(panel: DataFrame, path: str, until_year: int | None = None) -> None:
    """Fit on the complete rows of ``panel`` up to ``until_year`` (all by default) and store the tables below ``path``.

    A fit that is run again replaces its tables. Cities, zones and months are aggregated with map-side combining.
    """
    rows = _early(panel, DR.REQUIRED, until_year)
    _store(path, "place_month", _by(rows, ["city", "month"], _place_stats()))
    _store(path, "zone_month", _by(rows, ["climate_zone", "month"], B.zone_normals(["rain", "sm"])))
    _store(path, "zone", _by(rows, ["climate_zone"], {"zone_aridity_index": B.zone_aridity()}))
    _store(path, "place", _by(rows, ["city"], {"__sm_p25": F.percentile("soil_moisture", 0.25)}))
    _store(path, "overall", rows.agg(F.avg("rainfall_mm").alias("rain"), *_ends(DR.supply_parts())))
    signals = _signals(rows, path)
    _store(path, "signals", signals.agg(*_ends(DR.score_parts())))
    scored = DR.drought_score(signals, fitted=_line(panel.sparkSession, path, "signals"))
    _store(path, "edges", _by(scored, ["city"], {"edges": F.percentile("drought_severity_score", list(DR.CATEGORY_CUTS))}))


def apply_drought(panel: DataFrame, path: str) -> DataFrame:
    """All drought columns, score and category of ``panel`` by the baselines stored below ``path``.

    Lags and running sums come from the panel, so rows to be scored come with the months before them. Values beyond a
    fitted range count as its ends. A city or month that the fit has not seen has no normals, score or category.
    """
    spark = panel.sparkSession
    scored = DR.drought_score(_signals(panel, path), fitted=_line(spark, path, "signals"))
    edges = spark.read.parquet(f"{path}/edges").select("city", F.col("edges").alias("__edges"))
    label = H.labels_between("drought_severity_score", F.col("__edges"), K.RISK_CLASSES, closed="left")
    labelled = scored.join(edges, "city", "left").withColumn("drought_category", label).drop("__edges")
    return labelled.withColumn("drought_category_ordinal", X.encode("drought_category", K.RISK_ORDINAL))


def fit_extreme(panel: DataFrame, path: str, until_year: int | None = None) -> None:
    """As :func:`fit_drought` for heat and extreme rain: normals, the coldest value, ranges of both scores and category edges."""
    rows = _early(panel, EX.REQUIRED, until_year)
    _store(path, "place_month", B.place_month_climatology(rows).drop("lag1_climatology"))
    _store(path, "zone_month", _by(rows, ["climate_zone", "month"], B.zone_stats()))
    _store(path, "month", _by(rows, ["month"], B.seasonal_stats()))
    _store(path, "overall", rows.agg(F.min("temperature_c").alias("low")))
    # Stored, as the ranges and the edges both read them.
    signals = materialize(_extreme_signals(rows, path), "extreme-fit")
    _store(path, "signals", signals.agg(*_ends(EX.heatwave_parts() | EX.extreme_rain_parts())))
    cuts = {f"{name}_edges": F.percentile(score, list(EX.CATEGORY_CUTS)) for name, score in EXTREME_SCORES.items()}
    _store(path, "edges", _by(_extreme_scores(signals, path), ["city"], cuts))


def apply_extreme(panel: DataFrame, path: str) -> DataFrame:
    """All heat and rain columns, both scores and both categories of ``panel`` by the baselines stored below ``path``.

    Values beyond a fitted range count as its ends. A city or month that the fit has not seen has no local normals, scores
    or categories; an unseen zone has no zone columns, but scores and categories where its cities have normals.
    """
    df = _extreme_signals(complete_rows(panel, EX.REQUIRED), path)
    scored = _extreme_scores(materialize(df, "extreme-features"), path)
    df = scored.join(panel.sparkSession.read.parquet(f"{path}/edges"), "city", "left")
    for name, score in EXTREME_SCORES.items():
        label = H.labels_between(score, F.col(f"{name}_edges"), K.RISK_CLASSES, closed="right")
        df = df.withColumn(f"{name}_category", label).drop(f"{name}_edges")
        df = df.withColumn(f"{name}_category_ordinal", X.encode(f"{name}_category", K.RISK_ORDINAL))
    return df


def fit_rainfall(panel: DataFrame, path: str, until_year: int | None = None) -> None:
    """As :func:`fit_drought` for the rainfall table: normals of city and month, of the month before, and of zone and month."""
    rows = _early(panel, RF.REQUIRED, until_year)
    normals = _by(rows, ["city", "month"], _place_stats(["rain", "temp"]))
    before = normals.select("city", (F.col("month") % 12 + 1).cast("int").alias("month"), F.col("__rain_mean").alias("__previous_normal"))
    _store(path, "place_month", normals.withColumn("month", F.col("month").cast("int")).join(before, ["city", "month"], "full"))
    _store(path, "zone_month", _by(rows, ["climate_zone", "month"], B.zone_normals(["rain"]) | {"__zone_sm_mean": F.avg("soil_moisture")}))


def apply_rainfall(panel: DataFrame, path: str, zones: Sequence[str] = K.CLIMATE_ZONES) -> DataFrame:
    """The rainfall training table of ``panel`` by the normals stored below ``path``.

    A row whose city, zone or month the fit has not seen lacks a normal and is left out, like every incomplete row.
    """
    df = _attach(panel, path, {"place_month": ["city", "month"], "zone_month": ["climate_zone", "month"]})
    df = RF.rainfall_dataset(df, zones)
    return df.drop(*[c for c in df.columns if c.startswith("__")])


# The scores of the heat and rain bundle by the name of their category.
EXTREME_SCORES = {"heatwave": "heatwave_severity_score", "extreme_rainfall": "extreme_rainfall_score"}


def _early(panel: DataFrame, required: Sequence[str], until_year: int | None) -> DataFrame:
    rows = complete_rows(panel, required)
    return rows if until_year is None else rows.filter(F.col("year") <= until_year)


def _by(rows: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])


def _store(path: str, name: str, df: DataFrame) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}")


def _line(spark: SparkSession, path: str, name: str) -> dict[str, Column]:
    """The single line of a stored table as literals."""
    row = spark.read.parquet(f"{path}/{name}").head()
    return {n: F.lit(v).cast("double") for n, v in row.asDict().items()}


def _signals(panel: DataFrame, path: str) -> DataFrame:
    """The panel with the stored normals, through the drought bundles."""
    spark = panel.sparkSession
    panel = _attach(panel, path, {"place_month": ["city", "month"], "zone_month": ["climate_zone", "month"], "zone": ["climate_zone"], "place": ["city"]})
    missing = {f"__{n}_std": B.MISSING_STD[B.MEASURE[n]] for n in DR.PLACE_NORMALS if B.MEASURE[n] in B.MISSING_STD}
    missing |= {f"__zone_{n}_std": B.MISSING_STD[B.MEASURE[n]] for n in ("rain", "sm")}
    return DR.drought_signals(panel.na.fill(missing), fitted=_line(spark, path, "overall"))


def _extreme_signals(rows: DataFrame, path: str) -> DataFrame:
    """Complete rows with the stored normals, through the heat and rain bundles."""
    df = _attach(rows, path, {"place_month": ["city", "month"], "zone_month": ["climate_zone", "month"], "month": ["month"]})
    return EX.extreme_rain_features(EX.heatwave_features(H.by_entity(df), fitted=_line(rows.sparkSession, path, "overall")))


def _extreme_scores(signals: DataFrame, path: str) -> DataFrame:
    ends = _line(signals.sparkSession, path, "signals")
    return EX.extreme_rain_score(EX.heatwave_score(signals, fitted=ends), fitted=ends)


def _attach(panel: DataFrame, path: str, tables: Mapping[str, Sequence[str]]) -> DataFrame:
    """Stored tables joined by their keys; columns of their names in the panel give way."""
    for name, keys in tables.items():
        normals = panel.sparkSession.read.parquet(f"{path}/{name}")
        panel = panel.drop(*[c for c in normals.columns if c not in keys]).join(normals, list(keys), "left")
    return panel
