"""Summaries, trends, comparisons and leaderboards over observations and forecasts.

Averages come from exact sums: they do not depend on the order or the
partitioning of the rows. Observations are aggregated per district before they
meet the district table, so a district with a third of all readings is one line
by the time it is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import exprs as X
from skyledger.operators.baselines import global_stats
from skyledger.operators.cleaning import last_per_key

MEASURES = {"rainfall": "average_rainfall", "temperature": "average_temperature", "humidity": "average_humidity"}
LEVELS = {"weekly": "week", "monthly": "month", "yearly": "year"}
LEADERBOARDS = {"hottest": ("temperature", True), "wettest": ("rainfall", True), "driest": ("rainfall", False)}


def _sums(measures: Sequence[str]) -> list[Column]:
    """Partial sums that can be added up again at a coarser grain."""
    parts = {m: X.exact_parts(m) for m in measures}
    return [
        *[F.sum(p).alias(f"{m}__{part}") for m in measures for part, p in zip(X.PARTS, parts[m])],
        *[F.count(m).alias(f"{m}__n") for m in measures],
        F.count("*").alias("__rows"),
    ]


def _resummed(measures: Sequence[str]) -> list[Column]:
    return [
        *[F.sum(f"{m}__{p}").alias(f"{m}__{p}") for m in measures for p in X.PARTS],
        *[F.coalesce(F.sum(f"{m}__n"), F.lit(0)).alias(f"{m}__n") for m in measures],
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("__rows"),
    ]


def _mean(measure: str) -> Column:
    total = X.exact_total(*[f"{measure}__{p}" for p in X.PARTS])
    return F.try_divide(total, F.col(f"{measure}__n").cast("double"))


def _means(names: Mapping[str, str]) -> list[Column]:
    return [X.rounded(_mean(m)).alias(out) for m, out in names.items()]


def per_district(observations: DataFrame, measures: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    return observations.groupBy("district_id").agg(*_sums(measures))


def district_summary(observations: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Averages and counts of observations and forecasts for every district that has either."""
    predicted = {
        "predicted_rainfall": "average_predicted_rainfall",
        "predicted_temperature": "average_predicted_temperature",
    }
    seen = per_district(observations).select("district_id", *_means(MEASURES), F.col("__rows").alias("o"))
    expected = (
        forecasts.groupBy("district_id")
        .agg(*_sums(list(predicted)))
        .select("district_id", *_means(predicted), F.col("__rows").alias("f"))
    )
    both = seen.join(expected, "district_id", "full")
    return both.select(
        "district_id",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (*MEASURES.values(), *predicted.values())],
        F.coalesce("o", F.lit(0)).alias("observation_count"),
        F.coalesce("f", F.lit(0)).alias("forecast_count"),
    )


def state_summary(observations: DataFrame, districts: DataFrame) -> DataFrame:
    """Averages per state, names compared without case."""
    joined = per_district(observations).join(districts.select("district_id", "state"), "district_id")
    return (
        joined.groupBy(F.lower("state").alias("state"))
        .agg(*_resummed(list(MEASURES)))
        .select("state", *_means(MEASURES), F.col("__rows").alias("observation_count"))
    )


def period_trend(
    observations: DataFrame, level: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Averages per district and week, month or year; the date range includes both ends."""
    if level.lower() not in LEVELS:
        raise ValueError(f"unknown level {level!r}, expected one of {sorted(LEVELS)}")
    df = observations
    if start is not None:
        df = df.filter(F.col("observation_date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("observation_date") <= F.lit(end))
    period = F.date_trunc(LEVELS[level.lower()], F.col("observation_date")).cast("date").alias("period")
    return (
        df.groupBy("district_id", period)
        .agg(*_sums(list(MEASURES)))
        .select("district_id", "period", *_means(MEASURES), F.col("__rows").alias("observation_count"))
    )


def page(df: DataFrame, order: Sequence[str | Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset(skip).limit(limit)


def time_series(observations: DataFrame, measure: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` points of every district.

    The rank filter is pushed below the shuffle as a group limit, so a long
    district is cut down before it travels.
    """
    order = Window.partitionBy("district_id").orderBy("observation_date", "id")
    return (
        observations.withColumn("point", F.row_number().over(order))
        .filter(F.col("point") <= limit)
        .select("district_id", "point", "observation_date", measure)
    )


def district_comparison(observations: DataFrame, districts: DataFrame) -> DataFrame:
    """Averages for every district, also those without observations."""
    joined = districts.join(per_district(observations), "district_id", "left")
    return joined.select(
        "district_id", "district_name", "state", *_means(MEASURES),
        F.coalesce("__rows", F.lit(0)).alias("observation_count"),
    )


def district_vs_overall(observations: DataFrame, districts: DataFrame) -> DataFrame:
    """Each district's rounded averages, the overall rounded averages and their differences."""
    overall = global_stats(observations, {m: X.rounded(X.exact_mean(m)) for m in MEASURES})
    df = district_comparison(observations, districts)
    return df.select(
        "district_id", "district_name", "state", "observation_count", *MEASURES.values(),
        *[overall[m].alias(f"overall_{m}") for m in MEASURES],
        *[X.round_to(F.col(out) - overall[m], 2).alias(f"difference_{m}") for m, out in MEASURES.items()],
    )


def entity_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of rows per named table."""
    counts = [df.agg(F.count("*").alias("total")).select(F.lit(n).alias("entity"), "total") for n, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def latest(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The newest rows; a top-n, not a full sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def latest_per_district(observations: DataFrame) -> DataFrame:
    """The last row of every district, combined on the map side."""
    return last_per_key(observations, ["district_id"], ["observation_date", "id"])


def _named_means(observations: DataFrame, districts: DataFrame, measure: str) -> DataFrame:
    joined = per_district(observations, [measure]).join(districts, "district_id")
    return (
        joined.groupBy("district_name", "state")
        .agg(F.min("district_id").alias("district_id"), *_resummed([measure]))
        .select("district_id", "district_name", "state", _mean(measure).alias("__value"))
    )


def leaderboard(
    observations: DataFrame, districts: DataFrame, metric: str, state: str | None = None, n: int = 5
) -> DataFrame:
    """Top districts by average temperature or rainfall, districts of one name and state taken together."""
    if metric.lower() not in LEADERBOARDS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {sorted(LEADERBOARDS)}")
    measure, descending = LEADERBOARDS[metric.lower()]
    places = districts if state is None else districts.filter(X.equals_ignoring_case("state", F.lit(state)))
    df = _named_means(observations, places, measure)
    order = F.desc("__value") if descending else F.asc("__value")
    return df.orderBy(order, "district_id").limit(n).select(
        "district_id", "district_name", "state", X.rounded("__value").alias("value")
    )


def coldest_in_month(observations: DataFrame, districts: DataFrame, month: int, n: int = 5) -> DataFrame:
    """Districts with the lowest maximum temperature in a calendar month."""
    peaks = (
        observations.filter(F.month("observation_date") == month)
        .groupBy("district_id")
        .agg(F.max("temperature").alias("peak"))
    )
    named = (
        peaks.join(districts, "district_id")
        .groupBy("district_name", "state")
        .agg(F.min("district_id").alias("district_id"), F.max("peak").alias("peak"))
    )
    return named.orderBy(F.asc("peak"), "district_id").limit(n).select(
        "district_id", "district_name", "state", X.rounded("peak").alias("value")
    )


def active_forecasts(forecasts: DataFrame, as_of: date) -> DataFrame:
    """Forecasts from ``as_of`` on, in date order."""
    return forecasts.filter(F.col("forecast_date") >= F.lit(as_of)).orderBy("forecast_date", "district_id", "id")


def for_key(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one district or user."""
    return df.filter(F.col(column) == F.lit(value))
