"""Climatology baselines: what is normal for a place and a month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.functions.exprs import ColumnLike, col
from skyledger.functions.history import group
from skyledger.session import materialize

# What replaces a standard deviation of exactly zero.
ZERO_STD = {"temperature_c": 0.1, "rainfall_mm": 0.01, "soil_moisture": 0.001}
# What replaces a missing standard deviation.
MISSING_STD = {"temperature_c": 1.0, "rainfall_mm": 1.0, "soil_moisture": 0.01}

# Short names of the measures in helper columns.
MEASURE = {
    "rain": "rainfall_mm", "sm": "soil_moisture", "temp": "temperature_c", "rain_lag": "rainfall_prev_1",
}


def fit_rows(c: ColumnLike, until_year: int | None, year: str = "year") -> Column:
    """Only the values up to ``until_year`` take part in a baseline; all of them by default."""
    return col(c) if until_year is None else F.when(F.col(year) <= until_year, col(c))


def place_month_mean(c: ColumnLike, until_year: int | None = None) -> Column:
    """Mean for the row's city and calendar month.

    A window, not a join: the panel is already hashed by city, so this needs no
    shuffle, and a (city, month) group holds one row per year.
    """
    return F.avg(fit_rows(c, until_year)).over(group("city", "month"))


def place_month_std(c: ColumnLike, until_year: int | None = None) -> Column:
    return F.stddev_samp(fit_rows(c, until_year)).over(group("city", "month"))


def ensure(df: DataFrame, columns: Mapping[str, Column]) -> tuple[DataFrame, list[str]]:
    """Add the helper columns that are missing; returns the frame and what was added.

    A pipeline that adds all helpers up front gets one window stage for them
    instead of one per bundle.
    """
    missing = {n: c for n, c in columns.items() if n not in df.columns}
    return (df.withColumns(missing) if missing else df), list(missing)


def ensure_group_stats(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]
) -> tuple[DataFrame, list[str]]:
    """Like :func:`ensure` for statistics of large groups."""
    missing = {n: c for n, c in stats.items() if n not in df.columns}
    return (attach_group_stats(df, keys, missing) if missing else df), list(missing)


def place_normals(names: Sequence[str], until_year: int | None = None) -> dict[str, Column]:
    """Helper columns ``__<name>_mean`` and ``__<name>_std`` for city and month."""
    out = {}
    for n in names:
        c = MEASURE[n]
        out[f"__{n}_mean"] = place_month_mean(c, until_year)
        if c in MISSING_STD:
            out[f"__{n}_std"] = std_or(place_month_std(c, until_year), missing=MISSING_STD[c])
    return out


def zone_normals(names: Sequence[str], until_year: int | None = None) -> dict[str, Column]:
    """Helper aggregates ``__zone_<name>_mean`` and ``__zone_<name>_std`` for zone and month."""
    out = {}
    for n in names:
        c = fit_rows(MEASURE[n], until_year)
        out[f"__zone_{n}_mean"] = F.avg(c)
        out[f"__zone_{n}_std"] = std_or(F.stddev_samp(c), missing=MISSING_STD[MEASURE[n]])
    return out


def zone_aridity(until_year: int | None = None) -> Column:
    """Rain of a zone over its evaporation, both as means."""
    evaporation = F.avg(F.abs(fit_rows("evabs", until_year))) * F.lit(float(K.EVAPORATION_MM))
    return X.clip(X.ratio(F.avg(fit_rows("rainfall_mm", until_year)), evaporation, 1.0), 0.0, 20.0)


def previous_month_mean(c: str, until_year: int | None = None) -> Column:
    """Mean for the row's city in the calendar month before the row's month."""
    by_month = F.array(
        *[F.avg(F.when(F.col("month") == m, fit_rows(c, until_year))).over(group("city")) for m in range(1, 13)]
    )
    return F.try_element_at(by_month, F.pmod(F.col("month") - 2, F.lit(12)) + F.lit(1))


def std_or(std: Column, zero: float | None = None, missing: float | None = None) -> Column:
    """Replace a zero or a missing standard deviation."""
    out = std if zero is None else F.when(std == 0, F.lit(zero)).otherwise(std)
    return out if missing is None else F.coalesce(out, F.lit(missing))


def group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Aggregate with map-side combining and keep the result as a small stored table."""
    return materialize(df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), "baseline")


def attach_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add group statistics of large groups (zones, months) to every row.

    The few groups hold most of the data, so they are aggregated and joined
    rather than windowed. The stored table has a known size: the planner
    broadcasts it when it is small and shuffles (with skew splitting) otherwise.
    """
    return df.join(group_stats(df, keys, stats), list(keys), "left")


def place_month_climatology(panel: DataFrame) -> DataFrame:
    """City by month table of means and deviations; a zero deviation is replaced.

    ``lag1_climatology`` is the mean of the rain one month before, for a panel that has it.
    """
    before = [F.avg("rainfall_prev_1").alias("lag1_climatology")] if "rainfall_prev_1" in panel.columns else []
    return panel.groupBy("city", "month").agg(
        F.avg("temperature_c").alias("temp_climo_mean"),
        std_or(F.stddev_samp("temperature_c"), zero=ZERO_STD["temperature_c"]).alias("temp_climo_std"),
        F.avg("rainfall_mm").alias("rain_climo_mean"),
        std_or(F.stddev_samp("rainfall_mm"), zero=ZERO_STD["rainfall_mm"]).alias("rain_climo_std"),
        F.avg("soil_moisture").alias("sm_climo_mean"),
        std_or(F.stddev_samp("soil_moisture"), zero=ZERO_STD["soil_moisture"]).alias("sm_climo_std"),
        *before,
    )


def zone_month_climatology(panel: DataFrame) -> DataFrame:
    """Zone by month table, with the normals of the drought bundle under their own names."""
    drought = {
        "zone_rain_climatology": F.avg("rainfall_mm"),
        "zone_rain_climatology_std": std_or(F.stddev_samp("rainfall_mm"), missing=MISSING_STD["rainfall_mm"]),
        "zone_sm_climatology": F.avg("soil_moisture"),
        "zone_sm_climatology_std": std_or(F.stddev_samp("soil_moisture"), missing=MISSING_STD["soil_moisture"]),
    }
    return panel.groupBy("climate_zone", "month").agg(*[c.alias(n) for n, c in (zone_stats() | drought).items()])


def zone_stats(until_year: int | None = None) -> dict[str, Column]:
    temp, rain = fit_rows("temperature_c", until_year), fit_rows("rainfall_mm", until_year)
    return {
        "zone_temp_mean": F.avg(temp),
        "zone_temp_std": std_or(F.stddev_samp(temp), zero=ZERO_STD["temperature_c"]),
        "zone_rain_mean": F.avg(rain),
        "zone_rain_std": std_or(F.stddev_samp(rain), zero=ZERO_STD["rainfall_mm"]),
    }


def seasonal_stats(until_year: int | None = None) -> dict[str, Column]:
    return {
        "seasonal_temp_mean": F.avg(fit_rows("temperature_c", until_year)),
        "seasonal_rain_mean": F.avg(fit_rows("rainfall_mm", until_year)),
    }


def month_climatology(panel: DataFrame) -> DataFrame:
    """Month table over all places."""
    return panel.groupBy("month").agg(*[c.alias(n) for n, c in seasonal_stats().items()])


def global_stats(df: DataFrame, stats: Mapping[str, Column]) -> dict[str, Column]:
    """Whole-frame statistics as literals.

    One aggregated line reaches the driver. As literals the values neither need
    a join nor get computed again wherever an expression that uses them is copied.
    """
    line = df.agg(*[c.cast("double").alias(n) for n, c in stats.items()]).head()
    return {n: F.lit(line[n]).cast("double") for n in stats}


def month_lookups(panel: DataFrame) -> dict[str, Column]:
    """The month means over all places as columns that look up the row's ``month`` among twelve literals."""
    stats = {
        f"{name}_{m}": F.avg(F.when(F.col("month") == m, F.col(c)))
        for name, c in (("seasonal_temp_mean", "temperature_c"), ("seasonal_rain_mean", "rainfall_mm"))
        for m in range(1, 13)
    }
    values = global_stats(panel, stats)
    return {
        name: F.try_element_at(F.array(*[values[f"{name}_{m}"] for m in range(1, 13)]), F.col("month").cast("int"))
        for name in ("seasonal_temp_mean", "seasonal_rain_mean")
    }


def range_ends(df: DataFrame, parts: Mapping[str, Column], until_year: int | None = None) -> dict[str, Column]:
    """Smallest and largest value of each part as literals ``<name>_min`` and ``<name>_max``."""
    staged = df.withColumns({f"__{n}": c for n, c in parts.items()})
    return global_stats(
        staged,
        {f"{n}_{end}": f(fit_rows(f"__{n}", until_year)) for n in parts for end, f in (("min", F.min), ("max", F.max))},
    )


def add_min_max(
    df: DataFrame,
    parts: Mapping[str, Column],
    eps: float = 0.0,
    until_year: int | None = None,
    ends: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Scale each part to [0, 1] by its range over the whole frame.

    With ``eps`` the range is widened; without, a constant part becomes 0. With ``until_year`` the range
    is that of the rows up to the year, and later values beyond it count as its ends; so do values beyond ``ends``, a range
    fitted before.
    """
    staged = df.withColumns({f"__{n}": c for n, c in parts.items()})
    limited = until_year is not None or ends is not None
    ends = range_ends(df, parts, until_year) if ends is None else ends

    def scale(n: str) -> Column:
        value, low, high = F.col(f"__{n}"), ends[f"{n}_min"], ends[f"{n}_max"]
        if limited:
            value = F.when(value.isNotNull(), F.least(F.greatest(value, low), high))
        if eps:
            return (value - low) / (high - low + F.lit(eps))
        return F.when(value.isNotNull(), F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0)))

    return staged.withColumns({n: scale(n) for n in parts}).drop(*[f"__{n}" for n in parts])
