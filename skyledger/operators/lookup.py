"""State rows: the best known record of a place and month, its normals, and live overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.operators import baselines as B
from skyledger.operators import carry as CY
from skyledger.operators.cleaning import last_per_key
from skyledger.operators.skew import attach_by_key
from skyledger.session import materialize, spread

# Yearly drift beyond the last record.
WARMING_PER_YEAR = 0.04
RAIN_GROWTH_PER_YEAR = 0.002
DRYING_PER_YEAR = 0.001
WARMING = ("temperature_c", "temperature_prev_1", "temperature_prev_3", "rolling_temp_3m", "rolling_temp_6m")
WETTING = ("rainfall_mm", "rainfall_prev_1", "rainfall_prev_3", "rolling_rainfall_3m", "rolling_rainfall_6m")
DRYING = ("soil_moisture", "soil_moisture_prev_1", "rolling_sm_3m", "rolling_sm_6m")
# Trust in each source.
SOURCE_CONFIDENCE = {"LIVE": 1.0, "DATABASE": 0.8, "HISTORICAL": 0.5}


def _serial(year: Column, month: Column) -> Column:
    return year * F.lit(12) + month


def match_history(requests: DataFrame, history: DataFrame, city: str = "city") -> DataFrame:
    """Which record answers each distinct (city, year, month).

    First the record of that very month; else the latest year that has the
    month; else the record nearest in months (the earlier one when two are
    equally near). Adds ``record_year``, ``record_month`` and ``match``
    (0, 1 or 2); all NULL for a city without records.

    Every step works on keys that were made distinct first, so a city asked for
    very often, or recorded very often, is one calendar's worth of lines.
    """
    asked = requests.select(F.col(city).alias("city"), "year", "month").distinct()
    known = history.select("city", "year", "month").distinct()

    exact = known.select("city", "year", "month", F.lit(True).alias("exact"))
    newest = known.groupBy("city", "month").agg(F.max("year").alias("newest"))
    step = asked.join(exact, ["city", "year", "month"], "left").join(newest, ["city", "month"], "left")
    step = materialize(step, "matched")
    direct = step.filter(F.col("newest").isNotNull()).select(
        "city", "year", "month",
        F.when(F.col("exact"), F.col("year")).otherwise(F.col("newest")).alias("record_year"),
        F.col("month").alias("record_month"),
        F.when(F.col("exact"), F.lit(0)).otherwise(F.lit(1)).alias("match"),
    )

    unanswered = step.filter(F.col("newest").isNull())
    if unanswered.isEmpty():
        return direct

    # The month is unknown for the city: nearest record before or after, by merging
    # both calendars of the city into one timeline.
    open_ = unanswered.select(
        "city", _serial(F.col("year"), F.col("month")).alias("at"), "year", "month", F.lit(None).cast("int").alias("rec")
    )
    serial = _serial(F.col("year"), F.col("month"))
    marks = known.join(unanswered.select("city").distinct(), "city", "left_semi").select(
        "city", serial.alias("at"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("month"),
        serial.cast("int").alias("rec"),
    )
    timeline = Window.partitionBy("city").orderBy("at")
    merged = open_.unionByName(marks).withColumns(
        {
            "prev": F.last("rec", ignorenulls=True).over(timeline.rangeBetween(Window.unboundedPreceding, 0)),
            "next": F.first("rec", ignorenulls=True).over(timeline.rangeBetween(0, Window.unboundedFollowing)),
        }
    ).filter(F.col("year").isNotNull())
    earlier = F.col("next").isNull() | (F.col("at") - F.col("prev") <= F.col("next") - F.col("at"))
    chosen = F.when(F.col("prev").isNotNull() & earlier, F.col("prev")).otherwise(F.col("next"))
    nearest = merged.withColumn("rec", chosen).select(
        "city", "year", "month",
        F.floor((F.col("rec") - F.lit(1)) / F.lit(12)).cast("int").alias("record_year"),
        (F.pmod(F.col("rec") - F.lit(1), F.lit(12)) + F.lit(1)).cast("int").alias("record_month"),
        F.when(F.col("rec").isNotNull(), F.lit(2)).alias("match"),
    )
    return direct.unionByName(nearest)


def with_history(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Add the answering record of ``history`` (one row per city and month) to every request.

    Record columns that the request already has are left to the request.
    """
    matched = match_history(requests, history)
    own = set(requests.columns)
    carried = [c for c in history.columns if c not in own and c not in ("city", "year", "month")]
    records = history.select(
        "city", F.col("year").alias("record_year"), F.col("month").alias("record_month"), *carried
    )
    answers = matched.join(records, ["city", "record_year", "record_month"], "left")
    return requests.join(answers, ["city", "year", "month"], "left")


def with_normals(requests: DataFrame, panel: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """Add the normals of the city and month, the zone and month, the month, and overall.

    With ``cities``, which has every city of ``requests``, the normals of other cities are not computed.
    """
    own = panel if cities is None else panel.join(cities.select("city"), "city", "left_semi")
    place = B.place_month_climatology(own)
    zone = materialize(B.zone_month_climatology(panel), "zone-normals")
    arid = B.group_stats(panel, ["climate_zone"], {"zone_aridity_index": B.zone_aridity()})
    overall = B.global_stats(panel, {"rain": F.avg("rainfall_mm"), "low": F.min("temperature_c")})
    # Normals of the request's own month, not those that a record of another month brought along.
    normals = {c for t in (place, zone, arid) for c in t.columns} - {"city", "month", "climate_zone"}
    joined = (
        requests.drop(*normals)
        .join(place, ["city", "month"], "left")
        .join(zone, ["climate_zone", "month"], "left")
        .join(arid, "climate_zone", "left")
    )
    return joined.withColumns(
        B.month_lookups(panel) | {"overall_rain_mean": overall["rain"], "coldest_c": overall["low"]}
    )


def drift(df: DataFrame) -> DataFrame:
    """Project the record forward when the asked year lies after it."""
    ahead = X.clip(F.col("year") - F.coalesce(F.col("record_year"), F.col("year")), low=0)
    df = df.withColumn("years_ahead", ahead)
    years = F.col("years_ahead").cast("double")
    changed: dict[str, Column] = {}
    for names, f in (
        (WARMING, lambda c: c + F.lit(WARMING_PER_YEAR) * years),
        (WETTING, lambda c: c * (F.lit(1.0) + F.lit(RAIN_GROWTH_PER_YEAR) * years)),
        (DRYING, lambda c: c * (F.lit(1.0) - F.lit(DRYING_PER_YEAR) * years)),
    ):
        changed.update({n: f(F.col(n)) for n in names if n in df.columns})
    return df.withColumns(changed)


def override(df: DataFrame, given: Mapping[str, str]) -> DataFrame:
    """Values given with the request win over looked-up ones: ``{column: request column}``."""
    return df.withColumns({c: F.coalesce(F.col(g), F.col(c)) for c, g in given.items()})


def state_rows(
    requests: DataFrame,
    panel: DataFrame,
    features: DataFrame | None = None,
    given: Mapping[str, str] | None = None,
    max_age: int = CY.MAX_AGE,
) -> DataFrame:
    """One wide state row per request (city, climate_zone, year, month, ...).

    ``features`` is the record table, one row per city and month; by default the panel with what
    :func:`carry.carried_history` adds. The record gives the measures. Streaks, deficits and momentum come
    from the last row at or before the month asked for, up to ``max_age`` months old, else from the
    record; the default constants stand only where neither knows a value. Year and month are cleaned: text is read as a
    number, the month is limited to 1 to 12.

    The state depends on city, year and month only, so it is built once per
    distinct combination and attached to the requests in one join, in which a
    city that most requests ask for is split. Histories and normals are built for the cities asked for.
    """
    keys = ["city", "year", "month"]
    place = [c for c in ("latitude", "longitude") if c in requests.columns]
    cleaned = requests.withColumns({"year": X.as_int("year", 2024), "month": X.valid_month("month")})
    cleaned = X.with_defaults(cleaned, {c: K.STATE_DEFAULTS[c] for c in place}) if place else cleaned
    asked = cleaned.groupBy(*keys).agg(F.max("climate_zone").alias("climate_zone"), F.count("*").alias("__n"))
    # A line per combination, read by every step below.
    asked = materialize(asked, "asked")
    cities = materialize(asked.select("city").distinct(), "asked-cities")
    records = materialize(CY.carried_history(panel, cities=cities), "carried-history") if features is None else features
    state = CY.with_carried(with_history(asked, records), records, max_age)
    state = with_normals(state, panel, cities)
    state = drift(X.with_defaults(state, K.STATE_DEFAULTS | K.CLIMATOLOGY_DEFAULTS))
    own = set(cleaned.columns) - set(keys)
    # A request is a few bytes and its state row hundreds of columns: requests are dealt out before they grow.
    df = attach_by_key(spread(cleaned), state.select(*[c for c in state.columns if c not in own]), keys, "__n")
    return override(df, given) if given else df


def resolve_sources(
    state: DataFrame,
    live: DataFrame,
    observations: DataFrame,
    use_live: Column | str = "use_live",
    live_order: Sequence[str] = ("observed_at",),
) -> DataFrame:
    """Replace historical measures by live ones, else by the latest observation.

    Only requests with ``use_live`` look beyond history. Temperature decides
    which source answers; the source's other measures replace the historical
    ones where present. Adds source, its confidence and its time.
    """
    wanted = F.coalesce(X.col(use_live), F.lit(False))
    seen = last_per_key(observations, ["district_id"], ["observation_date", "id"]).select(
        "district_id",
        F.col("temperature").alias("db_t"), F.col("rainfall").alias("db_r"), F.col("humidity").alias("db_h"),
        F.col("observation_date").alias("db_date"),
    )
    now = last_per_key(live, ["district_id"], live_order).select(
        "district_id",
        F.col("temperature").alias("live_t"), F.col("rainfall").alias("live_r"), F.col("humidity").alias("live_h"),
        F.col("soil_moisture").alias("live_s"), F.col("observed_at").alias("live_at"),
    )
    df = state.join(materialize(now, "live"), "district_id", "left")
    df = df.join(materialize(seen, "latest"), "district_id", "left")
    if "humidity" not in df.columns:
        df = df.withColumn("humidity", F.lit(None).cast("double"))
    is_live = wanted & F.col("live_t").isNotNull()
    is_stored = wanted & F.col("live_t").isNull() & F.col("db_date").isNotNull() & F.col("db_t").isNotNull()
    df = df.withColumn(
        "source", F.when(is_live, F.lit("LIVE")).when(is_stored, F.lit("DATABASE")).otherwise(F.lit("HISTORICAL"))
    )
    from_live, from_db = F.col("source") == "LIVE", F.col("source") == "DATABASE"

    def pick(current: str, live_value: str, db_value: str | None) -> Column:
        out = F.when(from_live, F.coalesce(F.col(live_value), F.col(current)))
        if db_value is not None:
            out = out.when(from_db, F.coalesce(F.col(db_value), F.col(current)))
        return out.otherwise(F.col(current))

    return df.withColumns(
        {
            "temperature_c": pick("temperature_c", "live_t", "db_t"),
            "rainfall_mm": pick("rainfall_mm", "live_r", "db_r"),
            "humidity": pick("humidity", "live_h", "db_h"),
            "soil_moisture": pick("soil_moisture", "live_s", None),
            "confidence_source": X.encode("source", SOURCE_CONFIDENCE),
            "last_updated": F.when(from_live, F.col("live_at"))
            .when(from_db, F.col("db_date").cast("string"))
            .otherwise(X.month_start_text("year", "month")),
        }
    ).drop("live_t", "live_r", "live_h", "live_s", "live_at", "db_t", "db_r", "db_h", "db_date")


def distinct_places(panel: DataFrame, columns: Sequence[str] = ("latitude", "longitude", "climate_zone")) -> DataFrame:
    """City with the coordinates and zone of its first row."""
    first = F.min_by(F.struct(*columns), F.col("date"))
    return panel.groupBy("city").agg(first.alias("f")).select("city", "f.*")
