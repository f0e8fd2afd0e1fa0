"""Registered queries: a Spark function and, where SQL can say it, an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.functions import history as H
from skyledger.models import diagnostics as D
from skyledger.models import training as T
from skyledger.models.standin import class_probabilities
from skyledger.operators import analytics as A
from skyledger.operators import baselines as B
from skyledger.operators import cleaning as C
from skyledger.operators import drought as DR
from skyledger.operators import extreme as EX
from skyledger.operators import fitted as FT
from skyledger.operators import lookup as L
from skyledger.operators import quality as Q
from skyledger.operators import rainfall as RF
from skyledger.operators import rankings as RK
from skyledger.operators import rules as R
from skyledger.operators import scenario as S
from skyledger.operators import serving as V
from skyledger.operators import simulation as SM
from skyledger.operators.geo import nearest_place
from skyledger.operators.panel import absolute_risk_labels
from skyledger.plans import sql as q
from skyledger.plans.adapter import REGIONS, Tables, cents
from skyledger.session import materialize, scratch_path
from skyledger.sources import ingest as I
from skyledger.sources import readers as RD
from skyledger.streaming import jobs as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = date(2001, 9, 15)
BASE, TARGET, MONTH = q.BASE_YEAR, q.TARGET_YEAR, q.RANK_MONTH
EDA = ["rainfall_mm", "soil_moisture", "evabs", "sro", "temperature_c"]


def register(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register ``f(tables)`` under ``name``."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


def out(df: DataFrame, columns: Sequence[str | Column] | None = None, digits: int = 4) -> DataFrame:
    """Comparable output: rounded doubles, long integers, dates as text."""
    df = df if columns is None else df.select(*columns)

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return X.round_to(c, digits).alias(name)
        if kind in ("integer", "short", "byte"):
            return c.cast("long").alias(name)
        return c.cast("string").alias(name) if kind == "date" else c.alias(name)

    return df.select(*[one(f.name, f.dataType.typeName()) for f in df.schema.fields])


def features(name: str, cte: str, doubles: str, build: Callable[[DataFrame], DataFrame], longs: str = "", texts: str = "") -> None:
    """Register a feature bundle over the panel."""
    columns = [*doubles.split(), *longs.split(), *texts.split()]
    parts = [q.KEYS]
    if doubles:
        parts.append(q.rs(doubles))
    if longs:
        parts.append(q.ints(longs))
    parts += texts.split()
    sql = q.query((cte,), f"SELECT {', '.join(parts)} FROM {cte}")
    register(name, sql)(lambda t: out(build(t.panel), ["city", "date", *columns]))


# --- panel and feature bundles -------------------------------------------------------------------

PANEL_DOUBLES = " ".join(
    c for c in K.PANEL_COLUMNS if c not in ("city", "climate_zone", "date", "year", "month", "drought_risk", "heatwave_risk")
)
features(
    "base_panel", "master", PANEL_DOUBLES, lambda p: p, "year month", "climate_zone drought_risk heatwave_risk"
)
register(
    "monsoon_calendar",
    q.query(
        ("master",),
        f"""SELECT {q.KEYS}, CAST(is_monsoon AS BIGINT) AS is_monsoon, CAST(pre_monsoon AS BIGINT) AS pre_monsoon,
        CAST(post_monsoon AS BIGINT) AS post_monsoon, CAST(is_winter_dry AS BIGINT) AS is_winter_dry, CAST(monsoon_phase AS BIGINT) AS monsoon_phase,
        {q.r("sin(2 * pi() * monsoon_phase / 6.0)", 4, "monsoon_phase_sin")}, {q.r("cos(2 * pi() * monsoon_phase / 6.0)", 4, "monsoon_phase_cos")}
        FROM (SELECT *, (month BETWEEN 6 AND 9)::INT AS is_monsoon, (month BETWEEN 3 AND 5)::INT AS pre_monsoon,
        (month IN (10, 11))::INT AS post_monsoon, (month IN (12, 1, 2))::INT AS is_winter_dry,
        CASE WHEN month IN (12, 1, 2) THEN 0 WHEN month <= 5 THEN 1 WHEN month = 6 THEN 2 WHEN month <= 8 THEN 3 WHEN month = 9 THEN 4 ELSE 5 END AS monsoon_phase
        FROM master)""",
    ),
)(
    lambda t: out(
        RF.monsoon(t.panel),
        ["city", "date", *K.SEASON_MONTHS, "monsoon_phase", "monsoon_phase_sin", "monsoon_phase_cos"],
    )
)
features(
    "rain_anomaly", "rain_streaks",
    "rainfall_climatology rainfall_anomaly rainfall_anomaly_pct rolling_rainfall_std_3m rolling_rainfall_std_6m "
    "rolling_rainfall_cv_3m rolling_rainfall_median_3m rolling_rainfall_median_6m",
    RF.rain_anomaly, "dry_months_streak wet_months_streak",
)
features(
    "rain_momentum", "rain",
    "rainfall_trend rainfall_acceleration rainfall_growth_rate rainfall_momentum rainfall_seasonal_deviation",
    RF.rain_momentum,
)
features("temp_anomaly", "rain", "temperature_climatology temperature_anomaly temp_trend_3m", RF.temperature_anomaly)
features(
    "land_trends", "rain", "soil_moisture_trend evabs_trend sro_trend soil_moisture_zone_anomaly", RF.land_trends
)
features(
    "zone_relative_rain", "rain",
    "zone_rainfall_climatology zone_rainfall_anomaly zone_rainfall_anomaly_pct zone_rainfall_zscore",
    RF.zone_relative_rain,
)
register(
    "rainfall_dataset",
    q.query(
        ("rain_streaks",),
        "SELECT city, year, month, "
        + ", ".join(f"CAST((climate_zone = '{z}')::INT AS BIGINT) AS \"climate_zone_{z}\"" for z in REGIONS)
        + ", "
        + q.rs("rainfall_mm rainfall_anomaly rolling_rainfall_median_6m rainfall_seasonal_deviation sro_trend zone_rainfall_zscore")
        + ", dry_months_streak, wet_months_streak FROM rain_streaks WHERE rolling_rainfall_std_3m IS NOT NULL "
        "AND rolling_rainfall_median_6m IS NOT NULL AND sro_trend IS NOT NULL AND rainfall_seasonal_deviation IS NOT NULL",
    ),
)(
    lambda t: out(
        RF.rainfall_dataset(t.panel, REGIONS),
        ["city", "year", "month", *[f"climate_zone_{z}" for z in REGIONS], "rainfall_mm", "rainfall_anomaly",
         "rolling_rainfall_median_6m", "rainfall_seasonal_deviation", "sro_trend", "zone_rainfall_zscore",
         "dry_months_streak", "wet_months_streak"],
    )
)
features(
    "water_balance", "dr1",
    "water_balance rainfall_evap_ratio rainfall_runoff_ratio evaporation_pressure runoff_efficiency", DR.water_balance,
)
features(
    "rain_deficit", "dr2",
    "rainfall_climatology rainfall_deficit rainfall_deficit_pct rainfall_spi rainfall_deficit_lag1 "
    "cumulative_deficit_3m cumulative_deficit_6m",
    DR.rain_deficit,
)
features(
    "soil_features", "dr3",
    "sm_anomaly sm_zscore sm_deficit sm_deficit_pct rolling_sm_3m rolling_sm_6m sm_trend sm_zone_anomaly",
    DR.soil_features, "low_sm_streak",
)
features(
    "temp_stress", "dr1", "temperature_anomaly temperature_zscore temperature_stress heat_excess", DR.temp_stress
)


def _deficits(panel: DataFrame) -> DataFrame:
    return DR.soil_features(DR.rain_deficit(panel))


features(
    "drought_persistence", "dr3", "cumulative_sm_deficit_3m cumulative_sm_deficit_6m drought_recovery",
    lambda p: DR.persistence(_deficits(p)), "dry_month_streak deficit_streak",
)
features(
    "drought_evolution", "dr3", "drought_momentum drought_acceleration drought_trend deficit_volatility_3m",
    lambda p: DR.evolution(DR.rain_deficit(p)),
)
features(
    "zone_drought", "dr1", "zone_rain_deficit zone_rain_zscore zone_sm_deficit zone_sm_zscore zone_aridity_index",
    DR.zone_drought,
)
features(
    "water_stress", "dr2",
    "water_availability_index hydrological_stress moisture_stress evaporation_stress compound_drought_stress",
    lambda p: DR.water_stress(DR.temp_stress(_deficits(p))),
)
features("drought_score", "dr_score", "drought_severity_score", DR.drought_features)
features(
    "drought_category", "dr_cat", "drought_severity_score", DR.drought_features, "drought_category_ordinal",
    "drought_category",
)


FITTED = (
    "rainfall_deficit rainfall_spi sm_zscore temperature_zscore zone_rain_zscore zone_aridity_index evaporation_stress "
    "hydrological_stress drought_severity_score"
)


def _fitted_drought(panel: DataFrame) -> DataFrame:
    """Baselines of the earlier years stored, read back and applied to all years."""
    path = scratch_path(panel.sparkSession, "drought-fit")
    FT.fit_drought(panel, path, q.FIT_UNTIL)
    return FT.apply_drought(panel, path)


features("fitted_drought", "fit3", FITTED, _fitted_drought, texts="drought_category")


def _fitted_extreme(panel: DataFrame) -> DataFrame:
    """As :func:`_fitted_drought` for heat and extreme rain."""
    path = scratch_path(panel.sparkSession, "extreme-fit")
    FT.fit_extreme(panel, path, q.FIT_UNTIL)
    return FT.apply_extreme(panel, path)


features(
    "fitted_extreme", "fx4",
    "hw_temperature_anomaly hw_temperature_zscore hw_heat_stress hw_zone_temp_zscore hw_seasonal_heat_deviation er_rainfall_anomaly "
    "er_rainfall_zscore er_zone_rainfall_anomaly er_seasonal_rainfall_deviation heatwave_severity_score extreme_rainfall_score",
    _fitted_extreme, texts="heatwave_category extreme_rainfall_category",
)
FITTED_RAIN = (
    "rainfall_mm rainfall_anomaly rainfall_anomaly_pct rainfall_momentum rainfall_seasonal_deviation temperature_anomaly "
    "soil_moisture_zone_anomaly zone_rainfall_anomaly zone_rainfall_zscore"
)


@register("fitted_rainfall", q.query(("fr",), f"SELECT city, year, month, {q.rs(FITTED_RAIN)} FROM fr"))
def fitted_rainfall(t: Tables) -> DataFrame:
    """The rainfall training table by normals of the earlier years, stored and read back."""
    path = scratch_path(t.spark, "rainfall-fit")
    FT.fit_rainfall(t.panel, path, q.FIT_UNTIL)
    return out(FT.apply_rainfall(t.panel, path, REGIONS), ["city", "year", "month", *FITTED_RAIN.split()])


features(
    "climatology", "climo",
    "temp_climo_mean temp_climo_std rain_climo_mean rain_climo_std sm_climo_mean sm_climo_std zone_temp_mean zone_temp_std "
    "zone_rain_mean zone_rain_std seasonal_temp_mean seasonal_rain_mean",
    EX.climatology_baselines,
)
HW = (
    "hw_temperature_anomaly hw_temperature_zscore hw_heat_excess hw_heat_stress hw_heatwave_intensity hw_rolling_heat_3m "
    "hw_rolling_heat_6m hw_heat_acceleration hw_dry_heat_indicator hw_rainfall_heat_interaction hw_soil_heat_interaction "
    "hw_evaporation_heat_ratio hw_climate_zone_heat_anomaly hw_zone_temp_zscore hw_seasonal_heat_deviation "
    "hw_rolling_temp_trend_3m hw_apparent_temperature hw_apparent_temp_anomaly hw_compound_heat_drought"
)
ER = (
    "er_rainfall_anomaly er_rainfall_zscore er_rainfall_intensity er_rainfall_surge er_rainfall_acceleration "
    "er_rainfall_momentum er_rainfall_variability_3m er_rainfall_variability_6m er_extreme_precipitation_index "
    "er_runoff_pressure er_runoff_response er_soil_saturation er_flood_potential_proxy er_antecedent_soil_moisture "
    "er_water_surplus er_zone_rainfall_anomaly er_zone_rainfall_zscore er_seasonal_rainfall_deviation "
    "er_cumulative_rain_3m er_cumulative_rain_6m er_monsoon_phase_factor er_evaporation_demand_ratio "
    "er_compound_rainfall_saturation"
)
features(
    "heatwave_features", "ew", HW, lambda p: EX.heatwave_features(EX.climatology_baselines(p)),
    "hw_consecutive_hot_months",
)
features(
    "extreme_rain_features", "ew", ER, lambda p: EX.extreme_rain_features(EX.climatology_baselines(p)),
    "er_consecutive_wet_months er_is_monsoon",
)
features(
    "heatwave_score", "ew_score", "heatwave_severity_score",
    lambda p: EX.heatwave_score(materialize(EX.heatwave_features(EX.climatology_baselines(p)))),
)
features(
    "extreme_rain_score", "ew_score", "extreme_rainfall_score",
    lambda p: EX.extreme_rain_score(materialize(EX.extreme_rain_features(EX.climatology_baselines(p)))),
)
register(
    "extreme_categories",
    q.query(
        ("ew_cat",),
        f"""SELECT {q.KEYS}, heatwave_category, extreme_rainfall_category,
        CAST({q.ORDINAL.format("heatwave_category")} AS BIGINT) AS heatwave_category_ordinal,
        CAST({q.ORDINAL.format("extreme_rainfall_category")} AS BIGINT) AS extreme_rainfall_category_ordinal FROM ew_cat""",
    ),
)(
    lambda t: out(
        EX.extreme_features(t.panel),
        ["city", "date", "heatwave_category", "extreme_rainfall_category", "heatwave_category_ordinal",
         "extreme_rainfall_category_ordinal"],
    )
)


@register(
    "zone_insights",
    q.query(
        ("ew_cat",),
        f"""SELECT climate_zone, {q.rs("hw_mean hw_std hw_max hw_extreme_pct er_mean er_std er_max er_extreme_pct")} FROM (
        SELECT climate_zone, avg(heatwave_severity_score) AS hw_mean, stddev_samp(heatwave_severity_score) AS hw_std, max(heatwave_severity_score) AS hw_max,
        avg(CASE WHEN heatwave_category = 'Extreme' THEN 1.0 ELSE 0.0 END) * 100.0 AS hw_extreme_pct,
        avg(extreme_rainfall_score) AS er_mean, stddev_samp(extreme_rainfall_score) AS er_std, max(extreme_rainfall_score) AS er_max,
        avg(CASE WHEN extreme_rainfall_category = 'Extreme' THEN 1.0 ELSE 0.0 END) * 100.0 AS er_extreme_pct FROM ew_cat GROUP BY 1)""",
    ),
)
def zone_insights(t: Tables) -> DataFrame:
    df = materialize(EX.extreme_features(t.panel))
    parts = []
    for p, score, cat in (
        ("hw", "heatwave_severity_score", "heatwave_category"),
        ("er", "extreme_rainfall_score", "extreme_rainfall_category"),
    ):
        z = EX.score_by_zone(df, score, cat)
        parts.append(z.select("climate_zone", *[F.col(c).alias(f"{p}_{c.removesuffix('_score')}") for c in z.columns[1:]]))
    return out(parts[0].join(parts[1], "climate_zone"))


def _frame_sql(name: str, key: str, value: str) -> str:
    return f"SELECT '{name}' AS frame, CAST({key} AS VARCHAR) AS key, {value} AS value FROM ew_cat GROUP BY {key}"


register(
    "zone_insight_frames",
    q.query(
        ("ew_cat",),
        f"SELECT frame, key, {q.r('value')} FROM ("
        + " UNION ALL ".join(
            _frame_sql(*frame)
            for name, score in (("heatwave", "heatwave_severity_score"), ("extreme_rainfall", "extreme_rainfall_score"))
            for frame in (
                (f"{name}_by_zone", "climate_zone", f"avg({score})"),
                (f"extreme_{name}_pct_by_zone", "climate_zone", f"avg(CASE WHEN {name}_category = 'Extreme' THEN 1.0 ELSE 0.0 END) * 100.0"),
                (f"{name}_by_month", "month", f"avg({score})"),
            )
        )
        + ")",
    ),
)(
    lambda t: out(
        reduce(
            DataFrame.unionByName,
            [
                f.select(F.lit(name).alias("frame"), F.col(f.columns[0]).cast("string").alias("key"), F.col(f.columns[1]).alias("value"))
                for name, f in EX.zone_insights(materialize(EX.extreme_features(t.panel))).items()
            ],
        )
    )
)
register(
    "score_seasonality",
    q.query(
        ("ew_score",),
        f"""SELECT month, {q.rs("mean_heatwave_severity_score mean_extreme_rainfall_score")} FROM (SELECT month,
        avg(heatwave_severity_score) AS mean_heatwave_severity_score, avg(extreme_rainfall_score) AS mean_extreme_rainfall_score FROM ew_score GROUP BY 1)""",
    ),
)(
    lambda t: out(
        EX.score_by_month(EX.extreme_features(t.panel), ["heatwave_severity_score", "extreme_rainfall_score"])
    )
)
register(
    "absolute_risk_labels",
    q.query(
        ("master",),
        f"""SELECT {q.KEYS}, CASE WHEN rolling_rainfall_3m < 30 AND temperature_c > 35 THEN 'High' WHEN rolling_rainfall_3m < 60 AND temperature_c > 30 THEN 'Medium' ELSE 'Low' END AS absolute_drought_risk,
        CASE WHEN temperature_c >= 45 THEN 'Critical' WHEN temperature_c >= 40 THEN 'High' WHEN temperature_c >= 36 THEN 'Medium' ELSE 'Low' END AS absolute_heatwave_risk FROM master""",
    ),
)(lambda t: out(absolute_risk_labels(t.panel), ["city", "date", "absolute_drought_risk", "absolute_heatwave_risk"]))


def _daily(t: Tables) -> DataFrame:
    """User by day totals; a user's many events are one line per day before any window."""
    day = F.col("ts").cast("date").alias("date")
    bought = F.when(F.col("event_type") == "purchase", cents("value"))
    return t.read("events").groupBy(F.col("user_id").cast("string").alias("city"), day).agg(
        (F.sum(cents("value")).cast("double") / F.lit(100.0)).alias("total"),
        (F.sum(bought).cast("double") / F.lit(100.0)).alias("bought"),
    )


q.cte(
    "daily", (),
    """SELECT CAST(user_id AS VARCHAR) AS city, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
    CAST(sum(CAST(CASE WHEN event_type = 'purchase' THEN value END AS DECIMAL(18,2))) AS DOUBLE) AS bought FROM events GROUP BY 1, 2""",
)
q.cte(
    "daily_streaks", ("daily",),
    q.streaks(f"SELECT *, lag(total) {q.W} AS prev FROM daily", {"busy": "prev > 100", "quiet": "prev < 50"}),
)
register("streaks", q.query(("daily_streaks",), f"SELECT {q.KEYS}, busy, quiet FROM daily_streaks"))(
    lambda t: out(
        H.add_streaks(H.by_entity(_daily(t)), {"busy": H.lag("total") > 100.0, "quiet": H.lag("total") < 50.0}),
        ["city", "date", "busy", "quiet"],
    )
)
register(
    "gap_fill",
    q.query(
        ("daily",),
        f"""SELECT {q.KEYS}, {q.r("filled")} FROM (SELECT city, date, coalesce(bought,
        first_value(bought IGNORE NULLS) OVER (PARTITION BY city ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        last_value(bought IGNORE NULLS) OVER (PARTITION BY city ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS filled FROM daily)""",
    ),
)(lambda t: out(H.by_entity(_daily(t)).withColumn("filled", H.fill_both_ways("bought")), ["city", "date", "filled"]))


# --- analytics -----------------------------------------------------------------------------------

register(
    "district_summary",
    q.query(
        ("obs", "fcst"),
        f"""SELECT district_id, coalesce(average_rainfall, 0.0) AS average_rainfall, coalesce(average_temperature, 0.0) AS average_temperature,
        coalesce(average_humidity, 0.0) AS average_humidity, coalesce(average_predicted_rainfall, 0.0) AS average_predicted_rainfall,
        coalesce(average_predicted_temperature, 0.0) AS average_predicted_temperature, coalesce(o, 0) AS observation_count, coalesce(f, 0) AS forecast_count
        FROM (SELECT district_id, {q.MEANS}, count(*) AS o FROM obs GROUP BY 1) FULL JOIN
        (SELECT district_id, {q.mean2("predicted_rainfall", "average_predicted_rainfall")}, {q.mean2("predicted_temperature", "average_predicted_temperature")}, count(*) AS f FROM fcst GROUP BY 1) USING (district_id)""",
    ),
)(lambda t: out(A.district_summary(t.observations, t.forecasts)))
register(
    "state_summary",
    q.query(
        ("obs", "districts"),
        f"SELECT lower(state) AS state, {q.MEANS}, count(*) AS observation_count FROM obs JOIN districts USING (district_id) GROUP BY 1",
    ),
)(lambda t: out(A.state_summary(t.observations, t.districts)))
for _level, _unit in (("weekly", "week"), ("monthly", "month"), ("yearly", "year")):
    register(
        f"period_trend_{_unit}",
        q.query(
            ("obs",),
            f"""SELECT district_id, CAST(CAST(date_trunc('{_unit}', observation_date) AS DATE) AS VARCHAR) AS period, {q.MEANS}, count(*) AS observation_count
            FROM obs WHERE observation_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY 1, 2""",
        ),
    )(lambda t, level=_level: out(A.period_trend(t.observations, level, date(2024, 1, 3), date(2024, 1, 28))))
register(
    "rainfall_series",
    q.query(
        ("obs",),
        f"""SELECT district_id, point, CAST(observation_date AS VARCHAR) AS observation_date, {q.r("rainfall")} FROM (SELECT *,
        row_number() OVER (PARTITION BY district_id ORDER BY observation_date, id) AS point FROM obs) WHERE point <= 20""",
    ),
)(lambda t: out(A.time_series(t.observations, "rainfall", 20)))
q.cte(
    "comparison", ("obs", "districts"),
    f"""SELECT d.district_id, district_name, state, {q.MEANS}, count(o.id) AS observation_count
    FROM districts d LEFT JOIN obs o USING (district_id) GROUP BY 1, 2, 3""",
)
register("district_comparison", q.query(("comparison",), "SELECT * FROM comparison"))(
    lambda t: out(A.district_comparison(t.observations, t.districts))
)
register(
    "district_page",
    q.query(("comparison",), "SELECT * FROM comparison ORDER BY district_name, district_id LIMIT 25 OFFSET 50"),
)(lambda t: out(A.page(A.district_comparison(t.observations, t.districts), ["district_name", "district_id"], 50, 25)))
register(
    "district_vs_overall",
    q.query(
        ("comparison", "obs"),
        f"""SELECT c.*, a.overall_rainfall, a.overall_temperature, a.overall_humidity,
        {", ".join(q.r(f"average_{m} - overall_{m}", 2, f"difference_{m}") for m in A.MEASURES)}
        FROM comparison c CROSS JOIN (SELECT {", ".join(q.mean2(m, f"overall_{m}") for m in A.MEASURES)} FROM obs) a""",
    ),
)(lambda t: out(A.district_vs_overall(t.observations, t.districts)))
register(
    "overview_counts",
    "SELECT 'districts' AS entity, count(*) AS total FROM customer UNION ALL SELECT 'observations', count(*) FROM events "
    "UNION ALL SELECT 'forecasts', count(*) FROM orders",
)(
    lambda t: A.entity_counts(
        {"districts": t.districts, "observations": t.observations, "forecasts": t.forecasts}
    )
)
for _metric, (_measure, _down) in A.LEADERBOARDS.items():
    register(
        f"top_{_metric}",
        q.query(
            ("obs", "districts"),
            f"""SELECT district_id, district_name, state, round(v, 2) AS value FROM (SELECT min(district_id) AS district_id, district_name, state,
            {q.mean(_measure)} AS v FROM obs JOIN districts USING (district_id) GROUP BY 2, 3) ORDER BY v {"DESC" if _down else "ASC"}, district_id LIMIT 5""",
        ),
    )(lambda t, metric=_metric: out(A.leaderboard(t.observations, t.districts, metric)))
register(
    "top_hottest_in_state",
    q.query(
        ("obs", "districts"),
        f"""SELECT district_id, district_name, state, round(v, 2) AS value FROM (SELECT min(district_id) AS district_id, district_name, state,
        {q.mean("temperature")} AS v FROM obs JOIN districts USING (district_id) WHERE lower(state) = 'nation_7' GROUP BY 2, 3) ORDER BY v DESC, district_id LIMIT 5""",
    ),
)(lambda t: out(A.leaderboard(t.observations, t.districts, "hottest", state="Nation_7")))
register(
    "coldest_in_month",
    q.query(
        ("obs", "districts"),
        """SELECT district_id, district_name, state, round(v, 2) AS value FROM (SELECT min(district_id) AS district_id, district_name, state,
        max(temperature) AS v FROM obs JOIN districts USING (district_id) WHERE month(observation_date) = 1 GROUP BY 2, 3) ORDER BY v ASC, district_id LIMIT 5""",
    ),
)(lambda t: out(A.coldest_in_month(t.observations, t.districts, 1)))
register(
    "latest_per_district",
    q.query(
        ("obs",),
        f"""SELECT id, district_id, {q.rs("rainfall temperature humidity")}, CAST(observation_date AS VARCHAR) AS observation_date FROM
        (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY observation_date DESC, id DESC) AS rn FROM obs) WHERE rn = 1""",
    ),
)(lambda t: out(A.latest_per_district(t.observations)))
register(
    "latest_forecasts",
    q.query(
        ("fcst",),
        f"""SELECT id, district_id, {q.rs("predicted_rainfall predicted_temperature")}, CAST(forecast_date AS VARCHAR) AS forecast_date
        FROM fcst ORDER BY fcst.forecast_date DESC, id DESC LIMIT 5""",
    ),
)(lambda t: out(A.latest(t.forecasts, ["forecast_date", "id"])))
register(
    "active_forecasts",
    q.query(
        ("fcst",),
        f"""SELECT id, district_id, {q.rs("predicted_rainfall predicted_temperature")}, CAST(forecast_date AS VARCHAR) AS forecast_date
        FROM fcst WHERE forecast_date >= DATE '2001-07-01'""",
    ),
)(lambda t: out(A.active_forecasts(t.forecasts, date(2001, 7, 1))))
register(
    "keyed_scan",
    "SELECT event_id, user_id, round(value, 4) AS value FROM events WHERE event_type = 'purchase'".replace(
        "round(value, 4)", q.half_away("round(value, 4)")
    ),
)(lambda t: out(A.for_key(t.read("events"), "event_type", "purchase"), ["event_id", "user_id", "value"]))


# --- quality -------------------------------------------------------------------------------------

q.cte(
    "dist", ("master",),
    """SELECT c AS category, (SELECT count(*) FROM master WHERE drought_risk = c) AS rows, (SELECT count(*) FROM master) AS n
    FROM (VALUES ('Low'), ('Medium'), ('High'), ('Extreme')) v(c)""",
)
register(
    "class_distribution", q.query(("dist",), "SELECT category, rows, round(100.0::DOUBLE * rows / n, 1) AS pct FROM dist")
)(lambda t: out(Q.class_distribution(t.panel, "drought_risk", K.RISK_CLASSES)))
register(
    "class_balance",
    q.query(
        ("dist",),
        f"""SELECT {q.r("imbalance_ratio")}, CASE WHEN imbalance_ratio < 2 THEN 'Mild' WHEN imbalance_ratio < 5 THEN 'Moderate' ELSE 'Severe' END AS verdict
        FROM (SELECT max(rows) / (min(rows) + 1)::DOUBLE AS imbalance_ratio FROM dist)""",
    ),
)(lambda t: out(Q.class_balance(Q.class_distribution(t.panel, "drought_risk", K.RISK_CLASSES))))


def _profile_sql(columns: Sequence[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS name, avg({c}) AS mean, stddev_samp({c}) AS std, skewness({c}) AS skew, quantile_cont({c}, 0.1) AS p10,
        quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.9) AS p90,
        count({c}) AS count, min({c}) AS min, max({c}) AS max FROM master"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


q.cte("profile", ("master",), _profile_sql(EDA))
register("profile", q.query(("profile",), f"SELECT name, {q.rs('mean std skew p10 p25 p50 p75 p90')} FROM profile"))(
    lambda t: out(Q.profile(t.panel, EDA))
)
register("describe", q.query(("profile",), f"SELECT name, count, {q.rs('min max mean std p25 p50 p75')} FROM profile"))(
    lambda t: out(Q.describe(t.panel, EDA))
)
register(
    "zone_means",
    q.query(
        ("master",),
        f"""SELECT climate_zone, {q.rs("mean_rainfall_mm mean_soil_moisture")} FROM (SELECT climate_zone, avg(rainfall_mm) AS mean_rainfall_mm,
        avg(soil_moisture) AS mean_soil_moisture FROM master GROUP BY 1)""",
    ),
)(lambda t: out(Q.mean_by(t.panel, "climate_zone", ["rainfall_mm", "soil_moisture"])))


def _spearman_sql(columns: Sequence[str]) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS k_{c}" for c in columns
    )
    pairs = [
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {q.r(f'corr(k_{a}, k_{b})', 4, 'spearman')} FROM ranks"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    q.cte("ranks", ("master",), f"SELECT {ranks} FROM master")
    return q.query(("ranks",), " UNION ALL ".join(pairs))


register("spearman", _spearman_sql(EDA))(lambda t: out(Q.spearman(t.panel, EDA)))
QUALITY_FEATURES = [
    "rainfall_spi", "sm_zscore", "temperature_zscore", "evaporation_pressure", "rainfall_deficit", "temperature_c",
    "rainfall_mm", "soil_moisture", "drought_momentum", "latitude",
]
register(
    "feature_quality",
    q.query(
        ("dr_score",),
        "SELECT feature, "
        + q.rs("abs_corr variance")
        + ", CASE WHEN abs_corr >= 0.5 THEN 'mandatory' WHEN abs_corr >= 0.2 THEN 'useful' ELSE 'experimental' END AS tier FROM ("
        + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, abs(corr({f}, drought_severity_score)) AS abs_corr, var_samp({f}) AS variance FROM dr_score"
            for f in QUALITY_FEATURES
        )
        + ")",
    ),
)(
    lambda t: out(
        Q.feature_quality(DR.drought_features(t.panel), QUALITY_FEATURES, "drought_severity_score", Q.TIERS["drought"])
    )
)
COLLINEAR = [
    "temperature_c", "rainfall_mm", "soil_moisture", "sro", "rolling_temp_3m", "rolling_temp_6m", "rolling_rainfall_3m",
    "rolling_rainfall_6m", "temperature_prev_1", "rainfall_prev_1",
]
register(
    "collinear_pairs",
    q.query(
        ("master",),
        f"SELECT \"left\", \"right\", {q.r('abs_corr')} FROM ("
        + " UNION ALL ".join(
            f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", abs(corr({a}, {b})) AS abs_corr FROM master"
            for i, a in enumerate(COLLINEAR)
            for b in COLLINEAR[i + 1 :]
        )
        + ") WHERE abs_corr > 0.5",
    ),
)(lambda t: out(Q.collinear_pairs(t.panel, COLLINEAR, 0.5)))
QUALITY_COLUMNS = ["temperature_prev_3", "rolling_rainfall_6m", "target_rainfall_next_month", "soil_moisture", "evabs"]


@register(
    "data_quality",
    q.query(
        ("hist",),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER (isinf({c})) AS infinite,
            {q.r(f"var_samp({c})", 4, "variance")}, var_samp({c}) < 1e-6 AS near_constant FROM hist"""
            for c in QUALITY_COLUMNS
        ),
    ),
)
def data_quality(t: Tables) -> DataFrame:
    """The panel before incomplete rows are dropped, to have something to report."""
    raw = materialize(t.raw_panel)
    from skyledger.operators.panel import convert_units

    df = H.by_entity(convert_units(raw)).withColumns(
        {
            "temperature_prev_3": H.lag("temperature_c", 3),
            "rolling_rainfall_6m": H.rolling("rainfall_mm", 6, F.avg, 6, lagged=False),
            "target_rainfall_next_month": H.lead("rainfall_mm"),
        }
    )
    return out(Q.data_quality(df, QUALITY_COLUMNS))


register(
    "duplicate_rows",
    """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM
    (SELECT l_suppkey, l_returnflag, CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY l_suppkey, l_returnflag, d)""",
)(
    lambda t: Q.duplicate_rows(
        t.read("lineitem").select("l_suppkey", "l_returnflag", F.col("l_shipdate").cast("date").alias("d"))
    )
)
register(
    "iqr_outliers",
    q.half_away(f"""WITH f AS (SELECT quantile_cont(l_extendedprice, 0.75) + 0.2::DOUBLE * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS fence FROM lineitem)
    SELECT {q.r("max(fence)", 4, "fence")}, count(*) FILTER (l_extendedprice > fence) AS outliers,
    {q.r("100.0::DOUBLE * count(*) FILTER (l_extendedprice > fence) / count(*)", 4, "pct")} FROM lineitem CROSS JOIN f"""),
)(lambda t: out(Q.iqr_outliers(t.read("lineitem"), "l_extendedprice", width=0.2)))
register(
    "coverage",
    q.query(
        ("master",),
        f"""SELECT count(*) AS rows, count(DISTINCT city) AS cities, count(DISTINCT climate_zone) AS zones, CAST(min(date) AS VARCHAR) AS first_date,
        CAST(max(date) AS VARCHAR) AS last_date, {q.r("min(temperature_c)", 4, "min_temperature_c")}, {q.r("max(temperature_c)", 4, "max_temperature_c")} FROM master""",
    ),
)(lambda t: out(Q.coverage(t.panel, ["temperature_c"])))
register(
    "rows_per_zone", q.query(("master",), "SELECT climate_zone, count(*) AS rows FROM master GROUP BY 1")
)(lambda t: Q.rows_per_zone(t.panel))
register(
    "first_coordinates",
    q.query(("master",), f"SELECT DISTINCT city, {q.rs('latitude longitude')}, climate_zone FROM master"),
)(lambda t: out(Q.first_coordinates(t.panel)))


# --- sources and ingest --------------------------------------------------------------------------

q.cte(
    "import_rows", (),
    """SELECT event_id AS row, CASE event_id % 17 WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN CAST(user_id + 100000000 AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS district_id,
    CASE WHEN event_id % 17 = 4 THEN NULL ELSE CAST(value AS DOUBLE) END AS rainfall, CASE WHEN event_id % 17 = 5 THEN NULL ELSE CAST(value AS DOUBLE) END AS temperature,
    CASE WHEN event_id % 17 = 6 THEN 140.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS humidity,
    CASE WHEN event_id % 17 = 7 THEN NULL ELSE CAST(ts AS DATE) END AS d, event_id % 17 AS kind, user_id FROM events""",
)
q.cte(
    "import_rules", ("import_rows",),
    """SELECT *, CASE WHEN kind = 1 THEN 'missing key' WHEN kind = 2 THEN 'district is not a number' WHEN user_id + CASE WHEN kind = 3 THEN 100000000 ELSE 0 END NOT IN (SELECT c_custkey FROM customer) THEN 'unknown district'
    WHEN d IS NULL THEN 'invalid date' END AS key_error,
    CASE WHEN rainfall IS NULL THEN 'rainfall is not a number' WHEN temperature IS NULL THEN 'temperature is not a number' WHEN humidity NOT BETWEEN 0 AND 100 THEN 'humidity out of range' END AS measure_error FROM import_rows""",
)
q.cte(
    "import_status", ("import_rules",),
    """SELECT *, CASE WHEN repeat THEN 'duplicate' WHEN coalesce(key_error, measure_error) IS NULL THEN 'accepted' ELSE 'failed' END AS status,
    CASE WHEN key_error IS NOT NULL THEN key_error WHEN NOT repeat THEN measure_error END AS error FROM (
    SELECT i.*, key_error IS NULL AND (s.user_id IS NOT NULL OR coalesce(row > min(CASE WHEN key_error IS NULL AND measure_error IS NULL THEN row END) OVER (PARTITION BY i.user_id, i.d, key_error IS NULL), FALSE)) AS repeat
    FROM import_rules i LEFT JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup') s ON i.user_id = s.user_id AND i.d = s.d)""",
)


def _validated(t: Tables) -> DataFrame:
    return I.validate(t.import_rows, t.districts.select("district_id"), t.store)


register("import_validate", q.query(("import_status",), "SELECT row, status, error FROM import_status"))(
    lambda t: _validated(t).select("row", "status", "error")
)
register(
    "import_accepted",
    q.query(
        ("import_status",),
        f"SELECT user_id AS district_id, CAST(d AS VARCHAR) AS observation_date, {q.rs('rainfall temperature humidity')} FROM import_status WHERE status = 'accepted'",
    ),
)(lambda t: out(I.accepted_rows(_validated(t))))
register(
    "import_quarantine",
    q.query(("import_status",), "SELECT row, error, user_id % 1 = 0 AS has_raw FROM import_status WHERE status = 'failed'"),
)(lambda t: I.quarantine(_validated(t)).select("row", "error", F.col("raw_data").isNotNull().alias("has_raw")))
register(
    "import_summary",
    q.query(
        ("import_status",),
        """SELECT count(*) AS processed_rows, count(*) FILTER (status = 'accepted') AS success_count,
        count(*) FILTER (status = 'duplicate') AS duplicate_skipped, count(*) FILTER (status = 'failed') AS failed_count FROM import_status""",
    ),
)(lambda t: I.import_summary(_validated(t)))
q.cte(
    "payload_rows", (),
    """SELECT l_orderkey AS payload_id, o_custkey AS district_id, CAST(max(l_shipdate) AS DATE) AS observation_date,
    coalesce(max(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 0.0) AS rainfall,
    coalesce(max(CASE WHEN l_linestatus = 'O' THEN l_tax * 500.0::DOUBLE END), 25.0) AS temperature,
    coalesce(max(CASE WHEN l_returnflag <> 'N' THEN l_discount * 1000.0::DOUBLE END), 50.0) AS humidity, l_linenumber - 1 AS day_index
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_custkey, l_linenumber""",
)
# An order with fewer than seven lines leaves days without a date.
q.cte(
    "failed_days", (),
    """SELECT o_custkey AS district_id, 7 - count(DISTINCT l_linenumber) AS failed_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY l_orderkey, o_custkey HAVING count(DISTINCT l_linenumber) < 7""",
)


def _payload_rows(t: Tables) -> DataFrame:
    return RD.daily_rows(t.payloads, F.lit(AS_OF))


register(
    "payload_explode",
    q.query(
        ("payload_rows",),
        f"""SELECT district_id, CAST(day_index AS BIGINT) AS day_index, CAST(observation_date AS VARCHAR) AS observation_date, {q.rs("rainfall temperature humidity")}
        FROM payload_rows WHERE observation_date < DATE '2001-09-15'""",
    ),
)(lambda t: out(_payload_rows(t)))


def _past_keys(t: Tables) -> DataFrame:
    """Keys stored before: (customer, order date) of finished orders."""
    return (
        t.read("orders")
        .filter(F.col("o_orderstatus") == "F")
        .select(F.col("o_custkey").alias("district_id"), F.col("o_orderdate").cast("date").alias("observation_date"))
        .distinct()
    )


PAST = "(SELECT DISTINCT o_custkey AS district_id, CAST(o_orderdate AS DATE) AS observation_date FROM orders WHERE o_orderstatus = 'F')"
register(
    "dedup_ingest",
    q.query(
        ("payload_rows",),
        f"""SELECT district_id, CAST(observation_date AS VARCHAR) AS observation_date, {q.rs("rainfall temperature humidity")} FROM (
        SELECT *, row_number() OVER (PARTITION BY district_id, observation_date ORDER BY day_index, rainfall, temperature, humidity) AS rn FROM payload_rows
        WHERE observation_date < DATE '2001-09-15') p ANTI JOIN {PAST} s USING (district_id, observation_date) WHERE rn = 1""",
    ),
)(
    lambda t: out(
        I.new_rows(
            _payload_rows(t), _past_keys(t), I.KEY, ["day_index", "rainfall", "temperature", "humidity"]
        ).drop("day_index"),
        ["district_id", "observation_date", "rainfall", "temperature", "humidity"],
    )
)
register(
    "ingest_summary",
    q.query(
        ("payload_rows", "failed_days"),
        f"""SELECT coalesce(a.district_id, b.district_id) AS district_id, coalesce(observations_processed, 0) AS observations_processed,
        coalesce(observations_inserted, 0) AS observations_inserted, coalesce(duplicates_skipped, 0) AS duplicates_skipped,
        coalesce(failed_payloads, 0) AS failed_payloads, coalesce(failed_days, 0) AS failed_days,
        CASE WHEN failed_payloads > 0 THEN 'not a date' ELSE '' END AS errors FROM (SELECT district_id, CAST(sum(n) AS BIGINT) AS observations_processed, CAST(sum(fresh) AS BIGINT) AS observations_inserted,
        CAST(sum(n - fresh) AS BIGINT) AS duplicates_skipped FROM (SELECT k.district_id, n, CASE WHEN s.district_id IS NULL THEN 1 ELSE 0 END AS fresh FROM
        (SELECT district_id, observation_date, count(*) AS n FROM payload_rows WHERE observation_date < DATE '2001-09-15' GROUP BY 1, 2) k
        LEFT JOIN {PAST} s USING (district_id, observation_date)) GROUP BY ROLLUP (district_id)) a FULL JOIN
        (SELECT district_id, count(*) AS failed_payloads, CAST(sum(failed_days) AS BIGINT) AS failed_days FROM failed_days GROUP BY ROLLUP (district_id)) b
        ON a.district_id IS NOT DISTINCT FROM b.district_id""",
    ),
)(
    lambda t: I.ingest_summary(_payload_rows(t), _past_keys(t), RD.failed_payloads(t.payloads)).withColumn(
        "errors", F.array_join("errors", "|")
    )
)


@register(
    "upsert_forecast",
    q.query(
        ("fcst",),
        f"""SELECT district_id, CAST(forecast_date AS VARCHAR) AS forecast_date, {q.rs("predicted_rainfall predicted_temperature")} FROM
        (SELECT *, row_number() OVER (PARTITION BY district_id, forecast_date ORDER BY o_orderstatus = 'F', id DESC) AS rn FROM fcst) WHERE rn = 1""",
    ),
)
def upsert_forecast(t: Tables) -> DataFrame:
    """Finished orders are the stored forecasts, the others the new ones."""
    keys = ["district_id", "forecast_date"]
    rows = t.forecasts.join(t.read("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id")
    stored = C.last_per_key(rows.filter(F.col("o_orderstatus") == "F"), keys, ["id"])
    new = rows.filter(F.col("o_orderstatus") != "F")
    return out(
        I.upsert(new, stored.select(*keys, "predicted_rainfall", "predicted_temperature"), keys, ["id"])
    )


q.cte(
    "lattice", (),
    """SELECT c_nationkey, s_nationkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS q,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
)
q.cte(
    "axis_pick", ("lattice", "places"),
    """SELECT city, climate_zone, latitude, longitude,
    (SELECT k FROM (SELECT DISTINCT c_nationkey AS k FROM lattice) ORDER BY abs(8.0 + k - latitude), k DESC LIMIT 1) AS c_nationkey,
    (SELECT k FROM (SELECT DISTINCT s_nationkey AS k FROM lattice) ORDER BY abs(68.0 + k - longitude), k DESC LIMIT 1) AS s_nationkey FROM places""",
)
register(
    "grid_nearest",
    q.query(
        ("axis_pick", "lattice"),
        f"""SELECT city, climate_zone, {q.rs("latitude longitude")}, CAST(date AS VARCHAR) AS date, {q.r("p / n / 1500.0::DOUBLE + 273.15::DOUBLE", 4, "t2m")},
        {q.r("q / 4000.0::DOUBLE", 4, "tp")}, {q.r("n / 100.0::DOUBLE", 4, "swvl1")}, {q.r("n / 200.0::DOUBLE", 4, "swvl2")},
        {q.r("-n / 10000.0::DOUBLE", 4, "evabs")}, {q.r("q / 100000.0::DOUBLE", 4, "sro")} FROM axis_pick JOIN lattice USING (c_nationkey, s_nationkey)""",
    ),
)(lambda t: out(RD.extract_cells(materialize(t.grid, "grid"), t.locations)))
register(
    "district_dimension",
    q.query(
        ("master",),
        f"""SELECT DISTINCT city AS district_name, CASE city WHEN '1' THEN 'North' WHEN '2' THEN 'South' ELSE 'India' END AS state, {q.rs("latitude longitude")} FROM master""",
    ),
)(lambda t: out(RD.district_dimension(t.panel, {"1": "North", "2": "South"})))
register(
    "table_page",
    "SELECT c_custkey AS district_id, c_name AS district_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40",
)(lambda t: RD.page_of(t.districts.select("district_id", "district_name"), "district_id", 40, 20))


# --- lookup --------------------------------------------------------------------------------------

register("nearest_city", q.query(("near",), "SELECT district_id, city, climate_zone FROM near"))(
    lambda t: S.place_requests(t.districts, t.panel).select("district_id", "city", "climate_zone")
)
register(
    "nearest_supplier",
    q.query(
        ("districts", "places"),
        """SELECT district_id, city FROM (SELECT d.district_id, p.city, row_number() OVER (PARTITION BY d.district_id
        ORDER BY (p.latitude - d.latitude) * (p.latitude - d.latitude) + (p.longitude - d.longitude) * (p.longitude - d.longitude), p.city) AS rn
        FROM districts d CROSS JOIN places p) WHERE rn = 1""",
    ),
)(lambda t: nearest_place(t.districts, t.locations, out="city", small=0).select("district_id", "city"))


def _history_requests(t: Tables) -> DataFrame:
    """Two years after each order, one month later in the year."""
    asked = F.add_months("o_orderdate", 25)
    return t.read("orders").select(
        F.col("o_custkey").cast("string").alias("city"), F.year(asked).alias("year"), F.month(asked).alias("month")
    ).distinct()


q.cte(
    "hist_known", (),
    """SELECT CAST(o_custkey AS VARCHAR) AS city, year(o_orderdate) AS year, month(o_orderdate) AS month,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*)::DOUBLE / 10000.0::DOUBLE AS temperature_c FROM orders GROUP BY 1, 2, 3""",
)
q.cte(
    "hist_match", ("hist_known",),
    q.history_match(
        """SELECT *, row_number() OVER () AS rid FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS city, year(o_orderdate + INTERVAL 25 MONTH) AS year,
        month(o_orderdate + INTERVAL 25 MONTH) AS month FROM orders)""",
        "SELECT * FROM hist_known",
    ),
)
register(
    "history_fallback",
    q.query(
        ("hist_match",),
        f"SELECT city, {q.ints('year month record_year record_month match')}, {q.r('temperature_c')} FROM hist_match",
    ),
)(
    lambda t: out(
        L.with_history(_history_requests(t), materialize(t.customer_history)),
        ["city", "year", "month", "record_year", "record_month", "match", "temperature_c"],
    )
)


def _state(t: Tables, scenarios=None) -> DataFrame:
    placed = S.for_periods(S.place_requests(t.districts, t.panel), [BASE], MONTH)
    return L.state_rows(S.scenario_grid(placed, scenarios or K.SCENARIO_PRESETS), t.panel)


def _chained(t: Tables) -> DataFrame:
    """Scored state rows. They are not stored: every query reads them once, and only a few of their hundreds of columns."""
    return S.hotspot(S.chain(_state(t), local=False))


STATE_OUT = (
    "temperature_c rainfall_mm soil_moisture temperature_prev_1 rolling_temp_6m rolling_rainfall_6m temp_climo_mean rain_climo_std "
    "zone_rain_mean seasonal_temp_mean rolling_sm_3m lag1_climatology zone_rain_climatology_std zone_sm_climatology " + " ".join(q.CARRIED)
)
register(
    "state_rows",
    q.query(("sc_s",), f"SELECT district_id, city, {q.rs(STATE_OUT)} FROM sc_s WHERE scenario = 'baseline'"),
)(lambda t: out(_state(t, {"baseline": (0, 0, 0)}), ["district_id", "city", *STATE_OUT.split()]))

SERVED = (
    "month_sin rolling_rainfall_std_3m rolling_rainfall_std_6m rolling_rainfall_median_3m rolling_rainfall_cv_3m rainfall_trend "
    "rainfall_acceleration rainfall_growth_rate rainfall_momentum rainfall_seasonal_deviation temperature_anomaly temp_trend_3m"
)
q.cte(
    "served", ("sc_s",),
    """SELECT *, sin(2 * pi() * month / 12.0::DOUBLE) AS month_sin, rain_climo_std * 1.2::DOUBLE AS rolling_rainfall_std_3m,
    rain_climo_std * 1.5::DOUBLE AS rolling_rainfall_std_6m, rolling_rainfall_3m / 3.0::DOUBLE AS rolling_rainfall_median_3m,
    rain_climo_std * 1.2::DOUBLE / (rolling_rainfall_3m + 1e-6) AS rolling_rainfall_cv_3m, rainfall_prev_1 - rainfall_prev_3 AS rainfall_trend,
    (rainfall_prev_1 - rolling_rainfall_3m) - (rolling_rainfall_3m - rolling_rainfall_6m) AS rainfall_acceleration,
    greatest(least((rainfall_prev_1 - rainfall_prev_3) / (rainfall_prev_3 + 1e-6), 10.0::DOUBLE), -10.0::DOUBLE) AS rainfall_growth_rate,
    rainfall_prev_1 - rain_climo_mean AS rainfall_momentum, rainfall_prev_1 - lag1_climatology AS rainfall_seasonal_deviation,
    temperature_c - temp_climo_mean AS temperature_anomaly, rolling_temp_3m - rolling_temp_6m AS temp_trend_3m FROM sc_s WHERE scenario = 'baseline'""",
)
register(
    "serving_inputs",
    q.query(
        ("served",),
        f"""SELECT district_id, {q.rs(SERVED)}, CAST(month BETWEEN 6 AND 9 AS BIGINT) AS is_monsoon,
        {", ".join(f"CAST((climate_zone = '{z}')::INT AS BIGINT) AS \"climate_zone_{z}\"" for z in REGIONS)} FROM served""",
    ),
)(
    lambda t: out(
        V.rainfall_inputs(_state(t, {"baseline": (0, 0, 0)}), REGIONS),
        ["district_id", *SERVED.split(), "is_monsoon", *[f"climate_zone_{z}" for z in REGIONS]],
    )
)
q.cte(
    "live_latest", (),
    """SELECT * FROM (SELECT o_custkey AS district_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS live_at,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice / 10000.0::DOUBLE END AS live_t, o_totalprice / 5000.0::DOUBLE AS live_r,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 6000.0::DOUBLE END AS live_h, o_totalprice / 1000000.0::DOUBLE AS live_s,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'P') WHERE rn = 1""",
)
q.cte(
    "obs_latest", ("obs",),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY observation_date DESC, id DESC) AS rn FROM obs) WHERE rn = 1""",
)
q.cte(
    "resolved", ("sc_s", "live_latest", "obs_latest"),
    """SELECT s.*, live_t, live_r, live_h, live_s, live_at, o.temperature AS db_t, o.rainfall AS db_r, o.humidity AS db_h, o.observation_date AS db_date,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND live_t IS NOT NULL THEN 'LIVE'
    WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND o.temperature IS NOT NULL THEN 'DATABASE' ELSE 'HISTORICAL' END AS source
    FROM sc_s s JOIN customer ON district_id = c_custkey LEFT JOIN live_latest l USING (district_id) LEFT JOIN obs_latest o USING (district_id) WHERE scenario = 'baseline'""",
)


@register(
    "resolve_source",
    q.query(
        ("resolved",),
        f"""SELECT district_id, source, CASE source WHEN 'LIVE' THEN 1.0::DOUBLE WHEN 'DATABASE' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence_source,
        CASE source WHEN 'LIVE' THEN live_at WHEN 'DATABASE' THEN CAST(db_date AS VARCHAR) ELSE '{BASE}-{MONTH:02d}-01' END AS last_updated,
        {q.r("CASE source WHEN 'LIVE' THEN live_t WHEN 'DATABASE' THEN db_t ELSE temperature_c END", 4, "temperature_c")},
        {q.r("CASE source WHEN 'LIVE' THEN live_r WHEN 'DATABASE' THEN db_r ELSE rainfall_mm END", 4, "rainfall_mm")},
        {q.r("CASE source WHEN 'LIVE' THEN live_h WHEN 'DATABASE' THEN db_h END", 4, "humidity")},
        {q.r("CASE source WHEN 'LIVE' THEN live_s ELSE soil_moisture END", 4, "soil_moisture")} FROM resolved""",
    ),
)
def resolve_source(t: Tables) -> DataFrame:
    wants = t.read("customer").select(
        F.col("c_custkey").alias("district_id"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD").alias("use_live"),
    )
    state = _state(t, {"baseline": (0, 0, 0)}).join(wants, "district_id")
    df = L.resolve_sources(
        state, RD.live_rows(t.live_payloads), t.observations, live_order=("observed_at", "payload_id")
    )
    return out(
        df,
        ["district_id", "source", "confidence_source", "last_updated", "temperature_c", "rainfall_mm", "humidity",
         "soil_moisture"],
    )


# --- scenarios, rules, rankings ------------------------------------------------------------------

CHAIN_OUT = (
    "temperature_c rainfall_mm soil_moisture drought_severity_score drought_confidence heatwave_severity "
    "extreme_rainfall_severity overall_risk_score water_stress_index crop_stress_index hotspot_score"
)
CHAIN_TEXT = "drought_category heatwave_category extreme_rainfall_category overall_risk_category hotspot_risk_band"
register(
    "scenario_grid",
    q.query(("sc",), f"SELECT district_id, scenario, {q.rs(CHAIN_OUT)}, {', '.join(CHAIN_TEXT.split())} FROM sc"),
)(lambda t: out(_chained(t), ["district_id", "scenario", *CHAIN_OUT.split(), *CHAIN_TEXT.split()]))

register(
    "scenario_water",
    q.query(
        ("sw",),
        f"SELECT district_id, scenario, {q.rs(CHAIN_OUT)}, {q.r(q.EVAP, 4, 'evaporation_mm')}, {q.r('sro * 1000.0::DOUBLE', 4, 'runoff_mm')}, {', '.join(CHAIN_TEXT.split())} FROM sw",
    ),
)(
    lambda t: out(
        S.hotspot(S.chain(_state(t, K.WATER_SCENARIOS), local=False)),
        ["district_id", "scenario", *CHAIN_OUT.split(), (F.abs("evabs") * F.lit(30000.0)).alias("evaporation_mm"),
         (F.col("sro") * F.lit(1000.0)).alias("runoff_mm"), *CHAIN_TEXT.split()],
    )
)

WSI = (
    "round(greatest(least(0.3::DOUBLE * (1.0::DOUBLE - " + q.clip("soil_moisture / 0.4::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")
    + ") + 0.3::DOUBLE * (1.0::DOUBLE - " + q.clip("rainfall_mm / (rain_climo_mean + 1e-6)", "0.0::DOUBLE", "1.0::DOUBLE")
    + ") + 0.1::DOUBLE * (1.0::DOUBLE - " + q.clip("sro / 0.05::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")
    + ") + 0.3::DOUBLE * drought_risk, 1.0::DOUBLE), 0.0::DOUBLE), 4)"
)
CSI = (
    "round(greatest(least(0.45::DOUBLE * " + q.clip("(0.3::DOUBLE - soil_moisture) / 0.2::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")
    + " + 0.25::DOUBLE * " + q.clip("(temperature_c - 28.0::DOUBLE) / 12.0::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")
    + " + 0.3::DOUBLE * drought_risk, 1.0::DOUBLE), 0.0::DOUBLE), 4)"
)
q.cte(
    "rules", ("sc",),
    f"""SELECT * EXCLUDE (water_stress_index, crop_stress_index), {WSI} AS water_stress_index, {CSI} AS crop_stress_index,
    CASE WHEN dp3 > 0.30 OR dp2 + dp3 > 0.70 THEN 'Critical' WHEN dp3 > 0.15 OR dp2 > 0.40 THEN 'High' WHEN dp1 > 0.50 OR dp2 > 0.25 THEN 'Medium' ELSE 'Low' END AS drought_warning_level,
    CASE WHEN hp3 > 0.20 OR hp2 + hp3 > 0.65 THEN 4 WHEN hp3 > 0.10 OR hp2 > 0.35 THEN 3 WHEN hp1 > 0.50 OR hp2 > 0.20 THEN 2 ELSE 1 END AS hw_tier,
    CASE WHEN ep3 > 0.20 OR ep2 + ep3 > 0.65 THEN 4 WHEN ep3 > 0.10 OR ep2 > 0.35 THEN 3 WHEN ep1 > 0.50 OR ep2 > 0.20 THEN 2 ELSE 1 END AS er_tier,
    heatwave_severity AS hs_, extreme_rainfall_severity AS es_, er_runoff_pressure AS u, er_soil_saturation AS y, rainfall_mm - rain_climo_mean AS ra, temperature_anomaly AS a
    FROM sc""",
)
register(
    "drought_rules",
    q.query(
        ("rules",),
        f"""SELECT district_id, scenario, water_stress_index, crop_stress_index,
        CASE WHEN rainfall_mm < 10 AND sro < 0.002 AND drought_risk > 0.6 THEN 'Critical' WHEN rainfall_mm < 25 OR sro < 0.005 OR drought_risk > 0.4 THEN 'High' WHEN drought_risk > 0.15 THEN 'Medium' ELSE 'Low' END AS reservoir_risk,
        CASE WHEN low_sm_streak >= 4 OR cumulative_sm_deficit_6m > 0.4 OR sm_zscore < -2.0 THEN 'Critical' WHEN low_sm_streak >= 2 OR cumulative_sm_deficit_6m > 0.2 OR sm_zscore < -1.2 THEN 'High'
          WHEN sm_zscore < -0.5 OR cumulative_sm_deficit_6m > 0.05 THEN 'Medium' ELSE 'Low' END AS groundwater_risk,
        CASE WHEN water_stress_index > 0.75 THEN 'Deficit' WHEN water_stress_index > 0.5 THEN 'Stressed' WHEN water_stress_index > 0.2 THEN 'Sufficient' ELSE 'Abundant' END AS water_availability_status,
        CASE WHEN soil_moisture < 0.10 AND temperature_c > 35 THEN 'Critical' WHEN soil_moisture < 0.15 OR crop_stress_index > 0.65 THEN 'High' WHEN soil_moisture < 0.22 OR crop_stress_index > 0.35 THEN 'Medium' ELSE 'Low' END AS irrigation_need,
        CASE WHEN crop_stress_index > 0.75 OR drought_category = 'Extreme' THEN 'Critical' WHEN crop_stress_index > 0.5 OR drought_category = 'High' THEN 'High' WHEN crop_stress_index > 0.25 OR drought_category = 'Medium' THEN 'Medium' ELSE 'Low' END AS agricultural_risk,
        drought_warning_level, drought_warning_level <> 'Low' AS drought_warning,
        CASE WHEN head IS NULL AND tail IS NULL THEN CASE WHEN drought_warning_level <> 'Low' THEN 'Drought risk is building. Monitoring is advised.' ELSE 'No active drought hazards detected.' END
          ELSE concat_ws(' ', head, tail) END AS drought_message
        FROM (SELECT *, CASE WHEN dp3 > 0.15 THEN 'Elevated Extreme Drought probability: ' || printf('%.1f%%.', dp3 * 100.0::DOUBLE) WHEN dp2 > 0.35 THEN 'Elevated High Drought probability: ' || printf('%.1f%%.', dp2 * 100.0::DOUBLE) END AS head,
        CASE WHEN drought_momentum < -5 OR drought_trend < -5 THEN 'Drought severity is rapidly increasing due to accumulating water deficits.' END AS tail FROM rules)""",
    ),
)(
    lambda t: out(
        R.drought_warning(R.crop_outlook(R.water_outlook(_chained(t)))),
        ["district_id", "scenario", "water_stress_index", "crop_stress_index", "reservoir_risk", "groundwater_risk",
         "water_availability_status", "irrigation_need", "agricultural_risk", "drought_warning_level", "drought_warning",
         "drought_message"],
    )
)
TIER_NAME = "CASE greatest(hw_tier, er_tier) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END"
EVENT = "CASE WHEN hw_tier > er_tier THEN 'Heatwave' WHEN er_tier > hw_tier THEN 'Extreme Rainfall' WHEN hw_tier > 1 THEN 'Compound Heat-Rainfall' ELSE 'None' END"
register(
    "extreme_rules",
    q.query(
        ("rules",),
        f"""SELECT *, CASE health_risk WHEN 'Extreme' THEN 'Red' WHEN 'High' THEN 'Orange' WHEN 'Medium' THEN 'Yellow' ELSE 'Green' END AS heat_alert_level FROM (
        SELECT district_id, scenario,
        CASE WHEN hs_ > 70 OR (a > 5 AND hp2 + hp3 > 0.75) THEN 'Extreme' WHEN hs_ > 45 OR a > 3 THEN 'High' WHEN hs_ > 20 THEN 'Medium' ELSE 'Low' END AS health_risk,
        CASE WHEN a > 4.5 AND hs_ > 50 THEN 'Extreme' WHEN a > 2.5 OR hs_ > 35 THEN 'High' WHEN hs_ > 15 THEN 'Medium' ELSE 'Low' END AS outdoor_exposure_risk,
        CASE WHEN es_ > 70 OR (y > 0.9 AND u > 0.8 AND es_ > 50) THEN 'Extreme' WHEN es_ > 45 OR (y > 0.75 AND u > 0.5) THEN 'High' WHEN es_ > 20 THEN 'Medium' ELSE 'Low' END AS flash_flood_risk,
        CASE WHEN u > 0.85 AND es_ > 50 THEN 'Extreme' WHEN u > 0.5 OR es_ > 35 THEN 'High' WHEN es_ > 15 THEN 'Medium' ELSE 'Low' END AS surface_runoff_risk,
        CASE WHEN es_ > 65 AND ra > 100 THEN 'Extreme' WHEN es_ > 40 OR ra > 50 THEN 'High' WHEN es_ > 15 THEN 'Medium' ELSE 'Low' END AS drainage_overload_risk,
        {TIER_NAME} AS extreme_warning_level, {EVENT} AS event_type, greatest(hw_tier, er_tier) > 1 AS extreme_warning,
        CASE WHEN greatest(hw_tier, er_tier) = 1 THEN 'Routine weather conditions. Standard monitoring active.'
          WHEN hw_tier > er_tier THEN 'Potential extreme heatwave event detected (confidence: ' || printf('%.1f%%', (hp2 + hp3) * 100.0::DOUBLE) || '). Take cooling precautions.'
          WHEN er_tier > hw_tier THEN 'Potential extreme rainfall flooding hazard detected (confidence: ' || printf('%.1f%%', (ep2 + ep3) * 100.0::DOUBLE) || '). Monitor flash floods.'
          ELSE 'Compound Heat & Flood hazard warning active. High stress levels detected.' END AS extreme_message FROM rules)""",
    ),
)(
    lambda t: out(
        R.extreme_warning(R.rain_impact(R.heat_impact(_chained(t)))),
        ["district_id", "scenario", "health_risk", "outdoor_exposure_risk", "flash_flood_risk", "surface_runoff_risk",
         "drainage_overload_risk", "extreme_warning_level", "event_type", "extreme_warning", "extreme_message",
         "heat_alert_level"],
    )
)


def _g(x: str) -> str:
    return f"greatest({x}, 0.0::DOUBLE)"


DROUGHT_DRIVERS = (
    ("Rainfall Deficit", f"{_g('-rainfall_spi')} * 11724.0::DOUBLE + {_g('-rainfall_deficit')} / 10.0::DOUBLE * 3573.0::DOUBLE + {_g('-rainfall_deficit_pct')} / 100.0::DOUBLE * 5369.0::DOUBLE"),
    ("Low Soil Moisture", f"{_g('-sm_zscore')} * 12856.0::DOUBLE + {_g('-sm_anomaly')} * 10.0::DOUBLE * 2818.0::DOUBLE + {_g('sm_deficit')} * 10.0::DOUBLE * 828.0::DOUBLE + {_g('moisture_stress')} * 5.0::DOUBLE * 1360.0::DOUBLE"),
    ("High Temperature Anomaly", f"{_g('temperature_zscore')} * 10448.0::DOUBLE + {_g('temperature_anomaly')} * 2.0::DOUBLE * 5516.0::DOUBLE + {_g('temperature_stress')} * 2.0::DOUBLE * 3654.0::DOUBLE + {_g('heat_excess')} * 5.0::DOUBLE * 3.0::DOUBLE"),
    ("High Evaporation Pressure", "evaporation_pressure / 100.0::DOUBLE * 6020.0::DOUBLE + evaporation_stress / 20.0::DOUBLE * 5982.0::DOUBLE"),
    ("Hydrological Stress", f"hydrological_stress * 843.0::DOUBLE + {_g('-water_balance')} / 100.0::DOUBLE * 1926.0::DOUBLE"),
)
EXTREME_DRIVERS = (
    ("High Temperature Anomaly", f"{_g('temperature_anomaly')} * 0.033::DOUBLE"),
    ("Extreme Heat Stress", f"{_g('hw_heat_stress')} * 0.116::DOUBLE"),
    ("Soil Moisture Deficit", f"{_g('sm_climo_mean - soil_moisture')} * 5.0::DOUBLE * 0.043::DOUBLE"),
    ("Rainfall Deficit", f"{_g('rain_climo_mean - rainfall_mm')} * 0.05::DOUBLE * 0.087::DOUBLE"),
    ("Rainfall Anomaly Surge", f"{_g('rainfall_mm - rain_climo_mean')} / 50.0::DOUBLE * 2230.0::DOUBLE"),
    ("Hydrological Runoff Pressure", "er_runoff_pressure * 5.0::DOUBLE * 737.0::DOUBLE"),
    ("High Soil Saturation", "er_soil_saturation * 2.0::DOUBLE * 908.0::DOUBLE"),
    ("Intense Daily Precipitation", "er_rainfall_intensity * 30.0::DOUBLE * 201.0::DOUBLE"),
)


def _drivers_sql(drivers: Sequence[tuple[str, str]], fallback: str, name: str) -> str:
    union = " UNION ALL ".join(
        f"SELECT rid, {i} AS pos, '{label}' AS label, {expr} AS s FROM sc" for i, (label, expr) in enumerate(drivers)
    )
    return f"""(SELECT rid, coalesce(string_agg(label, '|' ORDER BY rn) FILTER (rn <= 3 AND s > 0), '{fallback}') AS {name} FROM (
        SELECT *, row_number() OVER (PARTITION BY rid ORDER BY s DESC, pos) AS rn FROM ({union})) GROUP BY rid)"""


register(
    "drivers",
    q.query(
        ("sc",),
        f"""SELECT district_id, scenario, drought_drivers, extreme_drivers FROM sc
        JOIN {_drivers_sql(DROUGHT_DRIVERS, "Rainfall Deficit", "drought_drivers")} USING (rid)
        JOIN {_drivers_sql(EXTREME_DRIVERS, "Low Climatic Deviations", "extreme_drivers")} USING (rid)""",
    ),
)(
    lambda t: R.extreme_drivers(R.drought_drivers(_chained(t))).select(
        "district_id", "scenario",
        F.concat_ws("|", "drought_drivers").alias("drought_drivers"),
        F.concat_ws("|", "extreme_drivers").alias("extreme_drivers"),
    )
)


def _evaluated(t: Tables, *years: int) -> DataFrame:
    return S.evaluate_districts(t.districts, t.panel, years or (BASE, TARGET), MONTH)


def _top_sql(source: str, name: str, order: str, n: int) -> str:
    return f"(SELECT *, '{name}' AS list_name, row_number() OVER (ORDER BY {order}, district_id) AS place FROM {source} QUALIFY place <= {n})"


LIST_OUT = "district_id, district_name, state, list_name, CAST(place AS BIGINT) AS place"
LIST_COLUMNS = ["district_id", "district_name", "state", "list_name", "place"]
register(
    "hotspot_ranking",
    q.query(
        ("ev",),
        f"""SELECT {LIST_OUT}, hotspot_score, hotspot_risk_band, drought_category, overall_risk_category, {q.rs("predicted_temperature_c predicted_rainfall_mm")} FROM (
        SELECT * FROM {_top_sql(f"(SELECT * FROM ev WHERE year = {BASE})", "top_vulnerable", "hotspot_score DESC", 5)} UNION ALL
        SELECT * FROM {_top_sql(f"(SELECT * FROM ev WHERE year = {BASE})", "least_vulnerable", "hotspot_score ASC", 5)})""",
    ),
)(
    lambda t: out(
        RK.hotspot_ranking(_evaluated(t, BASE), BASE),
        [*LIST_COLUMNS, "hotspot_score", "hotspot_risk_band", "drought_category", "overall_risk_category",
         "predicted_temperature_c", "predicted_rainfall_mm"],
    )
)
register(
    "hotspots",
    q.query(
        ("ev",),
        f"""SELECT {LIST_OUT}, hotspot_score, hotspot_risk_band FROM (
        SELECT * FROM {_top_sql(f"(SELECT * FROM ev WHERE year = {BASE} AND hotspot_risk_band IN ('Critical', 'High'))", "vulnerable_hotspots", "hotspot_score DESC", 10)} UNION ALL
        SELECT * FROM {_top_sql(f"(SELECT * FROM ev WHERE year = {BASE} AND hotspot_risk_band = 'Moderate')", "emerging_hotspots", "hotspot_score DESC", 10)})""",
    ),
)(lambda t: out(RK.hotspots(_evaluated(t, BASE), BASE), [*LIST_COLUMNS, "hotspot_score", "hotspot_risk_band"]))
EVAL_OUT = (
    "predicted_temperature_c predicted_rainfall_mm soil_moisture drought_severity_score drought_confidence heatwave_severity "
    "extreme_rainfall_severity overall_risk_score water_stress_index crop_stress_index hotspot_score"
)
register(
    "evaluate_districts",
    q.query(
        ("ev",),
        f"SELECT district_id, CAST(year AS BIGINT) AS year, {q.rs(EVAL_OUT)}, {', '.join(CHAIN_TEXT.split())} FROM ev",
    ),
)(lambda t: out(_evaluated(t), ["district_id", "year", *EVAL_OUT.split(), *CHAIN_TEXT.split()]))
register(
    "evaluation_coverage",
    q.query(
        ("ev", "districts"),
        f"""SELECT v.y AS year, (SELECT count(*) FROM (SELECT DISTINCT lower(trim(district_name)), lower(trim(state)) FROM districts)) AS asked,
        count(hotspot_score) AS scored, count(district_id) - count(hotspot_score) AS unscored, '' AS missing
        FROM (VALUES ({BASE}), ({TARGET})) v(y) LEFT JOIN ev ON ev.year = v.y GROUP BY v.y""",
    ),
)(lambda t: out(S.coverage(S.evaluate_all(t.districts, t.panel, (BASE, TARGET), MONTH)).drop("scenario")))
q.cte(
    "moves", ("ev",),
    f"""SELECT t.*, b.rk AS base_rank, t.rk AS target_rank, b.rk - t.rk AS rank_change FROM
    (SELECT *, row_number() OVER (ORDER BY hotspot_score DESC, district_id) AS rk FROM ev WHERE year = {TARGET}) t JOIN
    (SELECT district_id, row_number() OVER (ORDER BY hotspot_score DESC, district_id) AS rk FROM ev WHERE year = {BASE}) b USING (district_id)""",
)
register(
    "district_ranks",
    q.query(("moves",), "SELECT district_id, base_rank, target_rank, rank_change, hotspot_score FROM moves"),
)(
    lambda t: out(
        RK.movements(_evaluated(t), BASE, TARGET),
        ["district_id", "base_rank", "target_rank", "rank_change", "hotspot_score"],
    )
)
register(
    "rank_movement",
    q.query(
        ("moves",),
        f"""SELECT {LIST_OUT}, base_rank, target_rank, rank_change FROM (SELECT * FROM {_top_sql("moves", "most_worsened", "rank_change DESC", 10)}
        UNION ALL SELECT * FROM {_top_sql("moves", "most_improved", "rank_change ASC", 10)})""",
    ),
)(
    lambda t: out(
        RK.rank_movement(_evaluated(t), BASE, TARGET), [*LIST_COLUMNS, "base_rank", "target_rank", "rank_change"]
    )
)
YEARS = float(TARGET - BASE)
q.cte(
    "trend_records", ("ev",),
    f"""SELECT t.district_id, t.district_name, t.state, {q.r(f"(t.predicted_temperature_c - b.predicted_temperature_c) / {YEARS}::DOUBLE", 4, "warming_rate_per_year")},
    {q.r("t.drought_severity_score - b.drought_severity_score", 4, "drought_severity_delta")}, {q.r("t.water_stress_index - b.water_stress_index", 4, "water_stress_delta")},
    {q.r("t.heatwave_severity - b.heatwave_severity", 4, "heatwave_severity_delta")}, {q.r(f"(t.hotspot_score - b.hotspot_score) / {YEARS}::DOUBLE", 4, "hotspot_emergence_rate")},
    t.hotspot_score, b.hotspot_score AS base_hotspot_score, b.hotspot_risk_band AS base_risk_band
    FROM (SELECT * FROM ev WHERE year = {TARGET}) t JOIN (SELECT * FROM ev WHERE year = {BASE}) b USING (district_id)""",
)
TREND_OUT = "warming_rate_per_year, drought_severity_delta, water_stress_delta, heatwave_severity_delta, hotspot_emergence_rate"
register(
    "trends",
    q.query(
        ("trend_records",),
        f"SELECT {LIST_OUT}, {TREND_OUT} FROM ("
        + " UNION ALL ".join(f"SELECT * FROM {_top_sql('trend_records', n, f'{c} DESC', 10)}" for n, c in RK.TREND_LISTS.items())
        + ")",
    ),
)(lambda t: out(RK.trends(_evaluated(t), BASE, TARGET), [*LIST_COLUMNS, *TREND_OUT.split(", ")]))
register(
    "emerging",
    q.query(
        ("trend_records",),
        f"""SELECT {LIST_OUT}, hotspot_score, base_hotspot_score, base_risk_band, hotspot_emergence_rate AS growth_rate_per_year
        FROM {_top_sql("trend_records", "emerging_risks", "hotspot_emergence_rate DESC", 10)}""",
    ),
)(
    lambda t: out(
        RK.emerging(_evaluated(t), BASE, TARGET),
        [*LIST_COLUMNS, "hotspot_score", "base_hotspot_score", "base_risk_band", "growth_rate_per_year"],
    )
)
register(
    "compare_districts",
    q.query(
        ("ev",),
        f"""SELECT side, district_id, CAST(year AS BIGINT) AS year, hotspot_score FROM ev JOIN (
        SELECT 'a' AS side, min(district_id) AS district_id FROM ev WHERE district_name ILIKE '%CUSTOMER#00000001%' UNION ALL
        SELECT 'b', min(district_id) FROM ev WHERE district_name ILIKE '%00002%') USING (district_id)""",
    ),
)(
    lambda t: out(
        RK.compare_districts(_evaluated(t), "CUSTOMER#00000001", "00002"), ["side", "district_id", "year", "hotspot_score"]
    )
)
LEVEL = "CASE {0} WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 WHEN 'Extreme' THEN 3 ELSE 0 END"


def _change(col: str, name: str) -> str:
    d = f"({LEVEL.format('s.' + col)} - {LEVEL.format('b.' + col)})"
    return f"""CASE WHEN {d} = 0 THEN 'No change' ELSE CASE WHEN {d} > 0 THEN '+' ELSE '' END || {d} || CASE WHEN abs({d}) > 1 THEN ' levels' ELSE ' level' END END AS {name}"""


CONF = "({0}.drought_confidence + {0}.heatwave_confidence + {0}.extreme_rainfall_confidence) / 3.0::DOUBLE"
CONF_DIFF = f"round({CONF.format('s')} - {CONF.format('b')}, 3)"
register(
    "scenario_compare",
    q.query(
        ("sc", "obs"),
        f"""SELECT s.district_id, s.scenario, {_change("overall_risk_category", "risk_change")}, {_change("drought_category", "drought_change")},
        regexp_replace(printf('%+.3f', {CONF_DIFF}), '(\\.\\d+?)0+$', '\\1') AS confidence_change,
        CASE WHEN s.temperature_c > 32 AND coalesce(h, 60.0) > 70 THEN 'Uncomfortable' WHEN s.temperature_c BETWEEN 20 AND 26 THEN 'Pleasant' ELSE 'Moderate' END AS comfort_index,
        {q.r("coalesce(h, 60.0)", 4, "baseline_humidity")}, {q.r("s.temperature_c", 4, "scenario_temperature")}, {q.r("b.rainfall_mm", 4, "baseline_rainfall")}
        FROM (SELECT * FROM sc WHERE scenario <> 'baseline') s JOIN (SELECT * FROM sc WHERE scenario = 'baseline') b USING (district_id)
        LEFT JOIN (SELECT district_id, {q.mean2("humidity", "h")} FROM obs GROUP BY 1) USING (district_id)""",
    ),
)(
    lambda t: out(
        S.compare_scenarios(_chained(t), A.district_comparison(t.observations, t.districts.join(
            t.observations.select("district_id").distinct(), "district_id", "left_semi"))),
        ["district_id", "scenario", "risk_change", "drought_change", "confidence_change", "comfort_index",
         "baseline_humidity", F.col("scenario_state.temperature").alias("scenario_temperature"),
         F.col("baseline_state.rainfall").alias("baseline_rainfall")],
    )
)
SIDE = (
    "temperature_c temperature rainfall_mm rainfall drought_severity_score drought_score heatwave_severity heatwave_severity "
    "extreme_rainfall_severity extreme_rainfall_severity overall_risk_score overall_risk_score"
).split()
SIDE_TEXT = "drought_category heatwave_category extreme_rainfall_category overall_risk_category".split()


def _side(alias: str, side: str) -> str:
    numbers = [q.r(f"{alias}.{c}", 4, f"{side}_{n}") for c, n in zip(SIDE[::2], SIDE[1::2], strict=True)]
    return ", ".join(numbers + [f"{alias}.{c} AS {side}_{c}" for c in SIDE_TEXT])


def _stored(run: str, cte: str) -> str:
    return f"SELECT '{run}' AS run, * FROM (SELECT district_id, scenario, {', '.join(_STORED)} FROM {cte})"


_STORED = [*SIDE[::2], *SIDE_TEXT, "drought_confidence", "heatwave_confidence", "extreme_rainfall_confidence", "sd"]
q.cte("stored_runs", ("sc", "sw"), f"{_stored('2001-06', 'sc')} UNION ALL {_stored('2001-07', 'sw')}")


@register(
    "simulation_records",
    q.query(
        ("stored_runs", "obs"),
        f"""SELECT s.run, s.district_id, s.scenario, {_side("b", "baseline")}, {_side("s", "scenario")},
        {q.r("coalesce(h, 60.0)", 4, "baseline_humidity")}, {q.r("round(coalesce(h, 60.0) * (1.0::DOUBLE + s.sd / 100.0::DOUBLE), 2)", 4, "projected_humidity")},
        CAST(coalesce(n, 0) AS BIGINT) AS observation_count, s.drought_category AS drought_impact, s.extreme_rainfall_category AS flood_impact,
        {_change("overall_risk_category", "risk_change")}, {_change("drought_category", "drought_change")}
        FROM (SELECT * FROM stored_runs WHERE scenario <> 'baseline') s JOIN (SELECT * FROM stored_runs WHERE scenario = 'baseline') b USING (run, district_id)
        LEFT JOIN (SELECT district_id, count(*) AS n, {q.mean2("humidity", "h")} FROM obs GROUP BY 1) USING (district_id)""",
    ),
)
def simulation_records(t: Tables) -> DataFrame:
    """Two runs stored as nested records, the first of them twice, and read back from their JSON text."""
    seen = A.district_comparison(t.observations, t.districts)
    humidity = seen.where("observation_count > 0")
    runs = {"2001-06": _chained(t), "2001-07": S.chain(_state(t, K.WATER_SCENARIOS), local=False)}
    path = scratch_path(t.spark, "simulations")
    for run in ("2001-06", "2001-07", "2001-06"):
        SM.store_simulations(SM.simulation_records(S.compare_scenarios(runs[run], humidity), seen), path, run)
    stored = SM.read_simulations(t.spark, path)
    read = SM.with_json(stored).withColumn("r", F.from_json("result_json", stored.schema["result"].dataType))

    def side(name: str) -> list[Column]:
        return [F.col(f"r.{name}_state.{c}").alias(f"{name}_{c}") for c in [*SIDE[1::2], *SIDE_TEXT]]

    return out(
        read,
        ["run", "district_id", "scenario", *side("baseline"), *side("scenario"),
         F.col("r.baseline.humidity").alias("baseline_humidity"), F.col("r.projections.humidity").alias("projected_humidity"),
         "r.baseline.observation_count", F.col("r.impacts.drought_risk").alias("drought_impact"),
         F.col("r.impacts.flood_risk").alias("flood_impact"), "r.risk_change", "r.drought_change"],
    )


register("state_record")(lambda t: S.state_record(_chained(t)))

q.cte(
    "pj_months", ("near", "obs"),
    """SELECT n.*, d.date, year(d.date) AS year, month(d.date) AS month, 'projection' AS scenario, 1.5::DOUBLE AS td, -10.0::DOUBLE AS rd, 0.0::DOUBLE AS sd
    FROM near n JOIN (SELECT c.district_id, CAST(date_trunc('month', coalesce(o.base, DATE '2001-09-15')) + to_months(CAST(i AS INTEGER)) AS DATE) AS date
      FROM districts c LEFT JOIN (SELECT district_id, max(observation_date) AS base FROM obs GROUP BY 1) o USING (district_id) CROSS JOIN range(1, 13) r(i)) d USING (district_id)""",
)
q.state_ctes("pj", "SELECT *, district_id * 100000 + year * 12 + month AS rid FROM pj_months", ("pj_months",), False)
register(
    "projections",
    q.query(
        ("pj",),
        f"""SELECT district_id, CAST(date AS VARCHAR) AS date, {q.rs("predicted_temperature_c predicted_rainfall_mm")},
        CASE WHEN year > 2040 THEN 'low' WHEN year > 2030 THEN 'medium' ELSE 'high' END AS temperature_confidence,
        CASE WHEN rain_climo_std * 1.2::DOUBLE > 20 THEN 'Medium' ELSE 'High' END AS rainfall_confidence,
        {q.r("greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE / greatest(model_rain, 5.0::DOUBLE)))", 2, "rainfall_confidence_score")},
        CASE WHEN month NOT BETWEEN 6 AND 9 THEN 'Non-Monsoon Period' WHEN rain_climo_mean <= 0 THEN 'Normal Monsoon' WHEN model_rain / rain_climo_mean < 0.8 THEN 'Weak Monsoon'
          WHEN model_rain / rain_climo_mean > 1.2 THEN 'Strong Monsoon' ELSE 'Normal Monsoon' END AS monsoon_status,
        drought_category, drought_confidence_level AS drought_confidence, overall_risk_category AS extreme_weather_risk, overall_risk_score AS extreme_weather_score FROM pj""",
    ),
)(
    lambda t: out(
        S.projections(t.districts, t.observations, t.panel, "1year", F.lit(AS_OF), (1.5, -10.0, 0.0)),
        ["district_id", "date", "predicted_temperature_c", "predicted_rainfall_mm", "temperature_confidence",
         "rainfall_confidence", "rainfall_confidence_score", "monsoon_status", "drought_category", "drought_confidence",
         "extreme_weather_risk", "extreme_weather_score"],
    )
)
q.cte(
    "gf_months", ("near",),
    """SELECT n.*, CAST(d AS DATE) AS date, year(d) AS year, month(d) AS month, 'f' AS scenario, 0.0::DOUBLE AS td, 0.0::DOUBLE AS rd, 0.0::DOUBLE AS sd
    FROM near n CROSS JOIN generate_series(DATE '2001-06-27', DATE '2001-07-03', INTERVAL 1 DAY) g(d)""",
)
q.state_ctes("gf", "SELECT *, district_id * 1000 + month * 50 + day(date) AS rid FROM gf_months", ("gf_months",), False)
register(
    "generate_forecasts",
    q.query(
        ("gf_s",),
        f"""SELECT district_id, CAST(date AS VARCHAR) AS forecast_date, {q.r("greatest(rainfall_mm, 0.0::DOUBLE)", 2, "predicted_rainfall")},
        {q.r("temperature_c", 2, "predicted_temperature")} FROM gf_s""",
    ),
)(lambda t: out(S.generate_forecasts(t.districts, t.panel, F.lit(date(2001, 6, 27)))))


# --- models --------------------------------------------------------------------------------------

q.cte(
    "diag", ("dr_cat",),
    f"""SELECT *, drought_category AS "true", rainfall_mm AS actual, rainfall_prev_1 AS predicted FROM
    (SELECT *, lag(drought_category) {q.W} AS pred FROM dr_cat) WHERE pred IS NOT NULL""",
)


def _diagnosed(t: Tables) -> DataFrame:
    """Last month's category as the prediction of this month's, with probabilities from the score."""
    df = H.by_entity(DR.drought_features(t.panel)).withColumns(
        {
            "true": F.col("drought_category"),
            "pred": H.lag("drought_category"),
            "actual": F.col("rainfall_mm"),
            "predicted": F.col("rainfall_prev_1"),
            "probs": class_probabilities(X.clip("drought_severity_score", 0.0, 1.0)),
        }
    )
    return df.filter(F.col("pred").isNotNull())


register(
    "regression_metrics",
    q.query(
        ("diag",),
        f"""SELECT {q.rs("mae rmse r2 mape")} FROM (SELECT avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
        1.0 - sum((actual - predicted) * (actual - predicted)) / sum((actual - m) * (actual - m)) AS r2,
        avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100.0 AS mape FROM diag CROSS JOIN (SELECT avg(actual) AS m FROM diag))""",
    ),
)(lambda t: out(D.regression_metrics(materialize(_diagnosed(t)))))
q.cte(
    "class_scores", ("diag",),
    """SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM (
    SELECT c AS category, hits, support, predicted, total, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE hits / predicted::DOUBLE END AS precision,
    CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hits / support::DOUBLE END AS recall FROM (
    SELECT c, count(*) FILTER ("true" = c AND pred = c) AS hits, count(*) FILTER ("true" = c) AS support, count(*) FILTER (pred = c) AS predicted, count(*) AS total
    FROM diag CROSS JOIN (VALUES ('Low'), ('Medium'), ('High'), ('Extreme')) v(c) GROUP BY c))""",
)
register(
    "class_scores",
    q.query(("class_scores",), f"SELECT category, hits, support, predicted, total, {q.rs('precision recall f1')} FROM class_scores"),
)(lambda t: out(D.class_scores(_diagnosed(t))))
register(
    "classification_metrics",
    q.query(
        ("class_scores",),
        f"""SELECT {q.r("sum(hits) / max(total)::DOUBLE", 4, "accuracy")}, {q.r("avg(precision)", 4, "precision")}, {q.r("avg(recall)", 4, "recall")},
        {q.r("avg(f1)", 4, "macro_f1")}, {q.r("sum(f1 * support) / sum(support)::DOUBLE", 4, "weighted_f1")} FROM class_scores WHERE support > 0 OR predicted > 0""",
    ),
)(lambda t: out(D.classification_metrics(_diagnosed(t))))
register("confusion", q.query(("diag",), 'SELECT "true", pred, count(*) AS rows FROM diag GROUP BY 1, 2'))(
    lambda t: D.confusion(_diagnosed(t))
)
register(
    "top_confusions",
    q.query(("diag",), 'SELECT "true", pred, count(*) AS rows FROM diag WHERE "true" <> pred GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5'),
)(lambda t: D.top_confusions(_diagnosed(t)))
for _key in ("climate_zone", "month"):
    register(
        f"accuracy_by_{_key}",
        q.query(
            ("diag",),
            f"""SELECT {_key}, rows, {q.rs("accuracy severe_share extreme_detection")} FROM (SELECT {_key}, count(*) AS rows,
            avg(CASE WHEN "true" = pred THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN "true" IN ('High', 'Extreme') THEN 1.0 ELSE 0.0 END) AS severe_share,
            avg(CASE WHEN "true" = 'Extreme' THEN CASE WHEN pred = "true" THEN 1.0 ELSE 0.0 END END) AS extreme_detection FROM diag GROUP BY 1)""",
        ),
    )(lambda t, key=_key: out(D.accuracy_by(_diagnosed(t), key)))
register(
    "extreme_recall",
    q.query(
        ("diag",),
        f"""SELECT {q.r("x", 4, "extreme_recall")}, {q.r("1.0 - x", 4, "extreme_fn_rate")} FROM (SELECT avg(CASE WHEN "true" = 'Extreme' THEN CASE WHEN pred = 'Extreme' THEN 1.0 ELSE 0.0 END END) AS x FROM diag)""",
    ),
)(lambda t: out(D.extreme_recall(_diagnosed(t))))


def _prob_sql(label: str) -> str:
    s = "drought_severity_score"
    return (
        f"CASE {label} WHEN 'Low' THEN (1-{s})*(1-{s})*(1-{s}) WHEN 'Medium' THEN 3*{s}*(1-{s})*(1-{s}) "
        f"WHEN 'High' THEN 3*{s}*{s}*(1-{s}) ELSE {s}*{s}*{s} END"
    )


register(
    "confident_errors",
    q.query(
        ("diag",),
        f"""SELECT {q.KEYS}, "true", pred, {q.rs("p_pred p_true margin")} FROM (SELECT *, p_pred - p_true AS margin FROM (SELECT *, {_prob_sql("pred")} AS p_pred,
        {_prob_sql('"true"')} AS p_true FROM diag WHERE "true" <> pred) ORDER BY margin DESC, city, date LIMIT 10)""",
    ),
)(lambda t: out(D.confident_errors(_diagnosed(t), ["city", "date"])))
register(
    "residuals",
    q.query(
        ("diag",),
        f"""SELECT month, {q.r("e", 4, "mean_abs_error")}, rows, e = min(e) OVER () AS easiest, e = max(e) OVER () AS hardest FROM (
        SELECT month, avg(abs(actual - predicted)) AS e, count(*) AS rows FROM diag GROUP BY 1)""",
    ),
)(lambda t: out(D.residual_report(materialize(_diagnosed(t)), "month")))
register(
    "residual_summary",
    q.query(
        ("diag",),
        f"""SELECT {q.r("avg(CASE WHEN month BETWEEN 6 AND 9 THEN abs(actual - predicted) END)", 4, "monsoon_mae")},
        {q.r("avg(CASE WHEN month NOT BETWEEN 6 AND 9 THEN abs(actual - predicted) END)", 4, "non_monsoon_mae")},
        count(*) FILTER (actual < predicted) AS over_count, count(*) FILTER (actual > predicted) AS under_count FROM diag""",
    ),
)(lambda t: out(D.residual_summary(_diagnosed(t))))
register(
    "evolution_by_prediction",
    q.query(
        ("diag",),
        f"""SELECT category, {q.rs("mean_streak mean_recovery mean_momentum")} FROM (SELECT pred AS category, avg(dry_month_streak) AS mean_streak,
        avg(drought_recovery) AS mean_recovery, avg(drought_momentum) AS mean_momentum FROM diag GROUP BY 1)""",
    ),
)(lambda t: out(D.evolution_by_prediction(_diagnosed(t))))
SPLIT = (1999, 2000)
register(
    "chronological_split",
    q.query(
        ("master",),
        """SELECT CASE WHEN year <= 1999 THEN 'train' WHEN year <= 2000 THEN 'validation' ELSE 'test' END AS part, count(*) AS rows FROM master GROUP BY 1""",
    ),
)(
    lambda t: A.entity_counts(dict(zip(("train", "validation", "test"), T.chronological_split(t.panel, *SPLIT)))).select(
        F.col("entity").alias("part"), F.col("total").alias("rows")
    )
)
register(
    "balanced_weights",
    q.query(
        ("dr_cat",),
        f"""SELECT drought_category, {q.r("n / (k * c)", 4, "weight")} FROM (SELECT drought_category, count(*)::DOUBLE AS c,
        sum(count(*)) OVER () ::DOUBLE AS n, count(*) OVER ()::DOUBLE AS k FROM dr_cat GROUP BY 1)""",
    ),
)(
    lambda t: out(
        T.balanced_weights(DR.drought_features(t.panel), "drought_category").select("drought_category", "weight").distinct()
    )
)


@register("train_classifiers")
def train_classifiers(t: Tables) -> DataFrame:
    """Race of all candidates on the drought table, ranked by macro F1 on the validation years."""
    df = materialize(DR.drought_dataset(t.panel, REGIONS), "drought-dataset")
    train, validation, _ = T.chronological_split(df, *SPLIT)
    names = T.feature_columns(df, "drought_category")
    return T.comparison_table(t.spark, T.race_classifiers(train, validation, names, "drought_category"))


@register("train_regressors")
def train_regressors(t: Tables) -> DataFrame:
    """Race of all candidates for next month's rainfall."""
    df = materialize(RF.rainfall_dataset(t.panel, REGIONS), "rainfall-dataset")
    train, validation, _ = T.chronological_split(df, *SPLIT)
    names = [c for c in T.feature_columns(df, "target_rainfall_next_month")]
    return T.comparison_table(t.spark, T.race_regressors(train, validation, names, "target_rainfall_next_month"))


@register("batch_score")
def batch_score(t: Tables) -> DataFrame:
    """Refit the winner of the race on training and validation rows and score the test rows."""
    df = materialize(DR.drought_dataset(t.panel, REGIONS), "drought-dataset")
    coded = df.withColumn("label", X.encode("drought_category", K.RISK_ORDINAL).cast("double"))
    train, validation, test = T.chronological_split(coded, *SPLIT)
    names = T.feature_columns(df, "drought_category")
    winner = T.race_classifiers(train, validation, names, "drought_category")[0].name
    model = T.refit(train, validation, names, T.classifiers(weight=None)[winner])
    scored = T.score_classes(model, test).withColumn("true", F.col("drought_category"))
    return D.confusion(scored)


@register("train_hazards")
def train_hazards(t: Tables) -> DataFrame:
    """Both heads of the heatwave and the extreme-rain model: all candidates, ranked on the validation years."""
    df = _hazard_table(t)
    schema = "task string, head string, place int, name string, metric string, value double"
    rows = []
    models = T.together(t.spark, [partial(T.train_hazard, df, task, *SPLIT) for task in T.HAZARD_TARGETS])
    for task, model in zip(T.HAZARD_TARGETS, models, strict=True):
        for head, results in (("class", model.classes), ("severity", model.severities)):
            rows += [(task, head, i + 1, r.name, m, float(v)) for i, r in enumerate(results) for m, v in sorted(r.metrics.items())]
    return t.spark.createDataFrame(rows, schema)


def _hazard_table(t: Tables) -> DataFrame:
    return materialize(EX.extreme_dataset(t.panel, REGIONS), "extreme-dataset")


# The candidate of each registered predictor.
PREDICTOR = "RandomForest"


def _predicted_number(t: Tables, df: DataFrame, target: str) -> DataFrame:
    """A regressor fitted on training and validation years, and its error per month of the test years."""
    stored = materialize(df, "regression-table")
    train, validation, test = T.chronological_split(stored, *SPLIT)
    names = T.feature_columns(stored, target)
    model = T.refit(train, validation, names, T.regressors(target)[PREDICTOR])
    scored = T.score_numbers(model, test).withColumn("actual", F.col(target))
    return D.residual_report(materialize(scored), "month")


def _predicted_hazard(t: Tables, task: str) -> DataFrame:
    """Predicted against true classes of the test years, with the mean predicted and true severity."""
    df = _hazard_table(t)
    model = T.train_hazard(df, task, *SPLIT, names=[PREDICTOR])
    category, severity = T.HAZARD_TARGETS[task]
    _, _, test = T.chronological_split(df, *SPLIT)
    scored = T.score_hazard(model, test, "p", "s").withColumn("pred", R.classify("p"))
    return scored.groupBy(F.col(category).alias("true"), "pred").agg(
        F.count("*").alias("rows"), F.avg("s").alias("predicted_severity"), F.avg(severity).alias("true_severity")
    )


register("predict_temperature")(
    lambda t: _predicted_number(t, t.panel.withColumns(X.one_hot("climate_zone", REGIONS, "climate_zone_")).drop("target_rainfall_next_month"), "target_temperature_next_month")
)
register("predict_rainfall")(lambda t: _predicted_number(t, RF.rainfall_dataset(t.panel, REGIONS), "target_rainfall_next_month"))
register("predict_heatwave")(lambda t: _predicted_hazard(t, "heatwave"))
register("predict_extreme_rainfall")(lambda t: _predicted_hazard(t, "extreme_rainfall"))


@register("search_drought")
def search_drought(t: Tables) -> DataFrame:
    """Random search over forests for the drought classes: each drawn setting and its mean score over three folds of years."""
    df = materialize(T.coded_labels(DR.drought_dataset(t.panel, REGIONS), "drought_category"), "drought-dataset")
    train, _, _ = T.chronological_split(df, *SPLIT)
    names = T.feature_columns(df.drop("label", "weight"), "drought_category")
    found = T.random_search(train, names, T.classifiers()[PREDICTOR], {"maxDepth": [4, 6, 8], "numTrees": [20, 40]}, draws=3)
    rows = [(str(sorted(s.items())), float(m), s == found.best) for s, m in zip(found.settings, found.avgMetrics)]
    return t.spark.createDataFrame(rows, "setting string, f1 double, best boolean")


@register("feature_importance")
def feature_importance(t: Tables) -> DataFrame:
    """Permutation importance of every feature on the validation years, for each candidate of the drought classes."""
    df = materialize(DR.drought_dataset(t.panel, REGIONS), "drought-dataset")
    train, validation, _ = T.chronological_split(df, *SPLIT)
    names = T.feature_columns(df, "drought_category")
    raced = T.race_classifiers(train, validation, names, "drought_category")
    tables = [
        T.feature_importance(r.model, names, validation, "drought_category").withColumn("model", F.lit(r.name)) for r in raced
    ]
    return reduce(DataFrame.unionByName, tables)


@register("fitted_hotspots")
def fitted_hotspots(t: Tables) -> DataFrame:
    """Districts evaluated now and in the target year under two scenarios, every step scored by a fitted model."""
    scenarios = {"baseline": (0.0, 0.0, 0.0), "temperature_plus_2": (2.0, 0.0, 0.0)}
    evaluated = S.evaluate_districts(t.districts, t.panel, (BASE, TARGET), MONTH, scenarios, scorer=_fitted_scorer(t))
    return evaluated.select("district_id", "year", "scenario", "predicted_temperature_c", "predicted_rainfall_mm", *CHAIN_TEXT.split(), "hotspot_score")


def _fitted_scorer(t: Tables) -> T.Scorer:
    """All five predictors, fitted on the columns that a state row can serve."""
    flags = X.one_hot("climate_zone", REGIONS, "climate_zone_")
    measures = materialize(t.panel.withColumns(flags), "measures")
    drought = materialize(T.coded_labels(DR.drought_dataset(t.panel, REGIONS), "drought_category"), "drought-dataset")
    rain = materialize(RF.rainfall_dataset(t.panel, REGIONS), "rainfall-dataset")
    hazards = _hazard_table(t)

    def numbers(df: DataFrame, target: str, names: Sequence[str]) -> T.Fitted:
        return T.fit(df, names, T.regressors(target)[PREDICTOR]), names

    drought_names = T.feature_columns(drought.drop("label", "weight"), "drought_category")
    return T.learned_scorer(
        temperature=numbers(measures, "target_temperature_next_month", [*V.TEMPERATURE_INPUTS, *flags]),
        rainfall=numbers(rain, "target_rainfall_next_month", T.feature_columns(rain, "target_rainfall_next_month")),
        drought=(T.fit(drought, drought_names, T.classifiers()[PREDICTOR]), drought_names),
        heatwave=T.train_hazard(hazards, "heatwave", *SPLIT, names=[PREDICTOR]),
        extreme_rainfall=T.train_hazard(hazards, "extreme_rainfall", *SPLIT, names=[PREDICTOR]),
    )


# --- streaming -----------------------------------------------------------------------------------


def _event_stream(t: Tables) -> DataFrame:
    schema = t.read("events").schema
    # The table may be one file or a folder of files; a pattern stands for either.
    events = ST.read_stream(t.spark, f"{t.folder}/events.parque[t]", schema)
    humidity = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("district_id"),
        F.col("value").alias("temperature"), humidity.alias("humidity"),
        F.col("ts").cast("date").alias("observation_date"), F.col("ts").cast("timestamp").alias("ts"),
    )


@register(
    "stream_ingest",
    q.query(("obs",), "SELECT DISTINCT district_id, CAST(observation_date AS VARCHAR) AS observation_date FROM obs"),
)
def stream_ingest(t: Tables) -> DataFrame:
    store, events = scratch_path(t.spark, "store"), _event_stream(t)
    ST.ingest_stream(events, store).awaitTermination()
    return out(ST.read_store(t.spark, store, events.schema), ["district_id", "observation_date"])


@register(
    "stream_trend",
    q.query(
        ("obs",),
        f"""SELECT district_id, CAST(CAST(date_trunc('week', observation_date) AS DATE) AS VARCHAR) AS period, {q.r(q.mean("temperature"), 4, "average_temperature")},
        count(temperature) AS n FROM obs GROUP BY 1, 2""",
    ),
)
def stream_trend(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "trend")
    ST.trend_stream(_event_stream(t), path).awaitTermination()
    ST.compact_trend(t.spark, path)
    return out(ST.trend_state(t.spark, path))


@register(
    "stream_latest",
    q.query(
        ("obs_latest",),
        f"SELECT district_id, id, {q.r('temperature')}, CAST(observation_date AS VARCHAR) AS observation_date FROM obs_latest",
    ),
)
def stream_latest(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "latest")
    ST.latest_stream(_event_stream(t).drop("ts"), path).awaitTermination()
    ST.compact_latest(t.spark, path)
    return out(ST.latest_state(t.spark, path), ["district_id", "id", "temperature", "observation_date"])


@register(
    "dry_anomaly_top",
    q.query(
        ("rain_streaks",),
        f"""SELECT city, CAST(date AS VARCHAR) AS date, {q.rs("rainfall_anomaly z")}, run FROM (SELECT *, rainfall_anomaly / (s + 1e-6) AS z FROM (
        SELECT *, coalesce(stddev_samp(rainfall_mm) {q.PM}, 1.0) AS s, dry_months_streak AS run FROM rain_streaks)) ORDER BY z, city, rain_streaks_date LIMIT 10""".replace(
            "rain_streaks_date", "date"
        ),
    ),
)
def dry_anomaly_top(t: Tables) -> DataFrame:
    """Flagship: normals, anomaly, z-score, dry run, and the ten driest months."""
    df = RF.rain_anomaly(t.panel)
    std = B.std_or(B.place_month_std("rainfall_mm"), missing=B.MISSING_STD["rainfall_mm"])
    df = df.withColumn("__std", std).withColumn("z", X.ratio("rainfall_anomaly", "__std"))
    top = df.orderBy("z", "city", "date").limit(10)
    return out(top, ["city", "date", "rainfall_anomaly", "z", F.col("dry_months_streak").alias("run")])
