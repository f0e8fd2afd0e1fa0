"""SQL twins of the registered queries, for checking results with DuckDB.

Common table expressions are named texts; :func:`query` puts the ones a query
needs, in order, in front of its SELECT.
"""

from __future__ import annotations

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTE[name] = (needs, body)


def query(needs: tuple[str, ...], select: str) -> str:
    """WITH clause over everything needed, then the SELECT."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in CTE[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order)
    return half_away(f"WITH {parts}\n{select}" if parts else select)


def half_away(sql: str) -> str:
    """Write out every ``round(x, digits)`` with the rounding rule of ``exprs.round_to``."""
    start = sql.find("round(")
    while start >= 0:
        if start and (sql[start - 1].isalnum() or sql[start - 1] == "_"):
            start = sql.find("round(", start + 1)
            continue
        depth, i, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        x, unit = sql[start + 6 : comma], f"{10.0 ** int(sql[comma + 1 : i - 1])}::DOUBLE"
        sql = f"{sql[:start]}(sign({x}) * floor(abs({x}) * {unit} + 0.500000001::DOUBLE) / {unit} + 0.0::DOUBLE){sql[i:]}"
        start = sql.find("round(")
    return sql


def r(expr: str, digits: int = 4, name: str | None = None) -> str:
    """Rounded output column; never a negative zero."""
    return f"round({expr}, {digits}) AS {name or expr}"


def rs(names: str, digits: int = 4) -> str:
    """Rounded output columns from a blank-separated list of names."""
    return ", ".join(r(n, digits) for n in names.split())


def ints(names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names.split())


def clip(x: str, low: str | None = None, high: str | None = None) -> str:
    """Limit that keeps NULL."""
    out = x
    if high is not None:
        out = f"least({out}, {high})"
    if low is not None:
        out = f"greatest({out}, {low})"
    return f"CASE WHEN ({x}) IS NOT NULL THEN {out} END"


def pos(x: str) -> str:
    return clip(x, "0.0::DOUBLE")


def roll(agg: str, c: str, n: int, at_least: int, lagged: bool = True) -> str:
    rows = f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING" if lagged else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    over = f"OVER (PARTITION BY city ORDER BY date {rows})"
    call = agg.format(c=c)
    return f"CASE WHEN count({c}) {over} >= {at_least} THEN {call} {over} END"


W = "OVER (PARTITION BY city ORDER BY date)"
PM = "OVER (PARTITION BY city, month)"
ZM = "OVER (PARTITION BY climate_zone, month)"
KEYS = "city, CAST(date AS VARCHAR) AS date"

cte(
    "monthly", (),
    """SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS q,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS p,
    CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS d, max(l_discount) AS dmax,
    CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n
    FROM lineitem GROUP BY 1, 2""",
)
cte(
    "places", (),
    """SELECT CAST(s_suppkey AS VARCHAR) AS city, r_name AS climate_zone,
    8.0::DOUBLE + (s_suppkey * 7 % 232)::DOUBLE / 8.0::DOUBLE AS latitude,
    68.0::DOUBLE + (s_suppkey * 13 % 232)::DOUBLE / 8.0::DOUBLE AS longitude, s_suppkey
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "raw", ("monthly", "places"),
    """SELECT city, climate_zone, latitude, longitude, date,
    p / n / 1500.0::DOUBLE + 273.15::DOUBLE AS t2m, q / 4000.0::DOUBLE AS tp,
    d / n * 4.0::DOUBLE AS swvl1, dmax * 4.0::DOUBLE AS swvl2, -(x / n) / 40.0::DOUBLE AS evabs, d / 50.0::DOUBLE AS sro
    FROM monthly JOIN places ON l_suppkey = s_suppkey""",
)
cte(
    "conv", ("raw",),
    """SELECT city, climate_zone, latitude, longitude, date, CAST(year(date) AS BIGINT) AS year,
    CAST(month(date) AS BIGINT) AS month, t2m - 273.15::DOUBLE AS temperature_c, tp * 1000.0::DOUBLE AS rainfall_mm,
    (swvl1 + swvl2) / 2.0::DOUBLE AS soil_moisture, evabs, sro FROM raw""",
)
cte(
    "hist", ("conv",),
    f"""SELECT *, sin(2 * pi() * month / 12.0::DOUBLE) AS month_sin, cos(2 * pi() * month / 12.0::DOUBLE) AS month_cos,
    lag(temperature_c, 1) {W} AS temperature_prev_1, lag(temperature_c, 3) {W} AS temperature_prev_3,
    lag(rainfall_mm, 1) {W} AS rainfall_prev_1, lag(rainfall_mm, 3) {W} AS rainfall_prev_3,
    lag(soil_moisture, 1) {W} AS soil_moisture_prev_1,
    {roll("avg({c})", "temperature_c", 3, 3, False)} AS rolling_temp_3m,
    {roll("avg({c})", "rainfall_mm", 3, 3, False)} AS rolling_rainfall_3m,
    {roll("avg({c})", "temperature_c", 6, 6, False)} AS rolling_temp_6m,
    {roll("avg({c})", "rainfall_mm", 6, 6, False)} AS rolling_rainfall_6m,
    lead(temperature_c, 1) {W} AS target_temperature_next_month, lead(rainfall_mm, 1) {W} AS target_rainfall_next_month,
    -1.0::DOUBLE * (rainfall_mm + soil_moisture * 100.0::DOUBLE) AS dryness,
    min(temperature_c) OVER () AS tmin, max(temperature_c) OVER () AS tmax FROM conv""",
)
cte(
    "cuts", ("hist",),
    """SELECT *, quantile_cont(temperature_c, 0.75) OVER (PARTITION BY city) AS t75,
    quantile_cont(temperature_c, 0.9) OVER (PARTITION BY city) AS t90,
    quantile_cont(dryness, 0.75) OVER (PARTITION BY city) AS d75,
    quantile_cont(dryness, 0.9) OVER (PARTITION BY city) AS d90 FROM hist""",
)
cte(
    "labelled", ("cuts",),
    """SELECT *, CASE WHEN temperature_c > t90 THEN 'High' WHEN temperature_c > t75 THEN 'Medium' ELSE 'Low' END AS heatwave_risk,
    CASE WHEN dryness > d90 THEN 'High' WHEN dryness > d75 THEN 'Medium' ELSE 'Low' END AS drought_risk FROM cuts""",
)
cte(
    "master", ("labelled",),
    """SELECT city, climate_zone, latitude, longitude, date, year, month, temperature_c, rainfall_mm, soil_moisture, evabs, sro,
    month_sin, month_cos, temperature_prev_1, temperature_prev_3, rainfall_prev_1, rainfall_prev_3, soil_moisture_prev_1,
    rolling_temp_3m, rolling_rainfall_3m, rolling_temp_6m, rolling_rainfall_6m,
    target_temperature_next_month, target_rainfall_next_month, drought_risk, heatwave_risk,
    round(greatest(least(100.0::DOUBLE * (0.3::DOUBLE * ((temperature_c - tmin) / (tmax - tmin))
      + 0.35::DOUBLE * (CASE heatwave_risk WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.5 ELSE 0.0 END)::DOUBLE
      + 0.35::DOUBLE * (CASE drought_risk WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.5 ELSE 0.0 END)::DOUBLE), 100.0::DOUBLE), 0.0::DOUBLE), 2) AS climate_risk_score
    FROM labelled WHERE rolling_temp_6m IS NOT NULL AND rolling_rainfall_6m IS NOT NULL AND target_rainfall_next_month IS NOT NULL
      AND temperature_prev_3 IS NOT NULL""",
)


def streaks(source: str, conditions: dict[str, str], columns: str = "*") -> str:
    """Run lengths by gaps and islands: an island number per condition, then a running count."""
    flags = ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS f_{n}" for n, c in conditions.items())
    islands = ", ".join(f"sum(1 - f_{n}) {W} AS i_{n}" for n in conditions)
    runs = ", ".join(
        f"CAST(sum(f_{n}) OVER (PARTITION BY city, i_{n} ORDER BY date) AS BIGINT) AS {n}" for n in conditions
    )
    return f"SELECT {columns}, {runs} FROM (SELECT *, {islands} FROM (SELECT *, {flags} FROM ({source})))"


# Rainfall bundles.
cte(
    "rain0", ("master",),
    f"""SELECT *, avg(rainfall_mm) {PM} AS rainfall_climatology, avg(temperature_c) {PM} AS temperature_climatology,
    lag(rainfall_mm, 1) {W} AS lag_rain,
    {roll("stddev_samp({c})", "rainfall_mm", 3, 2)} AS rolling_rainfall_std_3m,
    {roll("stddev_samp({c})", "rainfall_mm", 6, 2)} AS rolling_rainfall_std_6m,
    {roll("median({c})", "rainfall_mm", 3, 2)} AS rolling_rainfall_median_3m,
    {roll("median({c})", "rainfall_mm", 6, 2)} AS rolling_rainfall_median_6m,
    lag(soil_moisture, 1) {W} - lag(soil_moisture, 2) {W} AS soil_moisture_trend,
    lag(evabs, 1) {W} - lag(evabs, 2) {W} AS evabs_trend, lag(sro, 1) {W} - lag(sro, 2) {W} AS sro_trend,
    soil_moisture - avg(soil_moisture) {ZM} AS soil_moisture_zone_anomaly,
    avg(rainfall_mm) {ZM} AS zone_rainfall_climatology, coalesce(stddev_samp(rainfall_mm) {ZM}, 1.0) AS zone_std
    FROM master""",
)
cte(
    "rain_prev", ("master",),
    """SELECT city, month % 12 + 1 AS month, avg(rainfall_mm) AS prev_normal FROM master GROUP BY 1, 2""",
)
cte(
    "rain", ("rain0", "rain_prev"),
    f"""SELECT r.*, r.rainfall_mm - rainfall_climatology AS rainfall_anomaly,
    (r.rainfall_mm - rainfall_climatology) / (rainfall_climatology + 1e-6) AS rainfall_anomaly_pct,
    rolling_rainfall_std_3m / (rolling_rainfall_3m + 1e-6) AS rolling_rainfall_cv_3m,
    rainfall_prev_1 - rainfall_prev_3 AS rainfall_trend,
    (rainfall_prev_1 - rolling_rainfall_3m) - (rolling_rainfall_3m - rolling_rainfall_6m) AS rainfall_acceleration,
    {clip("(rainfall_prev_1 - rainfall_prev_3) / (rainfall_prev_3 + 1e-6)", "-10.0::DOUBLE", "10.0::DOUBLE")} AS rainfall_growth_rate,
    rainfall_prev_1 - rainfall_climatology AS rainfall_momentum, rainfall_prev_1 - prev_normal AS rainfall_seasonal_deviation,
    temperature_c - temperature_climatology AS temperature_anomaly, rolling_temp_3m - rolling_temp_6m AS temp_trend_3m,
    r.rainfall_mm - zone_rainfall_climatology AS zone_rainfall_anomaly,
    (r.rainfall_mm - zone_rainfall_climatology) / (zone_rainfall_climatology + 1e-6) AS zone_rainfall_anomaly_pct,
    (r.rainfall_mm - zone_rainfall_climatology) / (zone_std + 1e-6) AS zone_rainfall_zscore
    FROM rain0 r LEFT JOIN rain_prev USING (city, month)""",
)
cte(
    "rain_streaks", ("rain",),
    streaks("SELECT * FROM rain", {"dry_months_streak": "lag_rain < 5", "wet_months_streak": "lag_rain > 50"}),
)

# Drought bundles.
EVAP = "(abs(evabs) * 30000.0::DOUBLE)"
cte(
    "dr0", ("master",),
    f"""SELECT *, {EVAP} AS evap, sro * 1000.0::DOUBLE AS runoff,
    avg(rainfall_mm) {PM} AS rainfall_climatology, coalesce(stddev_samp(rainfall_mm) {PM}, 1.0) AS rain_std,
    avg(rainfall_prev_1) {PM} AS lag_normal,
    avg(soil_moisture) {PM} AS sm_mean, coalesce(stddev_samp(soil_moisture) {PM}, 0.01) AS sm_std,
    avg(temperature_c) {PM} AS t_mean, coalesce(stddev_samp(temperature_c) {PM}, 1.0) AS t_std,
    quantile_cont(soil_moisture, 0.25) OVER (PARTITION BY city) AS sm_p25,
    {roll("avg({c})", "soil_moisture", 3, 2)} AS rolling_sm_3m, {roll("avg({c})", "soil_moisture", 6, 2)} AS rolling_sm_6m,
    lag(soil_moisture, 1) {W} AS lag_sm, lag(rainfall_mm, 1) {W} AS lag_rain,
    avg(rainfall_mm) OVER () AS rain_overall,
    avg(rainfall_mm) {ZM} AS z_rain, coalesce(stddev_samp(rainfall_mm) {ZM}, 1.0) AS z_rain_std,
    avg(soil_moisture) {ZM} AS z_sm, coalesce(stddev_samp(soil_moisture) {ZM}, 0.01) AS z_sm_std,
    {clip("avg(rainfall_mm) OVER (PARTITION BY climate_zone) / (avg(abs(evabs)) OVER (PARTITION BY climate_zone) * 30000.0::DOUBLE + 1.0::DOUBLE)", "0.0::DOUBLE", "20.0::DOUBLE")} AS zone_aridity_index,
    min(soil_moisture) OVER () AS sm_lo, max(soil_moisture) OVER () AS sm_hi,
    min(rainfall_mm) OVER () AS r_lo, max(rainfall_mm) OVER () AS r_hi, min(sro) OVER () AS q_lo, max(sro) OVER () AS q_hi
    FROM master""",
)
cte(
    "dr1", ("dr0",),
    f"""SELECT *, rainfall_mm - evap - runoff AS water_balance,
    {clip("rainfall_mm / (evap + 1e-6)", "0.0::DOUBLE", "20.0::DOUBLE")} AS rainfall_evap_ratio,
    {clip("rainfall_mm / (runoff + 1e-6)", "0.0::DOUBLE", "500.0::DOUBLE")} AS rainfall_runoff_ratio,
    {clip("evap / (rainfall_mm + 1.0::DOUBLE)", "0.0::DOUBLE", "100.0::DOUBLE")} AS evaporation_pressure,
    {clip("runoff / (rainfall_mm + 1e-6)", "0.0::DOUBLE", "1.0::DOUBLE")} AS runoff_efficiency,
    rainfall_mm - rainfall_climatology AS rainfall_deficit,
    {clip("(rainfall_mm - rainfall_climatology) / (rainfall_climatology + 1e-6) * 100.0::DOUBLE", "-200.0::DOUBLE", "200.0::DOUBLE")} AS rainfall_deficit_pct,
    {clip("(rainfall_mm - rainfall_climatology) / (rain_std + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} AS rainfall_spi,
    rainfall_prev_1 - lag_normal AS rainfall_deficit_lag1,
    soil_moisture - sm_mean AS sm_anomaly, {clip("(soil_moisture - sm_mean) / (sm_std + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} AS sm_zscore,
    {pos("sm_mean - soil_moisture")} AS sm_deficit, {pos("sm_mean - soil_moisture")} / (sm_mean + 1e-6) * 100.0::DOUBLE AS sm_deficit_pct,
    rolling_sm_3m - rolling_sm_6m AS sm_trend, soil_moisture - z_sm AS sm_zone_anomaly,
    temperature_c - t_mean AS temperature_anomaly,
    {clip("(temperature_c - t_mean) / (t_std + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} AS temperature_zscore,
    (temperature_c - t_mean) * (1.0::DOUBLE - {clip("rainfall_mm / (rain_overall + 1e-6)", "0.0::DOUBLE", "2.0::DOUBLE")}) AS temperature_stress,
    {pos("temperature_c - 35.0::DOUBLE")} AS heat_excess,
    rainfall_mm - z_rain AS zone_rain_deficit, {clip("(rainfall_mm - z_rain) / (z_rain_std + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} AS zone_rain_zscore,
    z_sm - soil_moisture AS zone_sm_deficit, {clip("(soil_moisture - z_sm) / (z_sm_std + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} AS zone_sm_zscore,
    0.4::DOUBLE * ((soil_moisture - sm_lo) / (sm_hi - sm_lo + 1e-6)) + 0.4::DOUBLE * ((rainfall_mm - r_lo) / (r_hi - r_lo + 1e-6))
      + 0.2::DOUBLE * ((sro - q_lo) / (q_hi - q_lo + 1e-6)) AS water_availability_index,
    {clip("evap / (rainfall_mm + soil_moisture * 100.0::DOUBLE + 1.0::DOUBLE)", "0.0::DOUBLE", "20.0::DOUBLE")} AS evaporation_stress
    FROM dr0""",
)
cte(
    "dr2", ("dr1",),
    f"""SELECT *, 1.0::DOUBLE - water_availability_index AS hydrological_stress,
    sm_deficit * (1.0::DOUBLE + {pos("temperature_anomaly")} / 10.0::DOUBLE) AS moisture_stress,
    abs(least(rainfall_deficit, 0.0::DOUBLE)) * sm_deficit AS compound_drought_stress,
    {roll("sum({c})", "rainfall_deficit", 3, 1)} AS cumulative_deficit_3m, {roll("sum({c})", "rainfall_deficit", 6, 1)} AS cumulative_deficit_6m,
    {roll("sum({c})", "sm_deficit", 3, 1)} AS cumulative_sm_deficit_3m, {roll("sum({c})", "sm_deficit", 6, 1)} AS cumulative_sm_deficit_6m,
    rainfall_deficit - lag(rainfall_deficit, 1) {W} AS drought_recovery, lag(rainfall_deficit, 1) {W} AS lag_deficit,
    ({roll("avg({c})", "rainfall_deficit", 3, 2)}) - ({roll("avg({c})", "rainfall_deficit", 6, 2)}) AS drought_momentum,
    lag(rainfall_deficit, 1) {W} - lag(rainfall_deficit, 2) {W} AS drought_trend,
    {roll("stddev_samp({c})", "rainfall_deficit", 3, 2)} AS deficit_volatility_3m FROM dr1""",
)
cte(
    "dr3", ("dr2",),
    streaks(
        f"SELECT *, drought_momentum - lag(drought_momentum, 1) {W} AS drought_acceleration FROM dr2",
        {
            "low_sm_streak": "lag_sm <= sm_p25",
            "dry_month_streak": "lag_rain < 10",
            "deficit_streak": "lag_deficit < 0",
        },
    ),
)


def scaled(x: str, eps: bool) -> str:
    low, high = f"min({x}) OVER ()", f"max({x}) OVER ()"
    if eps:
        return f"(({x} - {low}) / ({high} - {low} + 1e-6))"
    return f"(CASE WHEN {high} = {low} THEN 0.0::DOUBLE ELSE ({x} - {low}) / ({high} - {low}) END)"


def score(parts: list[tuple[float, str]], eps: bool) -> str:
    return " + ".join(f"{w}::DOUBLE * {scaled(x, eps)}" for w, x in parts)


cte(
    "dr_score", ("dr3",),
    "SELECT *, "
    + score(
        [(0.3, "(-rainfall_spi)"), (0.25, "(-sm_zscore)"), (0.15, "temperature_zscore"),
         (0.15, "evaporation_stress"), (0.15, "hydrological_stress")], True,
    )
    + " AS drought_severity_score FROM dr3",
)
cte(
    "dr_cat", ("dr_score",),
    """SELECT *, CASE drought_category WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE 3 END AS drought_category_ordinal
    FROM (SELECT *, CASE WHEN drought_severity_score < p30 THEN 'Low' WHEN drought_severity_score < p60 THEN 'Medium'
      WHEN drought_severity_score < p85 THEN 'High' ELSE 'Extreme' END AS drought_category
    FROM (SELECT *, quantile_cont(drought_severity_score, 0.3) OVER (PARTITION BY city) AS p30,
      quantile_cont(drought_severity_score, 0.6) OVER (PARTITION BY city) AS p60,
      quantile_cont(drought_severity_score, 0.85) OVER (PARTITION BY city) AS p85 FROM dr_score))""",
)

# Drought by baselines of the years up to FIT_UNTIL.
FIT_UNTIL = 1999


def between(x: str, name: str) -> str:
    """Scaled by fitted ends; values beyond them count as the ends. Null stays null."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (least(greatest({x}, {name}_lo), {name}_hi) - {name}_lo) / ({name}_hi - {name}_lo + 1e-6) END"
    )


def ends(parts: dict[str, str]) -> str:
    return ", ".join(f"min({x}) AS {n}_lo, max({x}) AS {n}_hi" for n, x in parts.items())


FIT_SUPPLY = {"fsm": "soil_moisture", "fr": "rainfall_mm", "fq": "sro"}
FIT_SIGNALS = {
    "gr": "-rainfall_spi", "gs": "-sm_zscore", "gt": "temperature_zscore", "ge": "evaporation_stress", "gw": "hydrological_stress",
}
cte("early", ("master",), f"SELECT * FROM master WHERE year <= {FIT_UNTIL}")
cte(
    "fit0", ("master", "early"),
    f"""SELECT m.*, {EVAP} AS evap, f.* EXCLUDE (city, month), z.* EXCLUDE (climate_zone, month), a.zone_aridity_index, o.*
    FROM master m LEFT JOIN (SELECT city, month, avg(rainfall_mm) AS rain_mean, stddev_samp(rainfall_mm) AS rain_std, avg(soil_moisture) AS sm_mean,
      stddev_samp(soil_moisture) AS sm_std, avg(temperature_c) AS t_mean, stddev_samp(temperature_c) AS t_std FROM early GROUP BY 1, 2) f USING (city, month)
    LEFT JOIN (SELECT climate_zone, month, avg(rainfall_mm) AS z_rain, stddev_samp(rainfall_mm) AS z_rain_std FROM early GROUP BY 1, 2) z USING (climate_zone, month)
    LEFT JOIN (SELECT climate_zone, {clip("avg(rainfall_mm) / (avg(abs(evabs)) * 30000.0::DOUBLE + 1.0::DOUBLE)", "0.0::DOUBLE", "20.0::DOUBLE")} AS zone_aridity_index
      FROM early GROUP BY 1) a USING (climate_zone) CROSS JOIN (SELECT {ends(FIT_SUPPLY)} FROM early) o""",
)
cte(
    "fit1", ("fit0",),
    f"""SELECT *, rainfall_mm - rain_mean AS rainfall_deficit,
    CASE WHEN rain_mean IS NOT NULL THEN {clip("(rainfall_mm - rain_mean) / (coalesce(rain_std, 1.0) + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} END AS rainfall_spi,
    CASE WHEN sm_mean IS NOT NULL THEN {clip("(soil_moisture - sm_mean) / (coalesce(sm_std, 0.01) + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} END AS sm_zscore,
    CASE WHEN t_mean IS NOT NULL THEN {clip("(temperature_c - t_mean) / (coalesce(t_std, 1.0) + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} END AS temperature_zscore,
    CASE WHEN z_rain IS NOT NULL THEN {clip("(rainfall_mm - z_rain) / (coalesce(z_rain_std, 1.0) + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} END AS zone_rain_zscore,
    {clip("evap / (rainfall_mm + soil_moisture * 100.0::DOUBLE + 1.0::DOUBLE)", "0.0::DOUBLE", "20.0::DOUBLE")} AS evaporation_stress,
    1.0::DOUBLE - (0.4::DOUBLE * ({between("soil_moisture", "fsm")}) + 0.4::DOUBLE * ({between("rainfall_mm", "fr")}) + 0.2::DOUBLE * ({between("sro", "fq")})) AS hydrological_stress
    FROM fit0""",
)
cte(
    "fit2", ("fit1",),
    "SELECT *, " + " + ".join(f"{w}::DOUBLE * ({between(x, n)})" for w, (n, x) in zip((0.3, 0.25, 0.15, 0.15, 0.15), FIT_SIGNALS.items(), strict=True))
    + f" AS drought_severity_score FROM fit1 CROSS JOIN (SELECT {ends(FIT_SIGNALS)} FROM fit1 WHERE year <= {FIT_UNTIL})",
)
cte(
    "fit3", ("fit2",),
    f"""SELECT *, CASE WHEN drought_severity_score < p30 THEN 'Low' WHEN drought_severity_score < p60 THEN 'Medium'
    WHEN drought_severity_score < p85 THEN 'High' WHEN drought_severity_score IS NOT NULL AND p85 IS NOT NULL THEN 'Extreme' END AS drought_category
    FROM fit2 LEFT JOIN (SELECT city, quantile_cont(drought_severity_score, 0.3) AS p30, quantile_cont(drought_severity_score, 0.6) AS p60,
      quantile_cont(drought_severity_score, 0.85) AS p85 FROM fit2 WHERE year <= {FIT_UNTIL} GROUP BY 1) USING (city)""",
)


# Heat and extreme-rain bundles.
def zero_std(x: str, value: str) -> str:
    return f"CASE WHEN {x} = 0 THEN {value}::DOUBLE ELSE {x} END"


cte(
    "climo", ("master",),
    f"""SELECT *, avg(temperature_c) {PM} AS temp_climo_mean, {zero_std(f"stddev_samp(temperature_c) {PM}", "0.1")} AS temp_climo_std,
    avg(rainfall_mm) {PM} AS rain_climo_mean, {zero_std(f"stddev_samp(rainfall_mm) {PM}", "0.01")} AS rain_climo_std,
    avg(soil_moisture) {PM} AS sm_climo_mean, {zero_std(f"stddev_samp(soil_moisture) {PM}", "0.001")} AS sm_climo_std,
    avg(temperature_c) {ZM} AS zone_temp_mean, {zero_std(f"stddev_samp(temperature_c) {ZM}", "0.1")} AS zone_temp_std,
    avg(rainfall_mm) {ZM} AS zone_rain_mean, {zero_std(f"stddev_samp(rainfall_mm) {ZM}", "0.01")} AS zone_rain_std,
    avg(temperature_c) OVER (PARTITION BY month) AS seasonal_temp_mean, avg(rainfall_mm) OVER (PARTITION BY month) AS seasonal_rain_mean
    FROM master""",
)
cte(
    "ew0", ("climo",),
    f"""SELECT *, {EVAP} AS evap, sro * 1000.0::DOUBLE AS runoff, temperature_c - temp_climo_mean AS hw_temperature_anomaly,
    {pos("temperature_c - 35.0::DOUBLE")} AS hw_heat_excess,
    {clip("rainfall_mm / (rain_climo_mean + 1e-6)", "0.0::DOUBLE", "2.0::DOUBLE")} AS rho,
    {pos("sm_climo_mean - soil_moisture")} AS dry, min(temperature_c) OVER () AS tmin,
    {clip("soil_moisture * 100.0::DOUBLE", "20.0::DOUBLE", "95.0::DOUBLE")} / 100.0::DOUBLE AS h,
    temperature_c AS t, {clip("sro * 1000.0::DOUBLE / (rainfall_mm + 1e-6)", "0.0::DOUBLE", "5.0::DOUBLE")} AS er_runoff_pressure,
    {clip("soil_moisture / 0.45::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")} AS er_soil_saturation,
    rainfall_mm - rain_climo_mean AS er_rainfall_anomaly,
    {clip("(rainfall_mm - rain_climo_mean) / rain_climo_std", "-5.0::DOUBLE", "5.0::DOUBLE")} AS er_rainfall_zscore,
    lag(rainfall_mm, 1) {W} AS lag_rain FROM climo""",
)
SHARE = clip("rainfall_mm / (rain_climo_mean + 1e-6)", "0.0::DOUBLE", "5.0::DOUBLE")
cte(
    "ew1", ("ew0",),
    f"""SELECT *, {pos("hw_temperature_anomaly")} AS hot,
    lag(hw_temperature_anomaly, 1) {W} AS lag_anomaly,
    {clip("hw_temperature_anomaly / temp_climo_std", "-5.0::DOUBLE", "5.0::DOUBLE")} AS hw_temperature_zscore,
    hw_temperature_anomaly * {pos("2.0::DOUBLE - rho")} AS hw_heat_stress,
    hw_heat_excess * (1.0::DOUBLE - {clip("soil_moisture / 0.5::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")}) AS hw_dry_heat_indicator,
    {clip("evap / (abs(temperature_c) + 1.0::DOUBLE)", "0.0::DOUBLE", "20.0::DOUBLE")} AS hw_evaporation_heat_ratio,
    temperature_c - zone_temp_mean AS hw_climate_zone_heat_anomaly,
    {clip("(temperature_c - zone_temp_mean) / (zone_temp_std + 1e-6)", "-5.0::DOUBLE", "5.0::DOUBLE")} AS hw_zone_temp_zscore,
    temperature_c - seasonal_temp_mean AS hw_seasonal_heat_deviation, rolling_temp_3m - rolling_temp_6m AS hw_rolling_temp_trend_3m,
    {roll("avg({c})", "hw_temperature_anomaly", 3, 1)} AS hw_rolling_heat_3m, {roll("avg({c})", "hw_temperature_anomaly", 6, 1)} AS hw_rolling_heat_6m,
    greatest(least(-8.78469475556::DOUBLE + 1.61139411::DOUBLE*t + 2.33854883889::DOUBLE*h - 0.14611605::DOUBLE*t*h
      - 0.012308094::DOUBLE*t*t - 0.0164248277778::DOUBLE*h*h + 0.002211732::DOUBLE*t*t*h + 0.00072546::DOUBLE*t*h*h
      - 0.000003582::DOUBLE*t*t*h*h, 55.0::DOUBLE), tmin) AS hw_apparent_temperature,
    rainfall_mm / 30.44::DOUBLE AS er_rainfall_intensity, rainfall_mm - rolling_rainfall_3m AS er_rainfall_surge,
    rainfall_mm - rolling_rainfall_6m AS er_rainfall_momentum,
    (rainfall_mm - rolling_rainfall_3m) - (rolling_rainfall_3m - rolling_rainfall_6m) AS er_rainfall_acceleration,
    coalesce({clip("(" + roll("stddev_samp({c})", "rainfall_mm", 3, 2) + ") / ((" + roll("avg({c})", "rainfall_mm", 3, 2) + ") + 1e-6)", "0.0::DOUBLE", "10.0::DOUBLE")}, 0.0) AS er_rainfall_variability_3m,
    coalesce({clip("(" + roll("stddev_samp({c})", "rainfall_mm", 6, 2) + ") / ((" + roll("avg({c})", "rainfall_mm", 6, 2) + ") + 1e-6)", "0.0::DOUBLE", "10.0::DOUBLE")}, 0.0) AS er_rainfall_variability_6m,
    {pos("er_rainfall_zscore")} AS er_extreme_precipitation_index, {clip("runoff", "0.0::DOUBLE", "50.0::DOUBLE")} AS er_runoff_response,
    greatest(least(({SHARE}) * least(er_runoff_pressure, 3.0::DOUBLE) * er_soil_saturation, 10.0::DOUBLE), 0.0::DOUBLE) AS er_flood_potential_proxy,
    coalesce(lag(soil_moisture, 1) {W}, sm_climo_mean) AS er_antecedent_soil_moisture,
    greatest(rainfall_mm - evap - runoff, -500.0::DOUBLE) AS er_water_surplus,
    rainfall_mm - zone_rain_mean AS er_zone_rainfall_anomaly,
    {clip("(rainfall_mm - zone_rain_mean) / (zone_rain_std + 1e-6)", "-5.0::DOUBLE", "5.0::DOUBLE")} AS er_zone_rainfall_zscore,
    rainfall_mm - seasonal_rain_mean AS er_seasonal_rainfall_deviation,
    {roll("sum({c})", "rainfall_mm", 3, 1)} AS er_cumulative_rain_3m, {roll("sum({c})", "rainfall_mm", 6, 1)} AS er_cumulative_rain_6m,
    CASE WHEN month IN (6, 7, 8, 9) THEN 1 ELSE 0 END AS er_is_monsoon,
    greatest(0.0::DOUBLE, sin(pi() * (month - 4) / 6.0::DOUBLE)) AS er_monsoon_phase_factor,
    {clip("evap / (rainfall_mm + 1e-6)", "0.0::DOUBLE", "20.0::DOUBLE")} AS er_evaporation_demand_ratio FROM ew0""",
)
cte(
    "ew", ("ew1",),
    streaks(
        f"""SELECT *, {clip("hot / (zone_temp_std + 1e-6)", "0.0::DOUBLE", "5.0::DOUBLE")} AS hw_heatwave_intensity,
        hw_rolling_heat_3m - hw_rolling_heat_6m AS hw_heat_acceleration, hot * {pos("1.0::DOUBLE - rho")} AS hw_rainfall_heat_interaction,
        hot * dry AS hw_soil_heat_interaction, hw_apparent_temperature - temp_climo_mean AS hw_apparent_temp_anomaly,
        hot * dry * {pos("1.0::DOUBLE - rho")} AS hw_compound_heat_drought,
        {clip("er_extreme_precipitation_index * er_soil_saturation", "0.0::DOUBLE", "5.0::DOUBLE")} AS er_compound_rainfall_saturation FROM ew1""",
        {
            "hw_consecutive_hot_months": "lag_anomaly > temp_climo_std",
            "er_consecutive_wet_months": "lag_rain > rain_climo_mean",
        },
    ),
)
cte(
    "ew_in", ("ew",),
    f"""SELECT *, {pos("hw_heat_stress")} AS s2, {pos("rain_climo_mean - rainfall_mm")} AS s4,
    {clip("evap / (rainfall_mm + 1.0::DOUBLE)", "0.0::DOUBLE", "50.0::DOUBLE")} AS s5, {pos("er_rainfall_anomaly")} AS e1,
    {pos("er_rainfall_acceleration")} AS e5 FROM ew""",
)
cte(
    "ew_score", ("ew_in",),
    "SELECT *, greatest(least("
    + score([(0.35, "hot"), (0.25, "s2"), (0.15, "dry"), (0.15, "s4"), (0.10, "s5")], False)
    + ", 1.0::DOUBLE), 0.0::DOUBLE) AS heatwave_severity_score, greatest(least("
    + score(
        [(0.35, "e1"), (0.25, "er_rainfall_intensity"), (0.20, "er_runoff_pressure"), (0.10, "er_soil_saturation"), (0.10, "e5")],
        False,
    )
    + ", 1.0::DOUBLE), 0.0::DOUBLE) AS extreme_rainfall_score FROM ew_in",
)


def _cat(name: str, x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {name}_p50 THEN 'Low' WHEN {x} <= {name}_p75 THEN 'Medium' "
        f"WHEN {x} <= {name}_p90 THEN 'High' ELSE 'Extreme' END AS {name}_category"
    )


def _edges(name: str, x: str) -> str:
    return ", ".join(
        f"quantile_cont({x}, {p / 100}) OVER (PARTITION BY city) AS {name}_p{p}" for p in (50, 75, 90)
    )


ORDINAL = "CASE {0} WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 WHEN 'Extreme' THEN 3 END"
cte(
    "ew_cat", ("ew_score",),
    f"""SELECT *, {_cat("heatwave", "heatwave_severity_score")}, {_cat("extreme_rainfall", "extreme_rainfall_score")}
    FROM (SELECT *, {_edges("heatwave", "heatwave_severity_score")}, {_edges("extreme_rainfall", "extreme_rainfall_score")} FROM ew_score)""",
)

# Heat and extreme rain by baselines of the years up to FIT_UNTIL.
HEAT_SIGNALS = {"fh1": "hot", "fh2": "heat_stress", "fh3": "dry", "fh4": "rainless", "fh5": "demand"}
WET_SIGNALS = {"fe1": "wet", "fe2": "intensity", "fe3": "runoff_pressure", "fe4": "saturation", "fe5": "accelerating"}


def within(x: str, name: str) -> str:
    """Scaled by fitted ends, 0 for a constant; values beyond the ends count as the ends. Null stays null."""
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {name}_hi = {name}_lo THEN 0.0::DOUBLE "
        f"ELSE (least(greatest({x}, {name}_lo), {name}_hi) - {name}_lo) / ({name}_hi - {name}_lo) END"
    )


def fitted_score(weights: tuple[float, ...], signals: dict[str, str]) -> str:
    return clip(" + ".join(f"{w}::DOUBLE * ({within(x, n)})" for w, (n, x) in zip(weights, signals.items(), strict=True)), "0.0::DOUBLE", "1.0::DOUBLE")


cte(
    "fx0", ("master", "early"),
    f"""SELECT m.*, {EVAP} AS evap, p.* EXCLUDE (city, month), z.* EXCLUDE (climate_zone, month), s.* EXCLUDE (month)
    FROM master m LEFT JOIN (SELECT city, month, avg(temperature_c) AS temp_climo_mean, {zero_std("stddev_samp(temperature_c)", "0.1")} AS temp_climo_std,
      avg(rainfall_mm) AS rain_climo_mean, {zero_std("stddev_samp(rainfall_mm)", "0.01")} AS rain_climo_std, avg(soil_moisture) AS sm_climo_mean
      FROM early GROUP BY 1, 2) p USING (city, month)
    LEFT JOIN (SELECT climate_zone, month, avg(temperature_c) AS zone_temp_mean, {zero_std("stddev_samp(temperature_c)", "0.1")} AS zone_temp_std,
      avg(rainfall_mm) AS zone_rain_mean FROM early GROUP BY 1, 2) z USING (climate_zone, month)
    LEFT JOIN (SELECT month, avg(temperature_c) AS seasonal_temp_mean, avg(rainfall_mm) AS seasonal_rain_mean FROM early GROUP BY 1) s USING (month)""",
)
cte(
    "fx1", ("fx0",),
    f"""SELECT *, temperature_c - temp_climo_mean AS hw_temperature_anomaly,
    {clip("(temperature_c - temp_climo_mean) / temp_climo_std", "-5.0::DOUBLE", "5.0::DOUBLE")} AS hw_temperature_zscore,
    {clip("(temperature_c - zone_temp_mean) / (zone_temp_std + 1e-6)", "-5.0::DOUBLE", "5.0::DOUBLE")} AS hw_zone_temp_zscore,
    temperature_c - seasonal_temp_mean AS hw_seasonal_heat_deviation,
    rainfall_mm - rain_climo_mean AS er_rainfall_anomaly,
    {clip("(rainfall_mm - rain_climo_mean) / rain_climo_std", "-5.0::DOUBLE", "5.0::DOUBLE")} AS er_rainfall_zscore,
    rainfall_mm - zone_rain_mean AS er_zone_rainfall_anomaly, rainfall_mm - seasonal_rain_mean AS er_seasonal_rainfall_deviation,
    (temperature_c - temp_climo_mean) * ({pos("2.0::DOUBLE - (" + clip("rainfall_mm / (rain_climo_mean + 1e-6)", "0.0::DOUBLE", "2.0::DOUBLE") + ")")}) AS hw_heat_stress,
    {pos("temperature_c - temp_climo_mean")} AS hot, {pos("sm_climo_mean - soil_moisture")} AS dry, {pos("rain_climo_mean - rainfall_mm")} AS rainless,
    {clip("evap / (rainfall_mm + 1.0::DOUBLE)", "0.0::DOUBLE", "50.0::DOUBLE")} AS demand, {pos("rainfall_mm - rain_climo_mean")} AS wet,
    rainfall_mm / 30.44::DOUBLE AS intensity, {clip("sro * 1000.0::DOUBLE / (rainfall_mm + 1e-6)", "0.0::DOUBLE", "5.0::DOUBLE")} AS runoff_pressure,
    {clip("soil_moisture / 0.45::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")} AS saturation,
    {pos("(rainfall_mm - rolling_rainfall_3m) - (rolling_rainfall_3m - rolling_rainfall_6m)")} AS accelerating FROM fx0""",
)
cte("fx2", ("fx1",), f"SELECT *, {pos('hw_heat_stress')} AS heat_stress FROM fx1")
cte(
    "fx3", ("fx2",),
    f"""SELECT *, {fitted_score((0.35, 0.25, 0.15, 0.15, 0.10), HEAT_SIGNALS)} AS heatwave_severity_score,
    {fitted_score((0.35, 0.25, 0.20, 0.10, 0.10), WET_SIGNALS)} AS extreme_rainfall_score
    FROM fx2 CROSS JOIN (SELECT {ends(HEAT_SIGNALS | WET_SIGNALS)} FROM fx2 WHERE year <= {FIT_UNTIL})""",
)


def _fitted_edges(name: str, x: str) -> str:
    return ", ".join(f"quantile_cont({x}, {p / 100}) AS {name}_p{p}" for p in (50, 75, 90))


cte(
    "fx4", ("fx3",),
    f"""SELECT *, CASE WHEN heatwave_p90 IS NOT NULL THEN {_cat("heatwave", "heatwave_severity_score").removesuffix(" AS heatwave_category")} END AS heatwave_category,
    CASE WHEN extreme_rainfall_p90 IS NOT NULL THEN {_cat("extreme_rainfall", "extreme_rainfall_score").removesuffix(" AS extreme_rainfall_category")} END AS extreme_rainfall_category
    FROM fx3 LEFT JOIN (SELECT city, {_fitted_edges("heatwave", "heatwave_severity_score")}, {_fitted_edges("extreme_rainfall", "extreme_rainfall_score")}
      FROM fx3 WHERE year <= {FIT_UNTIL} GROUP BY 1) USING (city)""",
)

# The rainfall table by normals of the years up to FIT_UNTIL.
cte(
    "fr", ("rain0", "early"),
    f"""SELECT r.city, r.date, r.year, r.month, r.rainfall_mm, p.rain_mean AS normal, r.rainfall_mm - p.rain_mean AS rainfall_anomaly,
    (r.rainfall_mm - p.rain_mean) / (p.rain_mean + 1e-6) AS rainfall_anomaly_pct,
    r.rainfall_prev_1 - p.rain_mean AS rainfall_momentum, r.rainfall_prev_1 - b.rain_mean AS rainfall_seasonal_deviation,
    r.temperature_c - p.t_mean AS temperature_anomaly, r.soil_moisture - z.z_sm AS soil_moisture_zone_anomaly,
    r.rainfall_mm - z.z_rain AS zone_rainfall_anomaly, (r.rainfall_mm - z.z_rain) / (coalesce(z.z_std, 1.0) + 1e-6) AS zone_rainfall_zscore
    FROM rain0 r JOIN (SELECT city, month, avg(rainfall_mm) AS rain_mean, avg(temperature_c) AS t_mean FROM early GROUP BY 1, 2) p
      ON r.city = p.city AND r.month = p.month
    JOIN (SELECT city, month % 12 + 1 AS month, avg(rainfall_mm) AS rain_mean FROM early GROUP BY 1, 2) b ON r.city = b.city AND r.month = b.month
    JOIN (SELECT climate_zone, month, avg(soil_moisture) AS z_sm, avg(rainfall_mm) AS z_rain, stddev_samp(rainfall_mm) AS z_std FROM early GROUP BY 1, 2) z
      ON r.climate_zone = z.climate_zone AND r.month = z.month
    WHERE r.rolling_rainfall_std_3m IS NOT NULL AND r.rolling_rainfall_median_6m IS NOT NULL AND r.sro_trend IS NOT NULL""",
)

# Observation tables.
cte(
    "obs", (),
    """SELECT event_id AS id, user_id AS district_id, value * CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0::DOUBLE AS rainfall,
    value AS temperature, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity, CAST(ts AS DATE) AS observation_date, ts, event_type FROM events""",
)
cte(
    "districts", (),
    """SELECT c_custkey AS district_id, c_name AS district_name, n_name AS state,
    8.0::DOUBLE + (c_custkey * 11 % 467)::DOUBLE / 16.0::DOUBLE AS latitude,
    68.0::DOUBLE + (c_custkey * 17 % 463)::DOUBLE / 16.0::DOUBLE AS longitude
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
cte(
    "fcst", (),
    """SELECT o_orderkey AS id, o_custkey AS district_id, o_totalprice / 1000.0::DOUBLE AS predicted_rainfall,
    o_totalprice / 10000.0::DOUBLE AS predicted_temperature, CAST(o_orderdate AS DATE) AS forecast_date, o_orderstatus FROM orders""",
)


def mean(c: str) -> str:
    """Average from a decimal sum."""
    return f"(CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DOUBLE) / nullif(count({c}), 0)::DOUBLE)"


def mean2(c: str, name: str) -> str:
    return f"round(coalesce({mean(c)}, 0.0), 2) AS {name}"


MEANS = ", ".join(mean2(c, f"average_{c}") for c in ("rainfall", "temperature", "humidity"))

# Chained evaluation of districts.
cte(
    "pmc", ("master",),
    f"""SELECT city, month, avg(temperature_c) AS temp_climo_mean, {zero_std("stddev_samp(temperature_c)", "0.1")} AS temp_climo_std,
    avg(rainfall_mm) AS rain_climo_mean, {zero_std("stddev_samp(rainfall_mm)", "0.01")} AS rain_climo_std,
    avg(soil_moisture) AS sm_climo_mean, {zero_std("stddev_samp(soil_moisture)", "0.001")} AS sm_climo_std,
    avg(rainfall_prev_1) AS lag1_climatology FROM master GROUP BY 1, 2""",
)
cte(
    "zmc", ("master",),
    f"""SELECT climate_zone, month, avg(temperature_c) AS zone_temp_mean, {zero_std("stddev_samp(temperature_c)", "0.1")} AS zone_temp_std,
    avg(rainfall_mm) AS zone_rain_mean, {zero_std("stddev_samp(rainfall_mm)", "0.01")} AS zone_rain_std,
    avg(rainfall_mm) AS zone_rain_climatology, coalesce(stddev_samp(rainfall_mm), 1.0) AS zone_rain_climatology_std,
    avg(soil_moisture) AS zone_sm_climatology, coalesce(stddev_samp(soil_moisture), 0.01) AS zone_sm_climatology_std FROM master GROUP BY 1, 2""",
)
cte(
    "mc", ("master",),
    "SELECT month, avg(temperature_c) AS seasonal_temp_mean, avg(rainfall_mm) AS seasonal_rain_mean FROM master GROUP BY 1",
)
cte("overall", ("master",), "SELECT avg(rainfall_mm) AS overall_rain_mean, min(temperature_c) AS coldest_c FROM master")
cte(
    "known", ("master",),
    "SELECT city, any_value(climate_zone) AS climate_zone, any_value(latitude) AS lat, any_value(longitude) AS lon FROM master GROUP BY 1",
)
cte(
    "near", ("districts", "known"),
    """SELECT district_id, district_name, state, latitude, longitude, city, climate_zone FROM (
    SELECT d.*, k.city, k.climate_zone, row_number() OVER (PARTITION BY d.district_id
      ORDER BY (k.lat - d.latitude) * (k.lat - d.latitude) + (k.lon - d.longitude) * (k.lon - d.longitude), k.city) AS rn
    FROM districts d CROSS JOIN known k) WHERE rn = 1""",
)

# What a state row carries from history, with the value that stands where nothing is known.
CARRIED = {
    "dry_month_streak": 0.0, "deficit_streak": 0.0, "low_sm_streak": 0.0, "cumulative_deficit_3m": -10.0,
    "cumulative_deficit_6m": -25.0, "cumulative_sm_deficit_3m": 0.05, "cumulative_sm_deficit_6m": 0.10,
    "drought_acceleration": 0.0, "deficit_volatility_3m": 5.0, "consecutive_hot_months": 0.0, "consecutive_wet_months": 0.0,
}
cte(
    "carried", ("dr3", "ew"),
    """SELECT d.*, CAST(d.year * 12 + d.month AS BIGINT) AS known_at, e.hw_consecutive_hot_months AS consecutive_hot_months,
    e.er_consecutive_wet_months AS consecutive_wet_months FROM dr3 d JOIN ew e USING (city, date)""",
)


def history_match(requests: str, history: str) -> str:
    """Every request with the rank of every record of its city; the best one is kept."""
    gap = "abs((h.year - q.year) * 12 + (h.month - q.month))"
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT q.*, h.* EXCLUDE (city, year, month), h.year AS record_year, h.month AS record_month,
    CASE WHEN h.year = q.year AND h.month = q.month THEN 0 WHEN h.month = q.month THEN 1 WHEN h.city IS NOT NULL THEN 2 END AS match,
    row_number() OVER (PARTITION BY q.rid ORDER BY
      CASE WHEN h.year = q.year AND h.month = q.month THEN 0 WHEN h.month = q.month THEN 1 ELSE 2 END,
      CASE WHEN h.month = q.month THEN -h.year ELSE {gap} END, h.year * 12 + h.month) AS rn
    FROM ({requests}) q LEFT JOIN ({history}) h ON q.city = h.city) WHERE rn = 1"""


RECORD = """SELECT city, year, month, temperature_c, rainfall_mm, soil_moisture, evabs, sro, temperature_prev_1, temperature_prev_3,
    rainfall_prev_1, rainfall_prev_3, soil_moisture_prev_1, rolling_temp_3m, rolling_rainfall_3m, rolling_temp_6m, rolling_rainfall_6m,
    rolling_sm_3m, rolling_sm_6m, """ + ", ".join(f"{c} AS rec_{c}" for c in CARRIED) + " FROM carried"


def state_ctes(prefix: str, requests: str, needs: tuple[str, ...], local: bool, water: bool = False) -> str:
    """Chain of expressions from requests to evaluated rows; returns the last name.

    ``requests`` gives rid, district columns, city, climate_zone, latitude, longitude, year, month, scenario, td, rd, sd,
    and with ``water`` also ed and fd, the changes of evaporation and runoff.
    """
    p = prefix
    cte(f"{p}_r", (*needs, "carried"), history_match(requests, RECORD))
    # The last row at or before the month, if it is at most twelve months old; else the record's value.
    carried = ", ".join(
        f"coalesce(CASE WHEN r.year * 12 + r.month - c.known_at <= 12 THEN c.{n} END, rec_{n}, {v}::DOUBLE)::DOUBLE AS {n}"
        for n, v in CARRIED.items()
    )
    cte(
        f"{p}_m", (f"{p}_r", "carried"),
        f"""SELECT r.* EXCLUDE ({", ".join(f"rec_{n}" for n in CARRIED)}), {carried}
        FROM {p}_r r ASOF LEFT JOIN carried c ON r.city = c.city AND CAST(r.year * 12 + r.month AS BIGINT) >= c.known_at""",
    )
    ya = "greatest(year - record_year, 0)::DOUBLE"
    cte(
        f"{p}_s", (f"{p}_m", "pmc", "zmc", "mc", "overall"),
        f"""SELECT m.* REPLACE (
        temperature_c + 0.04::DOUBLE * {ya} AS temperature_c, temperature_prev_1 + 0.04::DOUBLE * {ya} AS temperature_prev_1,
        rolling_temp_3m + 0.04::DOUBLE * {ya} AS rolling_temp_3m, rolling_temp_6m + 0.04::DOUBLE * {ya} AS rolling_temp_6m,
        rainfall_mm * (1.0::DOUBLE + 0.002::DOUBLE * {ya}) AS rainfall_mm, rainfall_prev_1 * (1.0::DOUBLE + 0.002::DOUBLE * {ya}) AS rainfall_prev_1,
        rolling_rainfall_3m * (1.0::DOUBLE + 0.002::DOUBLE * {ya}) AS rolling_rainfall_3m, rolling_rainfall_6m * (1.0::DOUBLE + 0.002::DOUBLE * {ya}) AS rolling_rainfall_6m,
        soil_moisture * (1.0::DOUBLE - 0.001::DOUBLE * {ya}) AS soil_moisture,
        coalesce(rolling_sm_3m, 0.22) * (1.0::DOUBLE - 0.001::DOUBLE * {ya}) AS rolling_sm_3m,
        coalesce(rolling_sm_6m, 0.25) * (1.0::DOUBLE - 0.001::DOUBLE * {ya}) AS rolling_sm_6m),
        coalesce(lag1_climatology, 10.0) AS lag1_climatology, coalesce(zone_rain_climatology, 10.0) AS zone_rain_climatology,
        coalesce(zone_rain_climatology_std, 4.0) AS zone_rain_climatology_std, coalesce(zone_sm_climatology, 0.20) AS zone_sm_climatology,
        coalesce(zone_sm_climatology_std, 0.04) AS zone_sm_climatology_std, temp_climo_mean, coalesce(temp_climo_std, 2.0) AS temp_climo_std, rain_climo_mean, coalesce(rain_climo_std, 5.0) AS rain_climo_std,
        sm_climo_mean, coalesce(sm_climo_std, 0.05) AS sm_climo_std, zone_temp_mean, zone_temp_std, zone_rain_mean, zone_rain_std,
        seasonal_temp_mean, seasonal_rain_mean, overall_rain_mean, coldest_c
        FROM {p}_m m LEFT JOIN pmc USING (city, month) LEFT JOIN zmc USING (climate_zone, month) LEFT JOIN mc USING (month) CROSS JOIN overall""",
    )
    lt = "sin(latitude * 11.0::DOUBLE + longitude * 7.0::DOUBLE) * 1.5::DOUBLE + CASE WHEN latitude > 28 THEN (latitude - 28.0::DOUBLE) * -2.2::DOUBLE ELSE 0.0 END"
    lr = "cos(latitude * 13.0::DOUBLE + longitude * 17.0::DOUBLE) * 12.0::DOUBLE"
    ls = "sin(latitude * longitude) * 0.04::DOUBLE"
    if not local:
        lt = lr = ls = "0.0::DOUBLE"
    flows = "greatest(sro, 0.0::DOUBLE) AS sro"
    if water:
        flows = """greatest(sro * (1.0::DOUBLE + fd / 100.0::DOUBLE), 0.0::DOUBLE) AS sro,
        evabs * (1.0::DOUBLE + ed / 100.0::DOUBLE) AS evabs"""
    cte(
        f"{p}_l", (f"{p}_s",),
        f"""SELECT * REPLACE (temperature_c + td + ({lt}) AS temperature_c,
        greatest(greatest(rainfall_mm, 0.0::DOUBLE) * (1.0::DOUBLE + rd / 100.0::DOUBLE) + ({lr}), 0.0::DOUBLE) AS rainfall_mm,
        greatest(least(soil_moisture * (1.0::DOUBLE + sd / 100.0::DOUBLE) + ({ls}), 1.0::DOUBLE), 0.0::DOUBLE) AS soil_moisture,
        {flows}), greatest(rainfall_mm, 0.0::DOUBLE) AS model_rain FROM {p}_s""",
    )
    cte(
        f"{p}_f", (f"{p}_l",),
        f"""SELECT *, {EVAP} AS evap, sro * 1000.0::DOUBLE AS runoff, rainfall_mm - rain_climo_mean AS rainfall_deficit,
        {clip("(rainfall_mm - rain_climo_mean) / (rain_climo_mean + 1e-6) * 100.0::DOUBLE", "-200.0::DOUBLE", "200.0::DOUBLE")} AS rainfall_deficit_pct,
        {clip("(rainfall_mm - rain_climo_mean) / (rain_climo_std + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} AS rainfall_spi,
        {clip("(soil_moisture - sm_climo_mean) / (sm_climo_std + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} AS sm_zscore,
        soil_moisture - sm_climo_mean AS sm_anomaly, {pos("sm_climo_mean - soil_moisture")} AS sm_deficit,
        {clip("(temperature_c - temp_climo_mean) / (temp_climo_std + 1e-6)", "-4.0::DOUBLE", "4.0::DOUBLE")} AS temperature_zscore,
        temperature_c - temp_climo_mean AS temperature_anomaly, {pos("temperature_c - 35.0::DOUBLE")} AS heat_excess,
        (temperature_c - temp_climo_mean) * (1.0::DOUBLE - {clip("rainfall_mm / (overall_rain_mean + 1e-6)", "0.0::DOUBLE", "2.0::DOUBLE")}) AS temperature_stress,
        rainfall_mm - {EVAP} - sro * 1000.0::DOUBLE AS water_balance,
        {clip(EVAP + " / (rainfall_mm + 1.0::DOUBLE)", "0.0::DOUBLE", "100.0::DOUBLE")} AS evaporation_pressure,
        {clip(EVAP + " / (rainfall_mm + soil_moisture * 100.0::DOUBLE + 1.0::DOUBLE)", "0.0::DOUBLE", "20.0::DOUBLE")} AS evaporation_stress,
        1.0::DOUBLE - (0.4::DOUBLE * {clip("soil_moisture / 0.5::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")} + 0.4::DOUBLE * {clip("rainfall_mm / 500.0::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")}
          + 0.2::DOUBLE * {clip("sro / 0.1::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")}) AS hydrological_stress,
        cumulative_deficit_3m / 3.0::DOUBLE - cumulative_deficit_6m / 6.0::DOUBLE AS drought_momentum,
        (rainfall_mm - rain_climo_mean) - (rainfall_prev_1 - lag1_climatology) AS drought_trend,
        {clip("(temperature_c - temp_climo_mean) / greatest(0.1::DOUBLE, temp_climo_std)", "-5.0::DOUBLE", "5.0::DOUBLE")} AS hz,
        {clip("greatest(temperature_c - temp_climo_mean, 0.0::DOUBLE) / (greatest(0.1::DOUBLE, zone_temp_std) + 1e-6)", "0.0::DOUBLE", "5.0::DOUBLE")} AS hi,
        {clip("(rainfall_mm - rain_climo_mean) / greatest(0.01::DOUBLE, rain_climo_std)", "-5.0::DOUBLE", "5.0::DOUBLE")} AS ez,
        {clip("sro * 1000.0::DOUBLE / (rainfall_mm + 1e-6)", "0.0::DOUBLE", "5.0::DOUBLE")} AS er_runoff_pressure,
        {clip("soil_moisture / 0.45::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")} AS er_soil_saturation,
        rainfall_mm / 30.44::DOUBLE AS er_rainfall_intensity,
        (temperature_c - temp_climo_mean) * greatest(2.0::DOUBLE - {clip("rainfall_mm / (rain_climo_mean + 1e-6)", "0.0::DOUBLE", "2.0::DOUBLE")}, 0.0::DOUBLE) AS hw_heat_stress
        FROM {p}_l""",
    )
    cte(
        f"{p}_sev", (f"{p}_f",),
        f"""SELECT *, sm_deficit * (1.0::DOUBLE + greatest(temperature_anomaly, 0.0::DOUBLE) / 10.0::DOUBLE) AS moisture_stress,
        greatest(least(0.3::DOUBLE * ((4.0::DOUBLE - rainfall_spi) / 8.0::DOUBLE) + 0.25::DOUBLE * ((4.0::DOUBLE - sm_zscore) / 8.0::DOUBLE)
          + 0.15::DOUBLE * ((4.0::DOUBLE + temperature_zscore) / 8.0::DOUBLE) + 0.15::DOUBLE * (evaporation_stress / 20.0::DOUBLE)
          + 0.15::DOUBLE * hydrological_stress, 1.0::DOUBLE), 0.0::DOUBLE) AS ds,
        greatest(least(0.6::DOUBLE * (greatest(hz, 0.0::DOUBLE) / 5.0::DOUBLE) + 0.4::DOUBLE * (hi / 5.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS hs,
        greatest(least(0.6::DOUBLE * (greatest(ez, 0.0::DOUBLE) / 5.0::DOUBLE) + 0.25::DOUBLE * least(er_runoff_pressure, 1.0::DOUBLE)
          + 0.15::DOUBLE * er_soil_saturation, 1.0::DOUBLE), 0.0::DOUBLE) AS es FROM {p}_f""",
    )
    probs = ", ".join(
        f"(1.0::DOUBLE-{s})*(1.0::DOUBLE-{s})*(1.0::DOUBLE-{s}) AS {h}0, 3.0::DOUBLE*{s}*(1.0::DOUBLE-{s})*(1.0::DOUBLE-{s}) AS {h}1, "
        f"3.0::DOUBLE*{s}*{s}*(1.0::DOUBLE-{s}) AS {h}2, {s}*{s}*{s} AS {h}3"
        for h, s in (("dp", "ds"), ("hp", "hs"), ("ep", "es"))
    )
    cte(f"{p}_p", (f"{p}_sev",), f"SELECT *, {probs} FROM {p}_sev")

    def category(h: str) -> str:
        best = f"greatest({h}0, {h}1, {h}2, {h}3)"
        return f"CASE {best} WHEN {h}0 THEN 'Low' WHEN {h}1 THEN 'Medium' WHEN {h}2 THEN 'High' ELSE 'Extreme' END"

    cte(
        f"{p}_c", (f"{p}_p",),
        f"""SELECT *, dp2 + dp3 AS drought_risk, {category("dp")} AS drought_category, round(greatest(dp0, dp1, dp2, dp3), 3) AS drought_confidence,
        CASE WHEN greatest(dp0, dp1, dp2, dp3) >= 0.85 THEN 'High' WHEN greatest(dp0, dp1, dp2, dp3) >= 0.65 THEN 'Medium' ELSE 'Low' END AS drought_confidence_level,
        round(dp2 + dp3, 3) AS drought_severity_score, {category("hp")} AS heatwave_category, {category("ep")} AS extreme_rainfall_category,
        round(greatest(least(hs * 100.0::DOUBLE, 100.0::DOUBLE), 0.0::DOUBLE), 1) AS heatwave_severity,
        round(greatest(least(es * 100.0::DOUBLE, 100.0::DOUBLE), 0.0::DOUBLE), 1) AS extreme_rainfall_severity,
        round(greatest(hp0, hp1, hp2, hp3), 3) AS heatwave_confidence, round(greatest(ep0, ep1, ep2, ep3), 3) AS extreme_rainfall_confidence
        FROM {p}_p""",
    )
    cte(
        f"{p}_o", (f"{p}_c",),
        f"""SELECT *, CASE WHEN overall_risk_score >= 80 THEN 'Extreme' WHEN overall_risk_score >= 60 THEN 'High'
        WHEN overall_risk_score >= 35 THEN 'Medium' ELSE 'Low' END AS overall_risk_category FROM (SELECT *,
        round(greatest(least(0.8::DOUBLE * greatest(heatwave_severity, extreme_rainfall_severity)
          + 0.2::DOUBLE * ((heatwave_severity + extreme_rainfall_severity) / 2.0::DOUBLE)
          + CASE WHEN hp2 + hp3 > 0.35 AND ep2 + ep3 > 0.35 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END, 100.0::DOUBLE), 0.0::DOUBLE), 1) AS overall_risk_score,
        {clip("(0.4::DOUBLE - soil_moisture) / 0.4::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")} AS k_dry,
        {clip("(temperature_c - 25.0::DOUBLE) / 20.0::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")} AS k_warm,
        {clip("abs(evabs) / 0.006::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")} AS k_thirst,
        {clip("1.0::DOUBLE - sro / 0.15::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE")} AS k_runoff FROM {p}_c)""",
    )
    cte(
        f"{p}_h", (f"{p}_o",),
        """SELECT *, round(greatest(least(0.45::DOUBLE * k_dry + 0.35::DOUBLE * k_thirst + 0.2::DOUBLE * k_runoff, 1.0::DOUBLE), 0.0::DOUBLE), 4) AS water_stress_index,
        round(least(0.4::DOUBLE * k_dry + 0.3::DOUBLE * k_warm + 0.3::DOUBLE * (k_warm * k_dry), 1.0::DOUBLE), 4) AS crop_stress_index FROM """
        + f"{p}_o",
    )
    cte(
        p, (f"{p}_h",),
        f"""SELECT *, CASE WHEN hotspot_score >= 40 THEN 'Critical' WHEN hotspot_score >= 20 THEN 'High' WHEN hotspot_score >= 10 THEN 'Moderate' ELSE 'Low' END AS hotspot_risk_band
        FROM (SELECT *, round(greatest(least(25.0::DOUBLE * drought_severity_score + 0.25::DOUBLE * heatwave_severity + 20.0::DOUBLE * water_stress_index
          + 15.0::DOUBLE * crop_stress_index + 0.15::DOUBLE * extreme_rainfall_severity, 100.0::DOUBLE), 0.0::DOUBLE), 2) AS hotspot_score,
          round(temperature_c, 2) AS predicted_temperature_c, round(rainfall_mm, 2) AS predicted_rainfall_mm FROM {p}_h)""",
    )
    return p


BASE_YEAR, TARGET_YEAR, RANK_MONTH = 2000, 2010, 6
state_ctes(
    "ev",
    f"""SELECT n.*, y AS year, {RANK_MONTH} AS month, 'baseline' AS scenario, 0.0::DOUBLE AS td, 0.0::DOUBLE AS rd, 0.0::DOUBLE AS sd,
    n.district_id * 10000 + y AS rid FROM near n CROSS JOIN (VALUES ({BASE_YEAR}), ({TARGET_YEAR})) v(y)""",
    ("near",), True,
)
SCENARIO_VALUES = (
    "(VALUES ('baseline', 0.0, 0.0, 0.0, 0), ('temperature_plus_1', 1.0, 0.0, 0.0, 1), ('temperature_plus_2', 2.0, 0.0, 0.0, 2), "
    "('rainfall_minus_10', 0.0, -10.0, 0.0, 3), ('rainfall_plus_10', 0.0, 10.0, 0.0, 4)) v(scenario, td, rd, sd, sid)"
)
state_ctes(
    "sc",
    f"""SELECT n.*, {BASE_YEAR} AS year, {RANK_MONTH} AS month, scenario, td::DOUBLE AS td, rd::DOUBLE AS rd, sd::DOUBLE AS sd,
    n.district_id * 10 + sid AS rid FROM near n CROSS JOIN {SCENARIO_VALUES}""",
    ("near",), False,
)
WATER_VALUES = (
    "(VALUES ('baseline', 0.0, 0.0, 0.0, 0.0, 0.0, 0), ('evaporation_plus_20', 0.0, 0.0, 0.0, 20.0, 0.0, 1), "
    "('runoff_plus_50', 0.0, 0.0, 0.0, 0.0, 50.0, 2), ('runoff_gone', 0.0, 0.0, 0.0, 0.0, -100.0, 3), "
    "('hot_and_dry', 2.0, -20.0, -10.0, 15.0, -30.0, 4)) v(scenario, td, rd, sd, ed, fd, sid)"
)
state_ctes(
    "sw",
    f"""SELECT n.*, {BASE_YEAR} AS year, {RANK_MONTH} AS month, scenario, td::DOUBLE AS td, rd::DOUBLE AS rd, sd::DOUBLE AS sd,
    ed::DOUBLE AS ed, fd::DOUBLE AS fd, n.district_id * 10 + sid AS rid FROM near n CROSS JOIN {WATER_VALUES}""",
    ("near",), False, True,
)
