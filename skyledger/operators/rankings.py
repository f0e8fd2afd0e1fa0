"""District rankings over evaluated rows (output of ``scenario.evaluate_districts``).

Lists are top-n results with a total order: score, then district id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import exprs as X
from skyledger.operators.ordering import positions

SCORE = "hotspot_score"


def top_lists(df: DataFrame, lists: Mapping[str, tuple[Column, Column | None]], n: int) -> DataFrame:
    """The first n rows of several lists, with list name and place.

    A list is its sort key, smallest first, and the rows that take part (all without a condition). Rows
    are turned into (list, key) once; every task keeps its own first n of each list, so one exchange moves
    at most n rows for each list and task, however many lists there are.
    """
    entry = lambda name, key: F.struct(F.lit(name).alias("list_name"), key.cast("double").alias("by"))
    entries = [entry(name, key) if rows is None else F.when(rows, entry(name, key)) for name, (key, rows) in lists.items()]
    long = df.withColumn("__list", F.explode(F.array(*entries))).filter(F.col("__list").isNotNull())
    first = Window.partitionBy("list_name").orderBy("__by", "district_id")
    named = long.withColumns({"list_name": F.col("__list.list_name"), "__by": F.col("__list.by")}).drop("__list")
    return named.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n).drop("__by")


def one(evaluated: DataFrame, year: int, scenario: str = "baseline") -> DataFrame:
    return evaluated.filter((F.col("year") == year) & (F.col("scenario") == scenario))


def hotspot_ranking(evaluated: DataFrame, year: int, top_n: int = 5, scenario: str = "baseline") -> DataFrame:
    """Most and least vulnerable districts of a year under a scenario."""
    score = F.col(SCORE)
    return top_lists(
        one(evaluated, year, scenario), {"top_vulnerable": (-score, None), "least_vulnerable": (score, None)}, top_n
    )


def hotspots(evaluated: DataFrame, year: int, top_n: int = 10) -> DataFrame:
    """Highest scores among the Critical and High bands, and among the Moderate band."""
    df, band = one(evaluated, year), F.col("hotspot_risk_band")
    worst = -F.col(SCORE)
    return top_lists(
        df,
        {"vulnerable_hotspots": (worst, band.isin("Critical", "High")), "emerging_hotspots": (worst, band == "Moderate")},
        top_n,
    )


def _two_years(df: DataFrame, base: int, target: int, columns: Sequence[str]) -> DataFrame:
    """One row per district present in both years: ``base_x`` and ``target_x`` for every column.

    One aggregation by district; both years of a district travel together.
    """
    def at(year: int) -> Column:
        return F.max(F.when(F.col("year") == year, F.struct(*columns)))

    both = df.filter(F.col("year").isin(base, target)).groupBy("district_id").agg(
        at(base).alias("b"), at(target).alias("t")
    )
    return both.filter(F.col("b").isNotNull() & F.col("t").isNotNull()).select(
        "district_id",
        *[F.col(f"b.{c}").alias(f"base_{c}") for c in columns],
        *[F.col(f"t.{c}").alias(f"target_{c}") for c in columns],
    )


def ranked(evaluated: DataFrame, years: Sequence[int], scenario: str = "baseline") -> DataFrame:
    """Position of every district per year, the highest score first."""
    df = evaluated.filter(F.col("year").isin(*years) & (F.col("scenario") == scenario))
    df = df.select("district_id", "district_name", "state", "year", SCORE)
    return positions(df, ["year"], [F.desc(SCORE), F.asc("district_id")], "rank")


def movements(evaluated: DataFrame, base: int, target: int) -> DataFrame:
    """Rank in both years and the change; positive means the district moved up in risk."""
    df = _two_years(ranked(evaluated, (base, target)), base, target, ["rank", "district_name", "state", SCORE])
    return df.select(
        "district_id",
        F.col("target_district_name").alias("district_name"),
        F.col("target_state").alias("state"),
        F.col(f"target_{SCORE}").alias(SCORE),
        "base_rank",
        "target_rank",
        (F.col("base_rank") - F.col("target_rank")).alias("rank_change"),
    )


def rank_movement(evaluated: DataFrame, base: int, target: int, top_n: int = 10) -> DataFrame:
    """Largest climbs and largest falls. Equal changes are ordered by target rank."""
    df = movements(evaluated, base, target)
    change = F.col("rank_change")
    return top_lists(df, {"most_worsened": (-change, None), "most_improved": (change, None)}, top_n)


def _years_between(base: int, target: int) -> Column:
    return F.lit(float(target - base if target != base else 1))


def trend_records(evaluated: DataFrame, base: int, final: int) -> DataFrame:
    """Change per district between the first and the last year."""
    measures = [
        "predicted_temperature_c", "drought_severity_score", "water_stress_index", "heatwave_severity", SCORE,
    ]
    df = _two_years(evaluated.filter(F.col("scenario") == "baseline"), base, final, measures + ["district_name", "state"])
    years = _years_between(base, final)

    def change(c: str) -> Column:
        return F.col(f"target_{c}") - F.col(f"base_{c}")

    return df.select(
        "district_id",
        F.col("target_district_name").alias("district_name"),
        F.col("target_state").alias("state"),
        X.round_to(change("predicted_temperature_c") / years, 4).alias("warming_rate_per_year"),
        X.round_to(change("drought_severity_score"), 4).alias("drought_severity_delta"),
        X.round_to(change("water_stress_index"), 4).alias("water_stress_delta"),
        X.round_to(change("heatwave_severity"), 4).alias("heatwave_severity_delta"),
        X.round_to(change(SCORE) / years, 4).alias("hotspot_emergence_rate"),
    )


TREND_LISTS = {
    "fastest_warming": "warming_rate_per_year",
    "fastest_drought_growth": "drought_severity_delta",
    "fastest_water_stress_growth": "water_stress_delta",
    "fastest_heatwave_growth": "heatwave_severity_delta",
}


def trends(evaluated: DataFrame, base: int, final: int, top_n: int = 10) -> DataFrame:
    """Four lists of the fastest changing districts."""
    df = trend_records(evaluated, base, final)
    return top_lists(df, {name: (-F.col(c), None) for name, c in TREND_LISTS.items()}, top_n)


def emerging(evaluated: DataFrame, base: int, target: int, top_n: int = 10) -> DataFrame:
    """Districts whose hotspot score grows fastest; every band takes part."""
    df = _two_years(
        evaluated.filter(F.col("scenario") == "baseline"), base, target,
        [SCORE, "hotspot_risk_band", "district_name", "state"],
    )
    growth = (F.col(f"target_{SCORE}") - F.col(f"base_{SCORE}")) / _years_between(base, target)
    df = df.select(
        "district_id",
        F.col("target_district_name").alias("district_name"),
        F.col("target_state").alias("state"),
        F.col(f"target_{SCORE}").alias(SCORE),
        F.col(f"base_{SCORE}").alias("base_hotspot_score"),
        F.col("base_hotspot_risk_band").alias("base_risk_band"),
        X.round_to(growth, 4).alias("growth_rate_per_year"),
    )
    return top_lists(df, {"emerging_risks": (-F.col("growth_rate_per_year"), None)}, top_n)


def district_profile(evaluated: DataFrame, name: str, state: str = "") -> DataFrame:
    """Evaluated rows of the first district (lowest id) whose name contains ``name``."""
    df = evaluated.filter(X.contains_ignoring_case("district_name", name))
    if state:
        df = df.filter(X.contains_ignoring_case("state", state))
    lowest = df.agg(F.min("district_id")).scalar()
    return df.withColumn("__first", lowest).filter(F.col("district_id") == F.col("__first")).drop("__first")


def compare_districts(evaluated: DataFrame, first: str, second: str) -> DataFrame:
    """Profiles of two districts side by side, as rows labelled a and b."""
    return district_profile(evaluated, first).withColumn("side", F.lit("a")).unionByName(
        district_profile(evaluated, second).withColumn("side", F.lit("b"))
    )
