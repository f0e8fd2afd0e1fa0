"""What-if results as nested records: built from compared scenarios, stored by run, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import serving as V

# Fields of a state inside a record.
STATE_FIELDS = (
    "temperature", "rainfall", "drought_category", "drought_score", "heatwave_category", "heatwave_severity",
    "extreme_rainfall_category", "extreme_rainfall_severity", "overall_risk_score", "overall_risk_category",
)


def simulation_records(compared: DataFrame, counts: DataFrame) -> DataFrame:
    """One record per district and scenario: the changes asked for and the struct ``result``.

    ``compared`` is the output of :func:`scenario.compare_scenarios`; ``counts`` has district_id and
    observation_count, and a district without a line there counts 0. The struct holds both states with their humidity, the
    changes of risk, drought and confidence, and the groups baseline, projections and impacts.
    """
    seen = counts.select("district_id", F.col("observation_count").alias("__n"))
    df = compared.join(seen, "district_id", "left")

    def state(side: str) -> Column:
        fields = [F.col(f"{side}_state.{f}").alias(f) for f in STATE_FIELDS]
        return F.struct(*fields, F.col(f"{side}_humidity").alias("humidity")).alias(f"{side}_state")

    def measures(side: str) -> list[Column]:
        return [F.col(f"{side}_state.{m}").alias(m) for m in ("temperature", "rainfall")] + [
            F.col(f"{side}_humidity").alias("humidity")
        ]

    count = F.coalesce("__n", F.lit(0)).cast("long").alias("observation_count")
    impacts = F.struct(
        F.col("scenario_state.drought_category").alias("drought_risk"),
        F.col("scenario_state.extreme_rainfall_category").alias("flood_risk"),
        "comfort_index",
    )
    result = F.struct(
        state("baseline"), state("scenario"), "risk_change", "drought_change", "confidence_change",
        F.struct(*measures("baseline"), count).alias("baseline"),
        F.struct(*measures("scenario")).alias("projections"),
        impacts.alias("impacts"),
    )
    return df.select("district_id", "scenario", *V.DELTAS, result.alias("result"))


def store_simulations(records: DataFrame, path: str, run: str) -> None:
    """Write the records of a run below ``path``; a run that is stored again replaces its own records only."""
    if not run or "/" in run:
        raise ValueError("a run needs a name without a slash")
    records.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{path}/stored={run}")


def read_simulations(spark: SparkSession, path: str) -> DataFrame:
    """All stored records with the text column ``run``."""
    return spark.read.parquet(path).drop("stored")


def latest_simulations(stored: DataFrame) -> DataFrame:
    """The record of the last run (by name) of each district and scenario."""
    rest = [c for c in stored.columns if c not in ("district_id", "scenario")]
    last = F.max_by(F.struct(*rest), F.col("run")).alias("last")
    return stored.groupBy("district_id", "scenario").agg(last).select("district_id", "scenario", "last.*")


def with_json(records: DataFrame) -> DataFrame:
    """The struct ``result`` as JSON text, for sinks without nested types."""
    return records.withColumn("result_json", F.to_json("result")).drop("result")
