"""Incremental jobs over files that keep arriving. With ``availableNow`` they stop when all files are read."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from skyledger.functions import exprs as X
from skyledger.session import scratch_path
from skyledger.sources.ingest import new_rows
from skyledger.streaming.store import batch_folder, compact, folders, read_versions

KEYS = ("district_id", "observation_date")
# Weeks start on Monday; the epoch was a Thursday.
WEEK_START = "4 days"


def read_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_trigger: int = 100
) -> DataFrame:
    """New Parquet files of a folder, a limited number per batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    return given or scratch_path(spark, f"stream-{name}")


def ingest_stream(observations: DataFrame, store: str, event_time: str = "ts", checkpoint: str | None = None) -> StreamingQuery:
    """Append the first observation of every (district, date) to the stored table, however late it comes.

    A row is a repeat if its key is stored already, by any run or import, or comes earlier in its batch;
    no other row is dropped. So there is no watermark and no state: the table itself is what is known. It is stored by
    day, and a batch reads only the days that it touches, two months ago or two years. Each batch writes
    to folders named by its checkpoint and number, so a batch that is run again replaces its own rows and no others.
    """
    spark = observations.sparkSession
    checkpoint = _checkpoint(spark, "ingest", checkpoint)
    run = _run_name(checkpoint)

    def append(batch: DataFrame, batch_id: int) -> None:
        own = {"run": run, "batch": str(batch_id)}
        batch.persist()
        try:
            # At most one value per calendar day.
            days = [_day_folder(r[0]) for r in batch.select(KEYS[1]).distinct().collect()]
            earlier = _stored(spark, store, days, f"/run={run}/batch={batch_id}/", batch)
            fresh = new_rows(batch, earlier, KEYS, [event_time, "id"])
            fresh = fresh.withColumns({"day": F.col(KEYS[1])} | {k: F.lit(v) for k, v in own.items()})
            writer = fresh.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("day", *own).parquet(store)
        finally:
            batch.unpersist()

    return (
        observations.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _day_folder(day: date | None) -> str:
    return f"day={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"


def _run_name(checkpoint: str) -> str:
    """The same name for every start from one checkpoint."""
    return hashlib.md5(checkpoint.encode()).hexdigest()


def _stored(spark: SparkSession, store: str, days: Sequence[str], own: str, like: DataFrame) -> DataFrame:
    """Stored rows of the day folders ``days`` and of imported files outside day folders, but for the batch ``own``."""
    names = [n for n in folders(spark, store) if n in days or not n.startswith("day=")]
    if not names:
        return like.limit(0)
    paths = [f"{store}/{n}" for n in names]
    stored = spark.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(*paths)
    return stored.filter(~F.col("_metadata.file_path").contains(own)).select(*like.columns)


def read_store(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """All rows of a table that :func:`ingest_stream` and imports wrote."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(store)


def trend_stream(
    observations: DataFrame, out: str, event_time: str = "ts", window: str = "7 days", checkpoint: str | None = None
) -> StreamingQuery:
    """Exact temperature sums and counts per district and week, of all weeks up to the newest row.

    Each batch writes the sums of its own rows. Sums of exact parts add up in any order, so
    :func:`trend_state` gives the same averages as one pass over all rows: the open weeks are there, and a
    row that comes late, by days or years, still counts in its week.
    """
    checkpoint = _checkpoint(observations.sparkSession, "trend", checkpoint)
    run = _run_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = [F.sum(part).alias(name) for name, part in zip(X.PARTS, X.exact_parts("temperature"))]
        weekly = batch.groupBy(F.window(event_time, window, window, WEEK_START), "district_id").agg(
            *sums, F.count("temperature").alias("n")
        )
        weekly = weekly.select(F.col("window.start").cast("date").alias("period"), "district_id", *X.PARTS, "n")
        weekly.write.mode("overwrite").parquet(batch_folder(out, run, batch_id))

    return (
        observations.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_sums(versions: DataFrame) -> DataFrame:
    """One line per district and period from the lines of several batches."""
    return versions.groupBy("period", "district_id").agg(*[F.sum(c).alias(c) for c in (*X.PARTS, "n")])


def trend_state(spark: SparkSession, out: str) -> DataFrame:
    """(district_id, period, average_temperature, n) over all runs and batches of :func:`trend_stream`."""
    sums = merge_sums(read_versions(spark, out))
    average = F.try_divide(X.exact_total(*X.PARTS), F.col("n").cast("double"))
    return sums.select("district_id", "period", average.alias("average_temperature"), "n")


def latest_stream(observations: DataFrame, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keep the newest observation of every district in a table, updated per batch.

    Each batch writes only the districts it touched, to a folder named by its
    checkpoint and number; :func:`latest_state` takes the newest observation, and
    :func:`compact_latest` merges the folders.
    """
    spark = observations.sparkSession
    checkpoint = _checkpoint(spark, "latest", checkpoint)
    run = _run_name(checkpoint)
    columns = [c for c in observations.columns if c != "district_id"]
    newest = observations.groupBy("district_id").agg(
        F.max_by(F.struct(*columns), F.struct("observation_date", "id")).alias("row")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("district_id", "row.*").write.mode("overwrite").parquet(batch_folder(out, run, batch_id))

    return (
        newest.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_rows(versions: DataFrame) -> DataFrame:
    """The newest observation of every district."""
    columns = [c for c in versions.columns if c != "district_id"]
    newest = F.max_by(F.struct(*columns), F.struct("observation_date", "id"))
    return versions.groupBy("district_id").agg(newest.alias("row")).select("district_id", "row.*")


def latest_state(spark: SparkSession, out: str) -> DataFrame:
    """Newest observation of every district over all runs and batches of :func:`latest_stream`."""
    return newest_rows(read_versions(spark, out))


def compact_latest(spark: SparkSession, out: str) -> int:
    """Keep one row per district of a table that :func:`latest_stream` writes."""
    return compact(spark, out, newest_rows)


def compact_trend(spark: SparkSession, out: str) -> int:
    """Keep one row per district and week of a table that :func:`trend_stream` writes."""
    return compact(spark, out, merge_sums)
