"""Batch ingest: validation, keyed de-duplication, summaries, upsert and table sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import exprs as X
from skyledger.operators.skew import attach_by_key
from skyledger.session import materialize
from skyledger.streaming.store import replace_partitions

ACCEPTED, DUPLICATE, FAILED = "accepted", "duplicate", "failed"
KEY = ("district_id", "observation_date")
# Bits of a row number that count rows inside a partition, as in Spark's increasing ids.
ROW_BITS = 33
MEASURES = ("rainfall", "temperature", "humidity")


def number_rows(df: DataFrame) -> DataFrame:
    """An increasing ``row`` by file name, then place in the file; gaps are possible.

    Spark packs large files first, so the parts of the files are ranked by name
    and offset (one short row each); inside a part the reading order counts. Rows
    that come from no file are numbered in the order of their partitions.
    """
    marked = df.withColumns(
        {"__file": F.input_file_name(), "__start": F.input_file_block_start(), "__read": F.monotonically_increasing_id()}
    )
    parts = marked.filter("__file <> ''").select("__file", "__start").distinct()
    parts = materialize(parts.select("__file", "__start", F.rank().over(Window.orderBy("__file", "__start")).alias("__part")), "file-parts")
    placed = marked.join(parts, ["__file", "__start"], "left")
    row = F.when(F.col("__part").isNull(), F.col("__read")).otherwise(
        F.shiftleft(F.col("__part").cast("long"), ROW_BITS) + F.col("__read").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    )
    return placed.withColumn("row", row).select(*df.columns, "row")


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def validate(rows: DataFrame, districts: DataFrame, store: DataFrame, row: str = "row") -> DataFrame:
    """Classify text rows of an import as accepted, duplicate or failed.

    The first failing rule names the error: missing key, district not a number,
    unknown district, no date format fits, key already taken, a measure is not
    a number, humidity outside 0 to 100. A key is taken once it is stored or a
    valid row with it came before; a measure column that is absent counts as 0.

    ``districts`` has district_id; ``store`` has district_id and
    observation_date. Output: the input columns, the parsed values, ``status``
    and ``error``.
    """
    parsed = rows.withColumns(
        {
            "__district": F.trim("district_id").try_cast("long"),
            "__date": X.parse_date("observation_date"),
            **{
                f"__{m}": F.trim(m).try_cast("double") if m in rows.columns else F.lit(0.0)
                for m in MEASURES
            },
        }
    )
    measure_error = F.coalesce(
        *[F.when(F.col(f"__{m}").isNull(), F.lit(f"{m} is not a number")) for m in MEASURES],
        F.when(~F.col("__humidity").between(0.0, 100.0), F.lit("humidity out of range")),
    )
    # Rows without a readable district or date share one stand-in key each.
    checked = parsed.withColumns(
        {
            "__measure_error": measure_error,
            "__id": F.coalesce("__district", F.lit(-1)),
            "__day": F.coalesce("__date", F.lit(date(1000, 1, 1))),
        }
    )

    # What is known about a key: its first valid row, whether the district exists
    # and whether the key is stored. Rows are combined per key on the map side, so
    # the joins below see one line per key however many rows it has.
    sound = F.col("__measure_error").isNull()
    per_key = checked.groupBy("__id", "__day").agg(
        F.min(F.when(sound, F.col(row))).alias("__first"), F.count("*").alias("__rows")
    )
    known = districts.select(F.col("district_id").alias("__id"), F.lit(True).alias("__known")).distinct()
    stored = store.select(
        F.col("district_id").alias("__id"), F.col("observation_date").alias("__day"), F.lit(True).alias("__stored")
    ).distinct()
    per_key = per_key.join(known, "__id", "left").join(stored, ["__id", "__day"], "left")
    df = attach_by_key(checked, per_key, ["__id", "__day"], "__rows")

    key_error = F.coalesce(
        F.when(~(_present("district_id") & _present("observation_date")), F.lit("missing key")),
        F.when(F.col("__district").isNull(), F.lit("district is not a number")),
        F.when(F.col("__known").isNull(), F.lit("unknown district")),
        F.when(F.col("__date").isNull(), F.lit("invalid date")),
    )
    df = df.withColumn("__key_error", key_error)
    sound = F.col("__key_error").isNull()
    repeat = sound & (F.coalesce(F.col("__stored"), F.lit(False)) | F.coalesce(F.col(row) > F.col("__first"), F.lit(False)))
    error = F.coalesce(F.col("__key_error"), F.when(~repeat, F.col("__measure_error")))
    status = F.when(repeat, F.lit(DUPLICATE)).when(error.isNull(), F.lit(ACCEPTED)).otherwise(F.lit(FAILED))
    keep = status == ACCEPTED
    return df.select(
        *[F.col(c) for c in rows.columns],
        status.alias("status"),
        error.alias("error"),
        F.when(keep, F.struct(
            F.col("__district").alias("district_id"), F.col("__date").alias("observation_date"),
            *[F.col(f"__{m}").alias(m) for m in MEASURES],
        )).alias("parsed"),
    )


def accepted_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("status") == ACCEPTED).select("parsed.*")


def quarantine(validated: DataFrame, row: str = "row") -> DataFrame:
    """Rejected rows with their number, error and raw content."""
    raw = [c for c in validated.columns if c not in ("status", "error", "parsed", row)]
    return validated.filter(F.col("status") == FAILED).select(
        F.col(row), "error", F.to_json(F.struct(*raw)).alias("raw_data")
    )


def import_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count("*").alias("processed_rows"),
        F.count_if(F.col("status") == ACCEPTED).alias("success_count"),
        F.count_if(F.col("status") == DUPLICATE).alias("duplicate_skipped"),
        F.count_if(F.col("status") == FAILED).alias("failed_count"),
    )


def new_rows(batch: DataFrame, store: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key that is not stored yet; a null in a key equals a null."""
    first = F.min_by(F.struct(*batch.columns), F.struct(*order))
    firsts = batch.groupBy(*keys).agg(first.alias("r")).select("r.*")
    known = store.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return firsts.join(known, reduce(and_, same), "left_anti")


def ingest_summary(rows: DataFrame, store: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Processed, inserted and skipped rows per district, and a total line (district NULL).

    ``failures`` (district_id, failed_days, error), as :func:`readers.failed_payloads` gives them, add the
    columns failed_payloads, failed_days and errors (the distinct ones, sorted); a district whose payloads all failed has a
    line too.
    """
    keyed = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    stored = store.select(*KEY, F.lit(True).alias("stored")).distinct()
    fresh = F.when(F.col("stored").isNull(), F.lit(1)).otherwise(F.lit(0))
    counts = keyed.join(stored, list(KEY), "left").select(
        "district_id", "n", fresh.alias("inserted"), (F.col("n") - fresh).alias("skipped")
    )
    sums = {"observations_processed": "n", "observations_inserted": "inserted", "duplicates_skipped": "skipped"}
    if failures is None:
        return counts.rollup("district_id").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    # Rows are summed per district, payloads per district and error, before the errors are collected: collecting sorts
    # whatever rows it gets in memory, now a few a district.
    none = F.lit(0).cast("long")
    counts = counts.groupBy("district_id").agg(*[F.sum(c).alias(c) for c in sums.values()])
    failures = failures.groupBy("district_id", "error").agg(F.count("*").alias("payload"), F.sum("failed_days").alias("failed_days"))
    both = counts.withColumns({"payload": none, "failed_days": none, "error": F.lit(None).cast("string")}).unionByName(
        failures.select(
            "district_id", none.alias("n"), none.alias("inserted"), none.alias("skipped"), "payload", "failed_days", "error",
        )
    )
    sums |= {"failed_payloads": "payload", "failed_days": "failed_days"}
    return both.rollup("district_id").agg(
        *[F.sum(c).alias(name) for name, c in sums.items()], F.array_sort(F.collect_set("error")).alias("errors")
    )


def upsert(new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New values replace stored ones with the same key; of several new rows the last by ``order`` counts."""
    values = [c for c in existing.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("new"))
    old = existing.select(*keys, F.struct(*values).alias("old"))
    merged = last.join(old, list(keys), "full")
    return merged.select(
        *keys, *[F.when(F.col("new").isNotNull(), F.col(f"new.{v}")).otherwise(F.col(f"old.{v}")).alias(v) for v in values]
    )


def upsert_table(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], by: str) -> list[str]:
    """:func:`upsert` into the table below ``path``, stored by the key column ``by``.

    Only the partitions that hold keys of ``new`` are read and rewritten; returns their folders.
    """
    if by not in keys:
        raise ValueError(f"{by} is no key: a row could move to another partition")
    columns = [c for c in new.columns if c not in order or c in keys]

    def merge(rows: DataFrame, stored: DataFrame) -> DataFrame:
        return upsert(rows, stored.select(*columns), keys, order)

    return replace_partitions(new, path, merge, by)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",), mode: str = "overwrite") -> None:
    """Parquet, one folder per partition value; only the partitions present in ``df`` are replaced."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_text(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with header, or JSON lines."""
    (df.write.option("header", True).csv(path) if fmt == "csv" else df.write.json(path))
