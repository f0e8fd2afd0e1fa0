"""Positions and percentiles over whole columns without putting a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import materialize

# A column is cut into value ranges of about this many distinct values, one task each.
VALUES_PER_RANGE = 1_000_000


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, n): how often each value occurs in each column, NULLs left out."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    return (
        df.select(pairs.alias("p"))
        .select("p.name", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count("*").alias("n"))
    )


def _with_range(counts: DataFrame, cuts: DataFrame, ranges: int) -> DataFrame:
    """Add the number of the value's range: how many cuts of its column are not above it.

    ``cuts`` has one line per column with a number for each VALUES_PER_RANGE distinct
    values; it is held in the plan as one scalar, 8 MB for a million million values.
    Cuts are searched in two steps: every n-th cut first, then the cuts in between,
    with n near the root of their number.
    """
    every = max(2, math.isqrt(ranges))
    coarse = F.filter("cuts", lambda c, i: i % every == every - 1)
    entry = F.struct("name", F.struct("cuts", coarse.alias("coarse")))
    by_name = cuts.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    skipped = _count_up_to(F.col("__cuts.coarse")) * every
    between = F.slice(F.col("__cuts.cuts"), F.col("__skipped") + 1, every - 1)
    return (
        counts.withColumn("__cuts", F.try_element_at(by_name, F.col("name")))
        .withColumn("__skipped", skipped)
        .withColumn("range", F.col("__skipped") + _count_up_to(between))
        .drop("__cuts", "__skipped")
    )


def _count_up_to(cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= F.col("value")))


def value_ranks(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """(name, value, n, below, total): rows per value and rows with a smaller value.

    Equal values collapse before the first shuffle, so a value that fills a
    third of a column is one line. Each column is then cut into value ranges by
    one quantile sketch; a running count inside a range plus the totals of the
    ranges before it give the exact position.
    """
    counts = materialize(value_counts(df, columns), "value-counts")
    if ranges is None:
        ranges = 1 + counts.count() // VALUES_PER_RANGE
    if ranges > 1:
        cuts = counts.groupBy("name").agg(
            F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts")
        )
        ranged = _with_range(counts, cuts, ranges)
    else:
        ranged = counts.withColumn("range", F.lit(0))
    ranged = materialize(ranged, "value-ranges") if ranges > 1 else ranged
    sizes = ranged.groupBy("name", "range").agg(F.sum("n").alias("size"))
    by_range = Window.partitionBy("name").orderBy("range")
    offsets = materialize(
        sizes.withColumns(
            {
                "before": F.sum("size").over(by_range) - F.col("size"),
                "total": F.sum("size").over(Window.partitionBy("name")),
            }
        ).drop("size"),
        "range-offsets",
    )
    inside = Window.partitionBy("name", "range").orderBy("value")
    return (
        ranged.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
        .join(offsets, ["name", "range"])
        .select("name", "value", "n", (F.col("before") + F.col("inside")).alias("below"), "total")
    )


def exact_percentiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(name, p, value): exact percentiles with linear interpolation."""
    ranks = value_ranks(df, columns)
    wanted = ranks.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))).withColumn(
        "pos", F.col("p") * (F.col("total") - F.lit(1))
    )
    low, high = F.floor("pos"), F.ceil("pos")
    first, last = F.col("below"), F.col("below") + F.col("n") - F.lit(1)
    hits = wanted.filter(((first <= low) & (low <= last)) | ((first <= high) & (high <= last)))
    share = F.first("pos") - F.floor(F.first("pos"))
    return hits.groupBy("name", "p").agg(
        (F.min("value") + (F.max("value") - F.min("value")) * share).alias("value")
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Number the rows of every key from 1 in the given order.

    The frame is range-sorted by (keys, order), so a key with many rows is
    spread over many tasks. Row numbers inside a sorted partition come from the
    partition itself; the first number of each partition and of each key come
    from small aggregates. The sorted frame is written once, so all three steps
    see the same partitions.
    """
    keys = list(keys)
    ordered = df.orderBy(*[F.col(k) for k in keys], *order).withColumn("__id", F.monotonically_increasing_id())
    stored = materialize(ordered, "sorted")
    split = {"__part": F.shiftright("__id", 33), "__in": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}
    stored = stored.withColumns(split)
    # One line per partition of the sort, however large the data is.
    parts = stored.groupBy("__part").agg(F.count("*").alias("__rows"))
    parts = materialize(
        parts.withColumn("__before", F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).drop("__rows"),
        "partition-offsets",
    )
    numbered = stored.join(F.broadcast(parts), "__part").withColumn("__pos", F.col("__before") + F.col("__in"))
    starts = materialize(numbered.groupBy(*keys).agg(F.min("__pos").alias("__start")), "key-starts")
    return (
        numbered.join(starts, keys)
        .withColumn(name, (F.col("__pos") - F.col("__start") + F.lit(1)).cast("long"))
        .drop("__id", "__part", "__in", "__before", "__pos", "__start")
    )
