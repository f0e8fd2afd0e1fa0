"""Distribution, correlation and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import exprs as X
from skyledger.operators.baselines import global_stats
from skyledger.operators.ordering import exact_percentiles, value_ranks
from skyledger.session import materialize

# Lower bounds of the feature tiers (mandatory, useful) per feature set.
TIERS = {"rainfall": (0.3, 0.1), "drought": (0.5, 0.2), "extreme": (0.4, 0.2)}
# Upper bounds of the class-imbalance verdicts.
IMBALANCE_VERDICTS = ((2.0, "Mild"), (5.0, "Moderate"))
NEAR_ZERO_VARIANCE = 1e-6


def _lines(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row frame into one row per struct."""
    return df.select(F.explode(F.array(*structs)).alias("line")).select("line.*")


def class_distribution(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Rows and percentage per class; classes without rows stay with 0. One pass, one row per task shuffled."""
    counts = df.agg(
        F.count("*").alias("total"), *[F.count_if(F.col(column) == c).alias(f"n{i}") for i, c in enumerate(classes)]
    )
    return _lines(
        counts,
        [
            F.struct(
                F.lit(c).alias("category"),
                F.col(f"n{i}").alias("rows"),
                X.round_to(F.try_divide(F.lit(100.0) * F.col(f"n{i}"), F.col("total")), 1).alias("pct"),
            )
            for i, c in enumerate(classes)
        ],
    )


def class_balance(distribution: DataFrame) -> DataFrame:
    """Ratio of the largest to the smallest class, and a verdict."""
    ratio = distribution.agg((F.max("rows") / (F.min("rows") + F.lit(1))).alias("imbalance_ratio"))
    verdict = F
    for bound, label in IMBALANCE_VERDICTS:
        verdict = verdict.when(F.col("imbalance_ratio") < bound, F.lit(label))
    return ratio.withColumn("verdict", verdict.otherwise(F.lit("Severe")))


def corrected_skewness(c: str) -> Column:
    """Skewness corrected for bias, NULL for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - F.lit(1.0))) / (n - F.lit(2.0)))


def profile(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90)
) -> DataFrame:
    """Mean, deviation, skewness and exact percentiles, one row per column."""
    moments = df.agg(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                corrected_skewness(c).alias("skew"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    lines = _lines(moments, [F.col(f"s{i}") for i in range(len(columns))])
    wide = (
        exact_percentiles(df, columns, probabilities)
        .groupBy("name")
        .agg(
            *[
                F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(f"p{round(p * 100)}")
                for p in probabilities
            ]
        )
    )
    return lines.join(wide, "name", "left")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, one row per column."""
    base = df.agg(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.count(c).alias("count"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    quartiles = profile(df, columns, (0.25, 0.50, 0.75)).drop("skew")
    return _lines(base, [F.col(f"s{i}") for i in range(len(columns))]).join(quartiles, "name")


def mean_by(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns over the rows that have both (average ranks on ties).

    A column's ranks depend on which rows the other column leaves, and so only on the other column's pattern of
    gaps. Columns with the same pattern share it: each column is ranked once per pattern, once at all
    without gaps. Ranks return to their rows in one join for all columns; the products of all pairs are then
    summed inside the tasks (:func:`gram_sums`). So shuffles grow with the columns and not with the pairs.
    """
    columns = list(columns)
    number = {c: X.finite(F.col(c).cast("double")) for c in columns}
    rows = materialize(df.select(*[number[c].alias(f"c{i}") for i, c in enumerate(columns)], F.monotonically_increasing_id().alias("row")), "numbers")
    # Equal counts and equal sums of row hashes stand for equal patterns. One line reaches the driver.
    marks = rows.agg(
        *[F.struct(F.count_if(F.isnull(f"c{i}")), *[F.bit_xor(F.when(F.isnull(f"c{i}"), F.xxhash64(F.lit(k), "row"))) for k in (1, 2)]).alias(f"p{i}") for i in range(len(columns))]
    ).head()
    first: dict[tuple, int] = {}
    pattern = [first.setdefault(tuple(marks[i]), i) for i in range(len(columns))]
    # (column, the column whose gaps count), each once.
    whole = {i for i in set(pattern) if not marks[i][0]}
    wanted = sorted({(i, i if p in whole or p == pattern[i] else p) for i in range(len(columns)) for p in set(pattern)})
    at = {w: k for k, w in enumerate(wanted)}

    def place(i: int, other: int) -> int:
        p = pattern[other]
        return at[i, i if p in whole or p == pattern[i] else p]

    values = [F.when(F.col(f"c{p}").isNotNull(), F.col(f"c{i}")) for i, p in wanted]
    wide = rows.select("row", *[v.alias(f"r{k}") for k, v in enumerate(values)])
    names = [f"r{k}" for k in range(len(wanted))]
    ranks = value_ranks(wide, names).select(
        F.substring("name", 2, 9).cast("int").alias("k"), "value", (F.col("below") + (F.col("n") - F.col("total")) / F.lit(2.0)).alias("centred")
    )
    ranks = materialize(ranks, "ranks")
    points = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(n).alias("value")) for k, n in enumerate(names)]))
    long = wide.select("row", points.alias("p")).select("row", "p.*").filter("value IS NOT NULL")
    entry = F.struct("k", "centred")
    ranked = long.join(ranks, ["k", "value"]).groupBy("row").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    vectors = ranked.select(*[F.try_element_at("m", F.lit(k)).alias(f"r{k}") for k in range(len(wanted))])
    pairs = {(place(i, j), place(j, i)): (i, j) for i, j in combinations(range(len(columns)), 2)}
    diagonal = [(k, k) for k in range(len(wanted))]
    sums = materialize(gram_sums(vectors, names, [*dict.fromkeys([*pairs, *diagonal])]), "rank-products")
    square = sums.filter("i = j").select(F.col("i").alias("own"), F.col("xy").alias("square"))
    named = df.sparkSession.createDataFrame(
        [(columns[i], columns[j], a, b) for i, j in combinations(range(len(columns)), 2) for a, b in [(place(i, j), place(j, i))]],
        "left string, right string, a int, b int",
    )
    out = (
        named.join(sums.select(F.col("i").alias("a"), F.col("j").alias("b"), "xy"), ["a", "b"], "left")
        .join(square.select(F.col("own").alias("a"), F.col("square").alias("xx")), "a", "left")
        .join(square.select(F.col("own").alias("b"), F.col("square").alias("yy")), "b", "left")
    )
    value = F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    return out.select("left", "right", value.alias("spearman"))


BLOCK_COLUMNS = 64  # columns multiplied at a time


def gram_sums(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) for each of ``pairs`` of column numbers, over the rows that have both values.

    Each task multiplies blocks of columns of its Arrow batches and sends one line per pair, so the shuffle has
    tasks x pairs lines, however many rows there are, and the plan does not grow with the pairs.
    """
    import numpy as np
    import pyarrow as pa

    schema = "i int, j int, n double, x double, y double, xx double, yy double, xy double"
    width, order = len(columns), list(pairs)
    left, right = (np.array([p[k] for p in order], np.int64) for k in (0, 1))

    def run(batches):
        starts = range(0, width, BLOCK_COLUMNS)
        sums = {(a, b): None for a in starts for b in starts}
        for batch in batches:
            table = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(width)]) if width else np.empty((0, 0))
            there = ~np.isnan(table)
            values, there = np.where(there, table, 0.0), there.astype(float)
            for a, b in sums:
                x, y, mx, my = values[:, a : a + BLOCK_COLUMNS], values[:, b : b + BLOCK_COLUMNS], there[:, a : a + BLOCK_COLUMNS], there[:, b : b + BLOCK_COLUMNS]
                part = np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])
                sums[a, b] = part if sums[a, b] is None else sums[a, b] + part
        if any(part is None for part in sums.values()):
            return
        out = np.zeros((6, len(order)))
        for (a, b), part in sums.items():
            inside = (left // BLOCK_COLUMNS * BLOCK_COLUMNS == a) & (right // BLOCK_COLUMNS * BLOCK_COLUMNS == b)
            out[:, inside] = part[:, left[inside] - a, right[inside] - b]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), *map(pa.array, out)], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    parts = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def feature_quality(df: DataFrame, features: Sequence[str], target: str, tiers: tuple[float, float]) -> DataFrame:
    """Absolute correlation with the target, variance and tier of every feature, in one pass."""
    strong, useful = tiers
    wide = df.agg(
        *[F.abs(F.corr(f, target)).alias(f"c{i}") for i, f in enumerate(features)],
        *[F.var_samp(f).alias(f"v{i}") for i, f in enumerate(features)],
    )
    lines = _lines(
        wide,
        [
            F.struct(F.lit(f).alias("feature"), X.finite(f"c{i}").alias("abs_corr"), F.col(f"v{i}").alias("variance"))
            for i, f in enumerate(features)
        ],
    )
    return lines.withColumn(
        "tier", X.bands("abs_corr", [(strong, "mandatory"), (useful, "useful")], "experimental")
    )


def collinear_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Feature pairs with absolute correlation above the threshold.

    Each pair uses the rows that have both values. The features are shifted by their means first, so sums of
    squares lose no digits; then one pass sums the products of all pairs inside the tasks.
    """
    features = list(features)
    number = [X.finite(F.col(f).cast("double")) for f in features]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(number)]).head()
    shifted = df.select(*[(c - F.lit(means[i] or 0.0)).alias(f"x{i}") for i, c in enumerate(number)])
    sums = gram_sums(shifted, shifted.columns, list(combinations(range(len(features)), 2)))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    spread = F.sqrt(F.greatest(F.col("xx") - x * x / n, F.lit(0.0))) * F.sqrt(F.greatest(F.col("yy") - y * y / n, F.lit(0.0)))
    lines = sums.filter("n > 0").withColumn("abs_corr", F.abs(F.try_divide(F.col("xy") - x * y / n, spread)))
    names = F.array(*[F.lit(f) for f in features])
    lines = lines.select(names[F.col("i")].alias("left"), names[F.col("j")].alias("right"), "abs_corr")
    return lines.filter(F.col("abs_corr") > threshold)


def data_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and infinite values, variance and a near-constant flag, one row per column."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def line(c: str) -> Column:
        value = F.col(c)
        clean = X.finite(c) if c in numeric else value.cast("double")
        infinite = F.count_if(F.abs(value) == float("inf")) if c in numeric else F.lit(0).cast("long")
        return F.struct(
            F.lit(c).alias("name"),
            F.count_if((value.isNull() | F.isnan(value)) if c in numeric else value.isNull()).alias("missing"),
            infinite.alias("infinite"),
            F.var_samp(clean).alias("variance"),
        )

    wide = df.agg(*[line(c).alias(f"s{i}") for i, c in enumerate(columns)])
    return _lines(wide, [F.col(f"s{i}") for i in range(len(columns))]).withColumn(
        "near_constant", F.coalesce(F.col("variance") < NEAR_ZERO_VARIANCE, F.lit(False))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row. Copies collapse before the shuffle."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def iqr_outliers(df: DataFrame, column: str, width: float = 3.0) -> DataFrame:
    """Upper fence ``q3 + width * (q3 - q1)`` and the rows above it."""
    q = global_stats(exact_percentiles(df, [column], (0.25, 0.75)), {"q1": F.min("value"), "q3": F.max("value")})
    fence = q["q3"] + F.lit(width) * (q["q3"] - q["q1"])
    counts = df.agg(F.count_if(F.col(column) > fence).alias("outliers"), F.count("*").alias("n"))
    return counts.select(
        fence.alias("fence"), "outliers", (F.lit(100.0) * F.col("outliers") / F.col("n")).alias("pct")
    )


def coverage(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Places, zones, period and range of the measures."""
    return df.agg(
        F.count("*").alias("rows"),
        F.countDistinct("city").alias("cities"),
        F.countDistinct("climate_zone").alias("zones"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *[f(m).alias(f"{n}_{m}") for m in measures for n, f in (("min", F.min), ("max", F.max))],
    )


def rows_per_zone(df: DataFrame) -> DataFrame:
    return df.groupBy("climate_zone").agg(F.count("*").alias("rows"))


def first_coordinates(df: DataFrame) -> DataFrame:
    """The coordinates and zone of each city's first row."""
    first = F.min_by(F.struct("latitude", "longitude", "climate_zone"), F.col("date"))
    return df.groupBy("city").agg(first.alias("f")).select("city", "f.*")
