"""Row and column cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from skyledger.functions.exprs import finite_columns


def complete_rows(df: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN and infinities into NULL, then keep the rows where ``required`` (default: all) is present."""
    return finite_columns(df).na.drop(subset=list(required) if required else None)


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by ``order``.

    ``min_by`` combines on the map side, so a hot key never travels whole.
    """
    named = {f"__k{i}": (F.col(k) if isinstance(k, str) else k) for i, k in enumerate(keys)}
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order))
    return (
        df.withColumns(named).groupBy(*named).agg(first.alias("__row")).select("__row.*")
    )


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the last by ``order``."""
    last = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("__row")).select("__row.*")


def drop_leakage(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def suspicious_columns(df: DataFrame, patterns: Sequence[str] = ("target_", "next_month", "future", "risk")) -> list[str]:
    """Column names that look like a look-ahead or a derived label."""
    return [c for c in df.columns if any(p in c.lower() for p in patterns)]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def impute_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values take the column mean."""
    columns = list(columns)
    return Imputer(inputCols=columns, outputCols=columns, strategy="mean").fit(df).transform(df)


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(columns))


def unexpected_classes(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Distinct class values outside the expected list; empty when the target is sound."""
    return df.filter(~F.coalesce(F.col(column).isin(*classes), F.lit(False))).select(column).distinct()


def check_classes(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Fail when the target holds a value outside ``classes``."""
    bad = [r[0] for r in unexpected_classes(df, column, classes).limit(5).collect()]
    if bad:
        raise ValueError(f"{column} holds unexpected classes: {bad}")
    return df
