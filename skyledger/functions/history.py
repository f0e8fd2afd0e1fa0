"""Windows over the rows of one entity in time order.

The panel has one row per (entity, period), so a group is as long as the
calendar, however many raw readings an entity has; :func:`by_entity` hashes the
panel once and every window below reuses that partitioning.

Lags and rolling frames move by rows, not by calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from skyledger.functions.exprs import ColumnLike, clip, col

ENTITY = "city"
TIME = "date"


def by_entity(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """One exchange that all entity windows after it share."""
    return df.repartition(F.col(entity))


def timeline(entity: str = ENTITY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(time)


def group(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def frame(n: int, lagged: bool = True, entity: str = ENTITY, time: str = TIME) -> WindowSpec:
    """The n rows before the current one, or the n rows ending with it."""
    w = timeline(entity, time)
    return w.rowsBetween(-n, -1) if lagged else w.rowsBetween(-(n - 1), 0)


def lag(c: ColumnLike, k: int = 1, **keys: str) -> Column:
    return F.lag(col(c), k).over(timeline(**keys))


def lead(c: ColumnLike, k: int = 1, **keys: str) -> Column:
    return F.lead(col(c), k).over(timeline(**keys))


def rolling(
    c: ColumnLike, n: int, agg: Callable[[Column], Column], min_count: int, lagged: bool = True, **keys: str
) -> Column:
    """Aggregate over a moving frame; NULL with fewer than ``min_count`` values."""
    c = col(c)
    w = frame(n, lagged, **keys)
    return F.when(F.count(c).over(w) >= min_count, agg(c).over(w))


def rolling_median(c: ColumnLike, n: int, min_count: int = 2, **keys: str) -> Column:
    return rolling(c, n, lambda x: F.percentile(x, 0.5), min_count, **keys)


def rolling_cv(c: ColumnLike, n: int, eps: float = 1e-6, **keys: str) -> Column:
    """Lagged coefficient of variation in [0, 10]; 0 where there is too little history."""
    std = rolling(c, n, F.stddev_samp, 2, **keys)
    mean = rolling(c, n, F.avg, 2, **keys)
    return F.coalesce(clip(F.try_divide(std, mean + F.lit(eps)), 0.0, 10.0), F.lit(0.0))


def change(c: ColumnLike, **keys: str) -> Column:
    """Difference to the previous row."""
    return col(c) - lag(c, 1, **keys)


def lagged_change(c: ColumnLike, **keys: str) -> Column:
    """Difference between the two rows before the current one."""
    return lag(c, 1, **keys) - lag(c, 2, **keys)


def add_streaks(df: DataFrame, conditions: Mapping[str, Column], entity: str = ENTITY, time: str = TIME) -> DataFrame:
    """Length of the run of true conditions that ends at each row.

    The run length is the row number minus the row number of the last false
    row, so all streaks share the timeline's ordering and need no extra sort.
    A condition that is NULL ends the run. Conditions may contain window
    functions over the same timeline.
    """
    w = timeline(entity, time)
    row = "__row"
    flagged = df.withColumns({f"__{name}": F.coalesce(cond, F.lit(False)) for name, cond in conditions.items()})
    numbered = flagged.withColumn(row, F.row_number().over(w))
    streaks = {
        name: (
            F.col(row)
            - F.coalesce(F.max(F.when(~F.col(f"__{name}"), F.col(row))).over(w), F.lit(0))
        )
        for name in conditions
    }
    return numbered.withColumns(streaks).drop(row, *[f"__{name}" for name in conditions])


def percentile_labels(
    score: ColumnLike,
    cuts: Sequence[float],
    labels: Sequence[str],
    closed: str,
    entity: str = ENTITY,
    until_year: int | None = None,
) -> Column:
    """Label against the entity's own percentiles (linear interpolation).

    ``closed="left"``: a value on an edge belongs to the class above it.
    ``closed="right"``: it belongs to the class below. With ``until_year`` the rows up to that year give the edges.
    """
    score = col(score)
    fitted = score if until_year is None else F.when(F.col("year") <= until_year, score)
    return labels_between(score, F.percentile(fitted, list(cuts)).over(group(entity)), labels, closed)


def labels_between(score: ColumnLike, edges: Column, labels: Sequence[str], closed: str) -> Column:
    """Label by the array ``edges``, as :func:`percentile_labels`; null without a score or without edges."""
    score = col(score)
    out = F.when(score.isNull() | edges.isNull(), F.lit(None))
    for i, label in enumerate(labels[:-1]):
        edge = edges.getItem(i)
        out = out.when((score < edge) if closed == "left" else (score <= edge), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def fill_both_ways(c: ColumnLike, entity: str = ENTITY, time: str = TIME) -> Column:
    """Missing values take the next known value, else the last known one."""
    c = col(c)
    w = timeline(entity, time)
    return F.coalesce(
        c,
        F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    )
