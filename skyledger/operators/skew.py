"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import materialize

# A key with more rows than this counts as hot; there can be at most
# (total rows / HOT_ROWS) of them.
HOT_ROWS = 5_000_000


def attach_by_key(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], count_column: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join of ``rows`` to ``lookup``, which has one line per key and the key's number of rows.

    Lines of hot keys are stored, so the planner knows their bytes: below its broadcast
    threshold their rows are joined where they lie, beyond it by a shuffle whose skewed
    partitions are split. The other keys take an ordinary join. Every row is kept either
    way. ``count_column`` is dropped.
    """
    keys = list(keys)
    lookup = materialize(lookup, "lookup")
    hot = lookup.filter(F.col(count_column) > hot_rows)
    if hot.isEmpty():
        return rows.join(lookup.drop(count_column), keys, "left")
    cold = lookup.filter(F.col(count_column) <= hot_rows)
    hot = materialize(hot.drop(count_column), "hot-keys")
    on_hot = rows.join(hot, keys, "inner")
    on_cold = rows.join(hot.select(*keys), keys, "left_anti").join(cold.drop(count_column), keys, "left")
    return on_hot.unionByName(on_cold)
