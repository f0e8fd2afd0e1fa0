"""Connected components of a link table, by label spreading with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b): the smallest node it reaches.

    Each round gives every node the smallest label among its neighbours and then the
    label of that label, so a path halves with each round. Labels and links stay
    distributed; each round is written to the shared folder. No links, no rows.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("at")).agg(F.min("near").alias("near"))
        low = labels.join(near, F.col("node") == F.col("at"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("low"))
        # The label's own label: follow one pointer.
        pointers = labels.select(F.col("node").alias("p_node"), F.col("component").alias("p_component"))
        after = low.join(pointers, F.col("low") == F.col("p_node"), "left").select("node", "old", F.least("low", F.coalesce("p_component", "low")).alias("component"))
        after = materialize(after, "labels")
        if not after.where("component < old").limit(1).count():
            return after.select("node", "component")
        labels = after.select("node", "component")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) as :func:`components` gives them, after more ``links`` (a, b).

    Only links between different parts are spread, so the work follows the new links
    and not those that made the parts.
    """
    part_a = parts.select(F.col("node").alias("node_a"), F.col("component").alias("part_a"))
    part_b = parts.select(F.col("node").alias("node_b"), F.col("component").alias("part_b"))
    placed = links.join(part_a, F.col("a") == F.col("node_a"), "left").join(part_b, F.col("b") == F.col("node_b"), "left")
    between = placed.select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")).where("a <> b").distinct()
    joined = components(materialize(between, "part-links")).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    moved = parts.join(joined, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))
    # Nodes that no link had before.
    new = joined.join(parts, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component"))
    return materialize(moved.union(new), "parts")
