"""Nearest place and nearest grid line without comparing everything with everything."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.skew import attach_by_key
from skyledger.session import materialize

# Up to this many places are held in the plan as one array; both ways give the same places.
SMALL = 1024
# Cell widths in degrees; wider ones are put in front where the places spread further.
# Powers of two, so that cell borders nest exactly.
WIDTHS = (64.0, 16.0, 4.0, 1.0, 1 / 4, 1 / 16, 1 / 64, 1 / 256)
# Places spread over at most this many cells of the coarsest width, each way.
TOP_CELLS = 6

Prefer = Callable[[Column, Column], list[Column]]


def _square(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def nearest_place(
    points: DataFrame,
    places: DataFrame,
    place: str = "city",
    point_xy: tuple[str, str] = ("latitude", "longitude"),
    place_xy: tuple[str, str] = ("latitude", "longitude"),
    out: str = "nearest",
    prefer: Prefer = lambda x, y: [],
    small: int = SMALL,
) -> DataFrame:
    """Add the place with the smallest Euclidean distance in degrees.

    Places at equal distance are ranked by ``prefer`` of their coordinates,
    then by name. Points and places are reduced to distinct coordinates first.
    """
    px, py = point_xy
    index = places.select(
        F.col(place_xy[0]).cast("double").alias("px"),
        F.col(place_xy[1]).cast("double").alias("py"),
        F.col(place).alias("name"),
    )
    index = materialize(index.na.drop().groupBy("px", "py").agg(F.min("name").alias("name")), "places")
    named = points.withColumns({"__x": F.col(px).cast("double"), "__y": F.col(py).cast("double")})
    spots = named.select("__x", "__y").na.drop().groupBy("__x", "__y").agg(F.count("*").alias("__n"))
    if index.limit(small + 1).count() <= small:
        best = _by_array(spots, index, prefer)
    else:
        best = _by_cells(spots, index, prefer)
    lookup = best.select("__x", "__y", F.col("name").alias(out), "__n")
    return attach_by_key(named, lookup, ["__x", "__y"], "__n").drop("__x", "__y")


def _by_array(spots: DataFrame, index: DataFrame, prefer: Prefer) -> DataFrame:
    """Few places: one array in the plan, scanned for every distinct point."""
    array = index.agg(F.collect_list(F.struct("px", "py", "name"))).scalar()

    def rank(s: Column) -> Column:
        distance = _square(s["px"] - F.col("__x"), s["py"] - F.col("__y"))
        extra = [c.alias(f"t{i}") for i, c in enumerate(prefer(s["px"], s["py"]))]
        return F.struct(distance.alias("d"), *extra, s["name"].alias("name"))

    return spots.withColumn("all", array).select(
        "__x", "__y", "__n", F.array_min(F.transform("all", rank))["name"].alias("name")
    )


def _by_cells(spots: DataFrame, index: DataFrame, prefer: Prefer) -> DataFrame:
    """Many places: walk down square cells, each a quarter as wide as the one before.

    A point starts with the few coarsest cells and, level by level, moves to
    the child cells that can still hold its nearest place: those whose closest
    border is not farther than the best sample place seen. Every step is an
    equi-join on the cell and a point keeps a few dozen candidates at most, so
    the work grows with points plus places.
    """
    finest = WIDTHS[-1]

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(finest)).cast("long")

    placed = index.withColumns({"cx": cell("px"), "cy": cell("py")})
    cells = materialize(placed.groupBy("cx", "cy").agg(F.min(F.struct("px", "py")).alias("s")), "cells")

    def level(width: float) -> DataFrame:
        step = F.lit(round(width / finest))
        coarse = [F.floor(F.col(c) / step).cast("long").alias(c) for c in ("cx", "cy")]
        return cells.groupBy(*coarse).agg(F.min("s").alias("s"))

    span = cells.agg(F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"))).head()[0] * finest
    widths = list(WIDTHS)
    while span > TOP_CELLS * widths[0]:
        widths.insert(0, 4 * widths[0])
    # At most (TOP_CELLS + 2) squared cells of the coarsest width, in whatever unit the axes are.
    top = level(widths[0]).agg(F.collect_list(F.struct("cx", "cy", "s"))).scalar()
    front = spots.select("__x", "__y", F.explode(top).alias("c")).select("__x", "__y", "c.*")
    front = _prune(front, widths[0])
    for width, wider in zip(widths[1:], widths):
        step = F.lit(round(wider / width))
        parents = [F.floor(F.col(c) / step).cast("long").alias(u) for c, u in (("cx", "ux"), ("cy", "uy"))]
        children = level(width).select(*parents, "cx", "cy", "s")
        front = front.select("__x", "__y", F.col("cx").alias("ux"), F.col("cy").alias("uy"))
        front = _prune(front.join(children, ["ux", "uy"]).drop("ux", "uy"), width)
    hits = front.drop("s").join(placed, ["cx", "cy"])
    distance = _square(F.col("px") - F.col("__x"), F.col("py") - F.col("__y"))
    order = F.struct(distance, *prefer(F.col("px"), F.col("py")), F.col("name"))
    return hits.groupBy("__x", "__y").agg(F.min_by("name", order).alias("name")).join(spots, ["__x", "__y"])


def _prune(front: DataFrame, width: float) -> DataFrame:
    """Keep the cells of each point that can still hold its nearest place."""

    def outside(x: str, c: str) -> Column:
        low = F.col(c) * F.lit(width)
        return F.greatest(low - F.col(x), F.col(x) - (low + F.lit(width)), F.lit(0.0))

    near = _square(outside("__x", "cx"), outside("__y", "cy"))
    reach = _square(F.col("s.px") - F.col("__x"), F.col("s.py") - F.col("__y"))
    # One line per point holds its candidates: the children of a few dozen cells.
    kept = front.withColumns({"near": near, "reach": reach}).groupBy("__x", "__y").agg(
        F.min("reach").alias("best"), F.collect_list(F.struct("near", "cx", "cy", "s")).alias("all")
    )
    alive = F.filter("all", lambda c: c["near"] <= F.col("best"))
    return kept.select("__x", "__y", F.explode(alive).alias("c")).select("__x", "__y", "c.cx", "c.cy", "c.s")


def nearest_values(points: DataFrame, column: str, axis: DataFrame, out: str) -> DataFrame:
    """Add the nearest entry of a one-column frame ``axis(value)``; halfway, the larger entry."""
    return nearest_place(
        points.withColumn("__zero", F.lit(0.0)),
        axis.withColumn("__zero", F.lit(0.0)),
        place="value",
        point_xy=(column, "__zero"),
        place_xy=("value", "__zero"),
        out=out,
        prefer=lambda x, y: [-x],
    ).drop("__zero")
