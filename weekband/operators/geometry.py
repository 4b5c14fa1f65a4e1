"""Spatial join and contiguity of polygon layers.

A layer is a table with an id and `rings`, an array of arrays of (x, y). Rings count even-odd, so
holes and multi-part polygons need no special case.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grouped functions travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _vertices(rings: Column) -> Column:
    return F.flatten(rings)


def with_box(layer: DataFrame) -> DataFrame:
    """Layer with the bounding box of its rings."""
    xs = F.transform(_vertices(F.col("rings")), lambda p: p.x)
    ys = F.transform(_vertices(F.col("rings")), lambda p: p.y)
    return layer.withColumns(
        {
            "x_min": F.array_min(xs),
            "x_max": F.array_max(xs),
            "y_min": F.array_min(ys),
            "y_max": F.array_max(ys),
        }
    )


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def candidate_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float) -> DataFrame:
    """(left_id, right_id) whose bounding boxes share a point.

    Boxes are spread over square cells and joined on the cell. A pair that meets in many cells is
    kept in the one that holds the lower left corner of the common box, so no distinct is needed.
    """

    def spread(layer: DataFrame, id_: str, tag: str) -> DataFrame:
        box = with_box(layer.select(id_, "rings")).drop("rings")
        named = box.withColumnsRenamed({c: f"{tag}_{c}" for c in ("x_min", "x_max", "y_min", "y_max")})
        return named.withColumn("cx", _cells(F.col(f"{tag}_x_min"), F.col(f"{tag}_x_max"), cell)).withColumn(
            "cy", _cells(F.col(f"{tag}_y_min"), F.col(f"{tag}_y_max"), cell)
        )

    met = spread(left, left_id, "l").join(spread(right, right_id, "r"), ["cx", "cy"])
    x_low, y_low = F.greatest("l_x_min", "r_x_min"), F.greatest("l_y_min", "r_y_min")
    overlap = (x_low <= F.least("l_x_max", "r_x_max")) & (y_low <= F.least("l_y_max", "r_y_max"))
    home = (F.col("cx") == F.floor(x_low / cell)) & (F.col("cy") == F.floor(y_low / cell))
    return met.where(overlap & home).select(left_id, right_id)


def intersecting_pairs(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float
) -> DataFrame:
    """(left_id, right_id) of polygons that share at least one point, boundaries included."""

    def flat(layer: DataFrame, id_: str, tag: str) -> DataFrame:
        vertices = _vertices(F.col("rings"))
        return layer.select(
            id_,
            F.transform(vertices, lambda p: p.x).alias(f"{tag}_x"),
            F.transform(vertices, lambda p: p.y).alias(f"{tag}_y"),
            F.transform("rings", F.size).alias(f"{tag}_sizes"),
        )

    pairs = candidate_pairs(left, right, left_id, right_id, cell)
    shaped = pairs.join(flat(left, left_id, "l"), left_id).join(flat(right, right_id, "r"), right_id)
    schema = shaped.select(left_id, right_id).schema

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [
                polygons_meet(Edges(a, b, c), Edges(d, e, f))
                for a, b, c, d, e, f in zip(
                    batch.l_x, batch.l_y, batch.l_sizes, batch.r_x, batch.r_y, batch.r_sizes
                )
            ]
            yield batch.loc[np.array(hit, dtype=bool), [left_id, right_id]]

    return shaped.mapInPandas(refine, schema)


def areas_meeting(areas: DataFrame, boundary: DataFrame, area: str, boundary_id: str, cell: float) -> DataFrame:
    """Areas that meet any feature of the boundary layer."""
    pairs = intersecting_pairs(boundary, areas, boundary_id, area, cell)
    return areas.join(pairs, area, "left_semi")


class Edges:
    """Directed edges of a polygon, and one vertex of every ring."""

    def __init__(self, x, y, sizes):
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        sizes = np.asarray(sizes, dtype=int)
        ends = np.cumsum(sizes)
        follow = np.arange(1, len(x) + 1)
        follow[ends - 1] = ends - sizes
        self.x1, self.y1, self.x2, self.y2 = x, y, x[follow], y[follow]
        self.corners = np.stack([x[ends - sizes], y[ends - sizes]], axis=1)

    def near(self, other: Edges) -> tuple[np.ndarray, ...]:
        """Edges whose boxes reach the box of `other`."""
        keep = (
            (np.maximum(self.x1, self.x2) >= other.x1.min())
            & (np.minimum(self.x1, self.x2) <= other.x1.max())
            & (np.maximum(self.y1, self.y2) >= other.y1.min())
            & (np.minimum(self.y1, self.y2) <= other.y1.max())
        )
        return self.x1[keep], self.y1[keep], self.x2[keep], self.y2[keep]

    def contains(self, px: float, py: float) -> bool:
        crosses = (self.y1 > py) != (self.y2 > py)
        run = np.where(crosses, self.y2 - self.y1, 1.0)
        at = self.x1 + (py - self.y1) * (self.x2 - self.x1) / run
        return bool(np.count_nonzero(crosses & (px < at)) % 2)


def polygons_meet(a: Edges, b: Edges, block: int = 2048) -> bool:
    """True if edges touch or cross, or one polygon lies inside the other."""
    ax1, ay1, ax2, ay2 = a.near(b)
    bx1, by1, bx2, by2 = b.near(a)

    def side(ox, oy, dx, dy, px, py):
        return np.sign((dx - ox) * (py - oy) - (dy - oy) * (px - ox))

    for at in range(0, len(ax1), block):
        x1, y1, x2, y2 = (v[at : at + block, None] for v in (ax1, ay1, ax2, ay2))
        apart = (
            (np.maximum(x1, x2) < np.minimum(bx1, bx2))
            | (np.minimum(x1, x2) > np.maximum(bx1, bx2))
            | (np.maximum(y1, y2) < np.minimum(by1, by2))
            | (np.minimum(y1, y2) > np.maximum(by1, by2))
        )
        first = side(x1, y1, x2, y2, bx1, by1) * side(x1, y1, x2, y2, bx2, by2) <= 0
        second = side(bx1, by1, bx2, by2, x1, y1) * side(bx1, by1, bx2, by2, x2, y2) <= 0
        if (first & second & ~apart).any():
            return True
    return any(b.contains(x, y) for x, y in a.corners) or any(a.contains(x, y) for x, y in b.corners)


def queen_neighbours(areas: DataFrame, area: str = "area_id", snap: float = 1.5e-8) -> DataFrame:
    """Directed edges (src, dst) between areas with a vertex in common, up to `snap`.

    Vertices are joined on cells of four snap distances. One side also visits the adjacent cell
    where a vertex is near a cell border, so noise that crosses a border is still matched. Pairs
    are found in one direction and mirrored after the distinct.
    """
    points = areas.select(area, F.explode(_vertices(F.col("rings"))).alias("p")).select(
        area, F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )
    if snap > 0:
        size = 4.0 * snap
        own = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn(
            "cy", F.floor(F.col("y") / size)
        )
        reach = points.withColumn("cx", _cells(F.col("x") - snap, F.col("x") + snap, size)).withColumn(
            "cy", _cells(F.col("y") - snap, F.col("y") + snap, size)
        )
    else:
        own = reach = points.withColumn("cx", F.col("x")).withColumn("cy", F.col("y"))
    a = reach.select("cx", "cy", F.col(area).alias("_a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = own.select("cx", "cy", F.col(area).alias("_b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    gap = F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by"), F.lit(2))
    pairs = (
        a.join(b, ["cx", "cy"])
        .where((F.col("_a") < F.col("_b")) & (gap <= F.lit(snap * snap)))
        .select("_a", "_b")
        .distinct()
    )
    both = F.array(
        F.struct(F.col("_a").alias("src"), F.col("_b").alias("dst")),
        F.struct(F.col("_b").alias("src"), F.col("_a").alias("dst")),
    )
    return pairs.select(F.explode(both).alias("e")).select("e.src", "e.dst")
