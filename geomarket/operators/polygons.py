"""Polygon operators on rows with ``rings: array<array<struct<x,y>>>``."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomarket.functions import geometry, text
from geomarket.session import build_side

DEFAULT_SQUARE = 0.02


def with_edges(polygons: DataFrame) -> DataFrame:
    return polygons if "edges" in polygons.columns else polygons.withColumn(
        "edges", geometry.polygon_edges(F.col("rings"))
    )


def _square(value: Column, side: float) -> Column:
    return F.floor(value / side)


def _span(edges: Column, axis: str) -> tuple[Column, Column]:
    """Smallest and largest coordinate of the edges along an axis."""
    low = F.transform(edges, lambda e: F.least(e[f"{axis}1"], e[f"{axis}2"]))
    high = F.transform(edges, lambda e: F.greatest(e[f"{axis}1"], e[f"{axis}2"]))
    return F.array_min(low), F.array_max(high)


def cover(polygons: DataFrame, side: float = DEFAULT_SQUARE, margin: float = 0.0) -> DataFrame:
    """Cut polygons into square cells, one row per polygon and useful cell.

    A cell no edge comes near is either wholly inside, and then needs no test at
    all (``edges`` is null), or wholly outside, and then is dropped. The others
    keep only the edges that can decide a point of that cell: those a ray towards
    +x could cross, and those within ``margin``.

    Polygons are cut into rows first, so that a cell looks only at the edges of
    its row and the work grows with the outline rather than with its square.
    """
    # The slack keeps points that rounding puts on the wrong side of a cell border.
    slack = margin + side * 1e-6
    edges = F.col("edges")

    def steps(axis: str) -> Column:
        low, high = _span(edges, axis)
        return F.explode(F.sequence(_square(low - slack, side), _square(high + slack, side)))

    south, north = F.col("cell_y") * side - slack, (F.col("cell_y") + 1) * side + slack
    west, east = F.col("cell_x") * side - slack, (F.col("cell_x") + 1) * side + slack
    everywhere = F.lit(math.inf)
    rows = with_edges(polygons).withColumn("cell_y", steps("y")).withColumn(
        "edges", F.filter(edges, lambda e: geometry.edge_meets_box(e, -everywhere, south, everywhere, north))
    )
    touched = F.exists(edges, lambda e: geometry.edge_meets_box(e, west, south, east, north))
    whole = geometry.odd_crossings(edges, (F.col("cell_x") + 0.5) * side, (F.col("cell_y") + 0.5) * side)
    deciding = F.filter(edges, lambda e: geometry.edge_meets_box(e, west, south, everywhere, north))
    return (
        rows.withColumn("cell_x", steps("x"))
        .withColumn("_touched", touched)
        .where(F.col("_touched") | whole)
        .withColumn("edges", F.when(F.col("_touched"), deciding))
        .drop("_touched")
    )


def _contains(x: str, y: str, margin: float) -> Column:
    px, py, edges = F.col(x), F.col(y), F.col("_edges")
    if margin:
        near = F.exists(edges, lambda e: geometry.edge_distance_sq(e, px, py) <= margin * margin)
        odd = geometry.odd_crossings(edges, px, py)
        test = odd | near if margin > 0 else odd & ~near
    else:
        test = geometry.strictly_inside(edges, px, py)
    return edges.isNull() | test


def matched(points: DataFrame, polygons: DataFrame, x: str, y: str, keep: Sequence[str], side: float,
            margin: float, how: str) -> DataFrame:
    """Points joined to the polygons that hold them: widened by ``margin``, or made narrower if it is below zero."""
    cells = cover(polygons, side, abs(margin)).select(
        F.col("cell_x").alias("_cell_x"), F.col("cell_y").alias("_cell_y"), F.col("edges").alias("_edges"), *keep
    )
    squares = build_side(cells, "polygon-cells", F.coalesce(F.size("_edges"), F.lit(0)) + 1)
    same_cell = (_square(F.col(x), side) == F.col("_cell_x")) & (_square(F.col(y), side) == F.col("_cell_y"))
    joined = points.join(squares, same_cell & _contains(x, y, margin), how)
    return joined if how == "left_semi" else joined.drop("_cell_x", "_cell_y", "_edges")


def points_in_polygons(points: DataFrame, polygons: DataFrame, *, x: str = "lng", y: str = "lat",
                       keep: Sequence[str] = ("name",), side: float = DEFAULT_SQUARE) -> DataFrame:
    """Each point with the attributes of every polygon it lies within; boundaries do not count."""
    return matched(points, polygons, x, y, keep, side, 0.0, "inner")


def points_within_buffer(points: DataFrame, polygons: DataFrame, distance: float, *, x: str = "lng",
                         y: str = "lat", side: float = DEFAULT_SQUARE) -> DataFrame:
    """Points within, or at most ``distance`` degrees away from, any of the polygons."""
    return matched(points, polygons, x, y, (), side, distance, "left_semi")


def region_bounds(polygons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Extent of all polygons together, or per group."""
    edges = F.col("edges")

    def end(reduce, axis: str) -> Column:
        return reduce(F.transform(edges, lambda e: e[f"{axis}1"]))

    return (
        with_edges(polygons).groupBy(*by).agg(
            F.min(end(F.array_min, "x")).alias("min_x"), F.min(end(F.array_min, "y")).alias("min_y"),
            F.max(end(F.array_max, "x")).alias("max_x"), F.max(end(F.array_max, "y")).alias("max_y"),
        )
    )


def linspace(low: Column, high: Column, n: int) -> Column:
    """``n`` evenly spaced values including both ends."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / float(max(n - 1, 1)))


def grid_points(bounds: DataFrame, number_x: int, number_y: int) -> DataFrame:
    """All combinations of evenly spaced x and y inside each row of ``bounds``, x-major."""
    return (
        bounds.select("*", F.posexplode(linspace(F.col("min_x"), F.col("max_x"), number_x)).alias("grid_x", "x"))
        .select("*", F.posexplode(linspace(F.col("min_y"), F.col("max_y"), number_y)).alias("grid_y", "y"))
        .drop("min_x", "min_y", "max_x", "max_y")
    )


def polygon_parts(shapes: DataFrame, key: str) -> DataFrame:
    """One row per part of a multi-part polygon (``parts: array<rings>``)."""
    return shapes.select(key, F.posexplode("parts").alias("part", "rings"))


def polygon_vertices(polygons: DataFrame, key: str) -> DataFrame:
    return (
        polygons.select(key, F.posexplode("rings").alias("ring", "_points"))
        .select(key, "ring", F.posexplode("_points").alias("seq", "_p"))
        .select(key, "ring", "seq", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    )


def closed_rings(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("rings", F.transform("rings", geometry.close_ring))


def search_area(polygons: DataFrame, key: str) -> DataFrame:
    """The outer ring as one closed ``lat lng,lat lng,...`` search string."""
    outer = geometry.close_ring(F.col("rings")[0])
    return polygons.select(
        key, F.array_join(F.transform(outer, lambda p: text.search_string(p["y"], p["x"])), ",").alias("area")
    )


def _kept_vertices(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on one open line: split at the farthest vertex until all are close enough."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        start, end = spans.pop()
        if end - start < 2:
            continue
        origin, chord = points[start], points[end] - points[start]
        rest = points[start + 1:end] - origin
        length_sq = float(chord @ chord)
        along = np.clip(rest @ chord / length_sq, 0.0, 1.0) if length_sq else np.zeros(len(rest))
        gaps = np.hypot(*(rest - along[:, None] * chord).T)
        worst = int(np.argmax(gaps))
        if gaps[worst] > tolerance:
            middle = start + 1 + worst
            keep[middle] = True
            spans += [(start, middle), (middle, end)]
    return points[keep]


def simplify_polygons(polygons: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Fewer vertices: no dropped vertex is farther than ``tolerance`` from the new outline.

    A closed ring is simplified as two lines, cut at the vertex farthest from
    its start, so it never collapses onto its closing point.
    """

    def simplify(ring: list) -> list[dict]:
        points = np.array([(p["x"], p["y"]) for p in ring])
        if len(points) <= 4:
            return list(ring)
        turn = int(np.argmax(np.hypot(*(points - points[0]).T)))
        first, second = _kept_vertices(points[:turn + 1], tolerance), _kept_vertices(points[turn:], tolerance)
        slim = np.vstack([first, second[1:]])
        return [{"x": x, "y": y} for x, y in (slim if len(slim) >= 4 else points).tolist()]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(rings=[[simplify(ring) for ring in rings] for rings in frame["rings"]])

    closed = closed_rings(polygons).select(key, "rings")
    return closed.mapInPandas(batches, closed.schema)


# What tasks run here travels with the job, so executors need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
