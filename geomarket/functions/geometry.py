"""Geometry on nested columns: rings are ``array<struct<x,y>>``, edges ``array<struct<x1,y1,x2,y2>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in metres.
EARTH_RADIUS_M = 6371008.8


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def close_ring(ring: Column) -> Column:
    """Repeat the first point at the end unless it is there already."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(
        F.concat(ring, F.slice(ring, 1, 1))
    )


def ring_edges(ring: Column) -> Column:
    closed = close_ring(ring)
    return F.zip_with(
        F.slice(closed, F.lit(1), F.size(closed) - 1),
        F.slice(closed, F.lit(2), F.size(closed) - 1),
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def polygon_edges(rings: Column) -> Column:
    """Edges of all rings; even-odd counting over them handles holes and parts alike."""
    return F.flatten(F.transform(rings, ring_edges))


def crosses_ray(edge: Column, x: Column, y: Column) -> Column:
    """Does a ray from the point towards +x cross the edge?

    Horizontal edges never pass the first test, but both tests may be evaluated
    in either order, hence the guarded division.
    """
    at = F.try_divide((edge["x2"] - edge["x1"]) * (y - edge["y1"]), edge["y2"] - edge["y1"]) + edge["x1"]
    return ((edge["y1"] > y) != (edge["y2"] > y)) & (x < at)


def on_edge(edge: Column, x: Column, y: Column) -> Column:
    cross = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) - (edge["y2"] - edge["y1"]) * (x - edge["x1"])
    return (
        (cross == 0)
        & x.between(F.least(edge["x1"], edge["x2"]), F.greatest(edge["x1"], edge["x2"]))
        & y.between(F.least(edge["y1"], edge["y2"]), F.greatest(edge["y1"], edge["y2"]))
    )


def odd_crossings(edges: Column, x: Column, y: Column) -> Column:
    return F.size(F.filter(edges, lambda e: F.coalesce(crosses_ray(e, x, y), F.lit(False)))) % 2 == 1


def strictly_inside(edges: Column, x: Column, y: Column) -> Column:
    return odd_crossings(edges, x, y) & ~F.exists(edges, lambda e: on_edge(e, x, y))


def edge_distance_sq(edge: Column, x: Column, y: Column) -> Column:
    """Squared planar distance from a point to an edge, in coordinate units."""
    dx, dy = edge["x2"] - edge["x1"], edge["y2"] - edge["y1"]
    along = F.try_divide((x - edge["x1"]) * dx + (y - edge["y1"]) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    gap_x = x - (edge["x1"] + dx * t)
    gap_y = y - (edge["y1"] + dy * t)
    return gap_x * gap_x + gap_y * gap_y


def edge_meets_box(edge: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does the edge's bounding box overlap the given box? (Never misses a real hit.)"""
    return (
        (F.greatest(edge["x1"], edge["x2"]) >= x0) & (F.least(edge["x1"], edge["x2"]) <= x1)
        & (F.greatest(edge["y1"], edge["y2"]) >= y0) & (F.least(edge["y1"], edge["y2"]) <= y1)
    )
