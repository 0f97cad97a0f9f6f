"""Hexagonal cells as Column arithmetic.

Cells are pointy-top hexagons on a local equirectangular plane around a fixed
origin, so ids never depend on the data. Every level is a hexagonal lattice
seven times coarser than the one below and rotated against it, which gives each
parent exactly seven children: the one at its centre and that one's neighbours.
Ids are not compatible with any public cell index, and areas drift away from the
nominal one as latitude moves away from the origin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres per degree, and the packing of two axial coordinates into one bigint.
KM_PER_LAT = 110.574
KM_PER_LNG_EQUATOR = 111.32
AXIS_BITS = 28
AXIS_OFFSET = 1 << (AXIS_BITS - 1)


@dataclass(frozen=True)
class CellGrid:
    lat0: float = 47.5
    lng0: float = -122.1
    area_km2: float = 0.74

    @property
    def size_km(self) -> float:
        """Hexagon side length, which is also its circumradius."""
        return math.sqrt(self.area_km2 * 2 / (3 * math.sqrt(3)))

    @property
    def km_per_lng(self) -> float:
        return KM_PER_LNG_EQUATOR * math.cos(math.radians(self.lat0))


DEFAULT_GRID = CellGrid()


def _nearest_hex(u: Column, v: Column) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon that holds a plane point.

    ``u`` is x in units of the spacing between neighbours, ``v`` is y in units of
    the side length. Three floors decide it, so the inputs are repeated only a
    few times and the expression stays small.
    """
    strip = F.floor(u + v + 1.0)
    r = F.floor((strip + v - u + 1.0) / 3.0)
    return F.floor((strip + u * 2.0 + 1.0) / 3.0) - r, r


def pack(q: Column, r: Column) -> Column:
    return F.shiftleft((q + AXIS_OFFSET).cast("bigint"), AXIS_BITS) + (r + AXIS_OFFSET).cast("bigint")


def axial_q(cell: Column) -> Column:
    return F.shiftright(cell, AXIS_BITS) - F.lit(AXIS_OFFSET).cast("bigint")


def axial_r(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit((1 << AXIS_BITS) - 1).cast("bigint")) - F.lit(AXIS_OFFSET).cast("bigint")


def cell_of(lat: Column, lng: Column, grid: CellGrid = DEFAULT_GRID) -> Column:
    """Cell id of a point; null where a coordinate is missing or not on the globe."""
    u = (lng - grid.lng0) * (grid.km_per_lng / (math.sqrt(3) * grid.size_km))
    v = (lat - grid.lat0) * (KM_PER_LAT / grid.size_km)
    q, r = _nearest_hex(u, v)
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), pack(q, r))


def cell_parent(cell: Column) -> Column:
    """Id on the next coarser lattice.

    The coarse coordinates are sevenths of ``3q + r`` and ``2r - q``; everything
    stays in integers, so the result is exact.
    """
    q, r = axial_q(cell), axial_r(cell)
    a, b = q * 3 + r, r * 2 - q
    strip = F.floor((a + b * 2 + 7) / 7.0)
    parent_r = F.floor((strip * 7 + b - a + 7) / 21.0)
    return pack(F.floor((strip * 7 + a * 2 + b + 7) / 21.0) - parent_r, parent_r)


def central_child(parent: Column) -> Column:
    """Cell one level finer that sits at the centre of ``parent``."""
    a, b = axial_q(parent), axial_r(parent)
    return pack(a * 2 - b, a + b * 3)


def _lattice_steps(grid: CellGrid, coarser: int) -> tuple[complex, complex]:
    """Plane vectors (km) of the two axial unit steps, ``coarser`` levels up."""
    side = grid.size_km * math.sqrt(3)
    q_step, r_step = complex(side, 0), complex(side / 2, side * math.sqrt(3) / 2)
    for _ in range(coarser):
        q_step, r_step = 2 * q_step + r_step, -q_step + 3 * r_step
    return q_step, r_step


def cell_centre(cell: Column, grid: CellGrid = DEFAULT_GRID, coarser: int = 0) -> Column:
    """``struct<lng,lat>`` of a cell's centre."""
    q, r = axial_q(cell), axial_r(cell)
    dq, dr = _lattice_steps(grid, coarser)
    return F.struct(
        ((q * dq.real + r * dr.real) / grid.km_per_lng + grid.lng0).alias("lng"),
        ((q * dq.imag + r * dr.imag) / KM_PER_LAT + grid.lat0).alias("lat"),
    )


def cell_boundary(cell: Column, grid: CellGrid = DEFAULT_GRID, coarser: int = 0) -> Column:
    """Closed ring of seven ``struct<lng,lat>`` corners, counter-clockwise."""
    q_step, _ = _lattice_steps(grid, coarser)
    first = q_step / math.sqrt(3) * complex(math.cos(math.pi / 6), math.sin(math.pi / 6))
    turn = complex(0.5, math.sqrt(3) / 2)
    centre = cell_centre(cell, grid, coarser)
    corners = []
    for step in range(7):
        offset = first * turn ** (step % 6)
        corners.append(F.struct(
            (centre["lng"] + offset.real / grid.km_per_lng).alias("lng"),
            (centre["lat"] + offset.imag / KM_PER_LAT).alias("lat"),
        ))
    return F.when(cell.isNotNull(), F.array(*corners))
