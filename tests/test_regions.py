import random

import numpy as np
import pytest
from test_polygons import brute_inside, points, shapes

from geomarket.operators import polygons as pg
from geomarket.operators import regions as ar
from geomarket.session import written


def box(x1, y1, x2, y2, clockwise=False):
    ring = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    return [(float(x), float(y)) for x, y in (ring[::-1] if clockwise else ring)]


def star(rng, cx, cy, n):
    """A ring around a point that does not cross itself."""
    ring = [(cx + r * np.cos(a), cy + r * np.sin(a)) for a, r in (
        ((i + rng.uniform(0, 0.9)) * 2 * np.pi / n, rng.uniform(0.1, 1)) for i in range(n))]
    return [(float(x), float(y)) for x, y in ring + ring[:1]]


def parts_of(df):
    return [[[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in df.orderBy("part").collect()]


def area(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])) / 2


CASES = {
    "shared": ([box(0, 0, 1, 1)], [box(1, 0, 2, 1)]),
    "repeated": ([box(0, 0, 1, 1)], [box(0, 0, 1, 1)], [box(0, 0, 1, 1, clockwise=True)]),
    "junction": ([box(0, 0, 2, 1)], [box(0, 1, 1, 2, clockwise=True)], [box(1, 1, 2, 3)]),
    "overlap": ([box(0, 0, 2, 2)], [box(1, 1, 3, 3)]),
    "inside": ([box(0, 0, 4, 4)], [box(1, 1, 2, 2)]),
    "hole": ([box(0, 0, 4, 4), box(1, 1, 3, 3)],),
    "filled hole": ([box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(1, 1, 3, 3)]),
    "half filled": ([box(0, 0, 4, 4), box(1, 1, 3, 3, clockwise=True)], [box(1, 1, 2, 3)]),
    "island": ([box(0, 0, 6, 6), box(1, 1, 5, 5)], [box(2, 2, 4, 4)]),
    "corner": ([box(0, 0, 1, 1)], [box(1, 1, 2, 2)]),
    "touching hole": ([box(0, 0, 4, 4)[:1] + [(2.0, 0.0)] + box(0, 0, 4, 4)[1:], [(2.0, 0.0), (3.0, 1.0), (1.0, 1.0), (2.0, 0.0)]],),
    "ring of boxes": tuple([box(x, y, x + 1, y + 1)] for x in range(3) for y in range(3) if (x, y) != (1, 1)),
    None: ([box(0, 0, 1, 1)], [box(1, 0, 2, 1)]),
    "two holes at a point": tuple([box(x, y, x + 1, y + 1)] for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2))),
}
# Parts with their number of rings and area.
FOUND = {
    "shared": [(1, 2)], "repeated": [(1, 1)], "junction": [(1, 5)], "overlap": [(1, 7)], "inside": [(1, 16)],
    "hole": [(2, 12)], "filled hole": [(1, 16)], "half filled": [(2, 14)], "island": [(2, 20), (1, 4)],
    "corner": [(1, 1), (1, 1)], "touching hole": [(2, 15)], "ring of boxes": [(2, 8)], "two holes at a point": [(3, 14)],
    None: [(1, 2)],
}


def test_hand_made_regions(spark):
    rows = [(name, rings) for name, members in CASES.items() for rings in members]
    df = spark.createDataFrame(rows, "name string, rings array<array<struct<x:double,y:double>>>").repartition(3)
    found = {}
    for r in ar.dissolve(df, ["name"], side=0.5).orderBy("part").collect():
        rings = [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
        assert area(rings[0]) > 0 and all(area(h) < 0 for h in rings[1:])
        assert all(ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1 for ring in rings), "no ring meets itself"
        assert sum(map(area, rings)) == pytest.approx(r["area"])
        found.setdefault(r["name"], []).append((len(rings), r["area"]))
    assert found == FOUND


def test_points_on_inner_borders_are_inside(spark):
    region = shapes(spark, a=[box(0, 0, 1, 1)], b=[box(1, 0, 2, 1)], c=[box(0, 1, 2, 2)], d=[box(0, 0, 1, 1)])
    probe = points(spark, (1, 0.5), (1, 1), (0.3, 1), (0, 0.5), (1, 0), (2, 2), (1.5, 2), (3, 1))
    got = ar.points_in_region(probe, region, x="x", y="y", side=0.25)
    assert sorted(map(tuple, got.collect())) == [(0.3, 1.0), (1.0, 0.5), (1.0, 1.0)]


def test_stars_against_brute_force(spark):
    rng = random.Random(11)
    rings = {f"s{i}": star(rng, rng.uniform(0, 3), rng.uniform(0, 3), 30) for i in range(8)}
    rings["again"] = rings["s0"]
    polygons = shapes(spark, **{k: [v] for k, v in rings.items()})
    xy = [(rng.uniform(-1, 4), rng.uniform(-1, 4)) for _ in range(3000)]
    expected = sorted((x, y) for x, y in xy if any(brute_inside(r, x, y) for r in rings.values()))
    parts = written(ar.dissolve(polygons, crowded=30, side=0.3), "parts")
    inside = pg.points_in_polygons(points(spark, *xy), parts, x="x", y="y", keep=("part",), side=0.3)
    assert sorted((r.x, r.y) for r in inside.collect()) == expected
    # No two edges of the outline meet but at their ends.
    edges = [(*p, *q) for rings in parts_of(parts) for ring in rings for p, q in zip(ring, ring[1:])]
    a = np.array(edges)

    def side(p, q, r):
        return np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))

    for x1, y1, x2, y2 in edges:
        p, q = np.tile([x1, y1], (len(a), 1)), np.tile([x2, y2], (len(a), 1))
        shared = ((a[:, None, :2] == np.array([[x1, y1], [x2, y2]])).all(-1) | (a[:, None, 2:] == np.array([[x1, y1], [x2, y2]])).all(-1)).any(1)
        crossing = (side(p, q, a[:, :2]) * side(p, q, a[:, 2:]) < 0) & (side(a[:, :2], a[:, 2:], p) * side(a[:, :2], a[:, 2:], q) < 0)
        assert not (crossing & ~shared).any()


def test_outline_keeps_its_coordinates(spark):
    # Coordinates that the grid cannot hold stay as they are where nothing is split.
    third = [(0.0, 0.0), (1 / 3, 0.0), (1 / 3, 1 / 7), (0.0, 0.0)]
    got = {tuple(r)[1:] for r in ar.outline(shapes(spark, a=[third])).collect()}
    assert got == {(*p, *q) for p, q in zip(third, third[1:])}


def test_crowded_squares_are_split(spark):
    edges = spark.createDataFrame(
        [("", i, 0, i, 1_000_000_000) for i in range(0, 4_000_000, 10_000)] + [("", -10**12 // 4, 5, 10**12 // 4, 6)],
        "region string, x1 long, y1 long, x2 long, y2 long")
    found = ar.in_squares(edges, crowded=150)
    sizes = [r["count"] for r in found.groupBy("level", "cx", "cy").count().collect()]
    assert max(sizes) <= 150
    assert found.select("x1", "y1", "x2", "y2").distinct().count() == 401
    # The long edge is cut only where others are many.
    assert found.where("x2 - x1 > 1000").count() < 600


def test_no_members(spark):
    assert ar.outline(spark.createDataFrame([("a", None), ("b", [])], "name string, rings array<array<struct<x:double,y:double>>>")).count() == 0
