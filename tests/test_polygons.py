import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomarket.operators import polygons as pg
from geomarket.operators import regions

RINGS = "array<array<struct<x:double,y:double>>>"


def shapes(spark, **named):
    return spark.createDataFrame(list(named.items()), f"name string, rings {RINGS}")


SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
HOLE = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4)]
NOTCHED = [(2.0, 0.0), (3.0, 0.0), (3.0, 1.0), (2.5, 0.3), (2.0, 1.0), (2.0, 0.0)]


def points(spark, *xy):
    return spark.createDataFrame([(float(x), float(y)) for x, y in xy], "x double, y double")


def hits(df):
    return sorted((r["x"], r["y"], r["name"]) for r in df.collect())


@pytest.mark.parametrize("side", [0.03, 0.25, 0.7, 5.0])
def test_within_excludes_the_boundary(spark, side):
    polygons = shapes(spark, holed=[SQUARE, HOLE], notched=[NOTCHED])
    probe = points(
        spark, (0.2, 0.2), (0.5, 0.5), (0.4, 0.5), (0.0, 0.5), (1.0, 1.0), (0.5, 0.0), (1.5, 0.5),
        (2.5, 0.2), (2.5, 0.3), (2.5, 0.6), (2.1, 0.7), (-3.0, 0.2))
    got = hits(pg.points_in_polygons(probe, polygons, x="x", y="y", side=side))
    assert got == [(0.2, 0.2, "holed"), (2.1, 0.7, "notched"), (2.5, 0.2, "notched")]


def brute_inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def star(rng, cx, cy, n):
    angles = sorted(rng.uniform(0, 2 * np.pi) for _ in range(n))
    ring = [(cx + rng.uniform(0.1, 1) * np.cos(a), cy + rng.uniform(0.1, 1) * np.sin(a)) for a in angles]
    return [(float(x), float(y)) for x, y in ring + ring[:1]]


def test_overlapping_stars_equal_brute_force(spark):
    rng = random.Random(5)
    rings = {f"s{i}": star(rng, rng.uniform(0, 3), rng.uniform(0, 3), 40) for i in range(6)}
    xy = [(rng.uniform(-1, 4), rng.uniform(-1, 4)) for _ in range(1500)]
    polygons = shapes(spark, **{k: [v] for k, v in rings.items()})
    expected = sorted((x, y, k) for x, y in xy for k, ring in rings.items() if brute_inside(ring, x, y))
    for side in (0.1, 0.45):
        assert hits(pg.points_in_polygons(points(spark, *xy), polygons, x="x", y="y", side=side)) == expected
    once = regions.points_in_region(points(spark, *xy), polygons, x="x", y="y", side=0.2)
    assert once.count() == len({(x, y) for x, y, _ in expected})


def test_buffer_equals_brute_force(spark):
    rng = random.Random(6)
    ring = star(rng, 0, 0, 25)
    xy = [(rng.uniform(-1.5, 1.5), rng.uniform(-1.5, 1.5)) for _ in range(800)]

    def distance(x, y):
        best = np.inf
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            d = np.array([x2 - x1, y2 - y1])
            t = np.clip(((x - x1) * d[0] + (y - y1) * d[1]) / (d @ d), 0, 1)
            best = min(best, np.hypot(x - x1 - t * d[0], y - y1 - t * d[1]))
        return best

    expected = sorted((x, y) for x, y in xy if brute_inside(ring, x, y) or distance(x, y) <= 0.12)
    got = pg.points_within_buffer(points(spark, *xy), shapes(spark, s=[ring]), 0.12, x="x", y="y", side=0.2)
    assert sorted((r["x"], r["y"]) for r in got.collect()) == expected


def test_dissolve_does_not_depend_on_order(spark):
    tiles = {f"t{i}{j}": [[(float(i + a), float(j + b)) for a, b in SQUARE]] for i in range(3) for j in range(3)}
    del tiles["t11"]
    df = shapes(spark, **tiles)
    outline = {tuple(r) for r in regions.dissolve_outline(df).collect()}
    assert len(outline) == 12 + 4
    assert outline == {tuple(r) for r in regions.dissolve_outline(df.orderBy(F.col("name").desc())).collect()}


def test_grid_and_bounds(spark):
    polygons = shapes(spark, square=[SQUARE], notched=[NOTCHED])
    bounds = pg.region_bounds(polygons)
    assert tuple(bounds.first()) == (0.0, 0.0, 3.0, 1.0)
    grid = pg.grid_points(bounds, 4, 3).collect()
    assert [(r["x"], r["y"]) for r in grid] == [(x, y) for x in (0.0, 1.0, 2.0, 3.0) for y in (0.0, 0.5, 1.0)]
    inside = regions.uniform_points(polygons, 7, 5).collect()
    assert sorted((r["x"], r["y"]) for r in inside) == [(0.5, 0.25), (0.5, 0.5), (0.5, 0.75), (2.5, 0.25)]


def test_simplify_keeps_within_tolerance(spark):
    angles = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    circle = [(float(np.cos(a)), float(np.sin(a))) for a in angles]
    ring = pg.simplify_polygons(shapes(spark, c=[circle]), "name", 0.02).first()["rings"][0]
    slim = np.array([(p["x"], p["y"]) for p in ring])
    assert 4 <= len(slim) < 60
    assert tuple(slim[0]) == tuple(slim[-1])
    assert {tuple(p) for p in slim} <= set(circle)
    for x, y in circle:
        a, b = slim[:-1], slim[1:]
        d = b - a
        t = np.clip(((np.array([x, y]) - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        assert np.hypot(*((a + t[:, None] * d) - [x, y]).T).min() <= 0.02 + 1e-12


def test_search_area_closes_the_ring(spark):
    open_square = [SQUARE[:4]]
    row = pg.search_area(shapes(spark, s=open_square), "name").first()
    assert row["area"] == "0.0 0.0,0.0 1.0,1.0 1.0,1.0 0.0,0.0 0.0"
