import math
import random

import pytest

from geomarket.operators import near


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def scatter(rng, n, lat, lng, spread):
    return [(i, rng.uniform(lat - spread, lat + spread), rng.uniform(lng - spread, lng + spread)) for i in range(n)]


@pytest.mark.parametrize("lat,lng", [(47.5, -122.2), (0.0, 0.0), (-33.9, 151.2), (69.6, 18.9), (85.0, 40.0)])
def test_equals_brute_force_at_any_latitude(spark, lat, lng):
    rng = random.Random(int(lat * 10))
    listings, places = scatter(rng, 400, lat, lng, 0.2), scatter(rng, 60, lat, lng, 0.2)
    ldf = spark.createDataFrame([*listings, (900, None, lng)], "zpid long, latitude double, longitude double")
    pdf = spark.createDataFrame([*places, (901, lat, None)], "fsq_id long, latitude double, longitude double")
    radius = 2500.0
    expected = {}
    for i, a, b in listings:
        close = [(round(metres((a, b), (c, d)) * 1000), j) for j, c, d in places if metres((a, b), (c, d)) <= radius]
        if close:
            expected[i] = min(close)
    got = {r["zpid"]: (r["distance_mm"], r["fsq_id"]) for r in near.nearest_place(ldf, pdf, radius).collect()}
    assert got == expected
    assert {r["zpid"] for r in near.near_places(ldf, pdf, radius).collect()} == set(expected)


def test_copies_at_one_spot(spark):
    """Thousands of listings and places at one coordinate each: one search, every listing answered."""
    ldf = spark.range(3000).selectExpr("id as zpid", "47.5D as latitude", "-122.0D as longitude")
    pdf = spark.range(2000).selectExpr("id + 7 as fsq_id", "47.501D as latitude", "-122.0D as longitude")
    got = near.nearest_place(ldf, pdf).groupBy("fsq_id").count().collect()
    assert [(r["fsq_id"], r["count"]) for r in got] == [(7, 3000)]
    assert near.near_places(ldf, pdf).count() == 3000


def test_crowded_places_are_not_all_compared(spark):
    """Every listing and every place inside a few hundred metres: the search stays local."""
    rng = random.Random(11)
    listings, places = scatter(rng, 1500, 47.5, -122.2, 0.002), scatter(rng, 1500, 47.5, -122.2, 0.002)
    ldf = spark.createDataFrame(listings, "zpid long, latitude double, longitude double")
    pdf = spark.createDataFrame(places, "fsq_id long, latitude double, longitude double")
    expected = {i: min((round(metres((a, b), (c, d)) * 1000), j) for j, c, d in places) for i, a, b in listings}
    answer = near.nearest_place(ldf, pdf)
    assert {r["zpid"]: (r["distance_mm"], r["fsq_id"]) for r in answer.collect()} == expected


def test_coverage(spark):
    points = spark.createDataFrame([(0,), (1,), (2,)], "call int")
    results = spark.createDataFrame([(1,), (1,), (5,), (None,)], "call int")
    covered = near.covered_search_points(points, results, "call").collect()
    missed = near.covered_search_points(points, results, "call", covered=False).collect()
    assert [r["call"] for r in covered] == [1]
    assert sorted(r["call"] for r in missed) == [0, 2]
