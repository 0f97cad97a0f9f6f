import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geomarket.functions import cells
from geomarket.functions.cells import DEFAULT_GRID
from geomarket.operators import cells as ops


AXIAL = st.lists(st.tuples(st.integers(-20000, 20000), st.integers(-20000, 20000)), min_size=50, max_size=200)


@settings(max_examples=5, deadline=None)
@given(AXIAL)
def test_centre_is_in_its_cell_and_parent_follows(spark, pairs):
    grid = cells.CellGrid(lat0=0.0, lng0=0.0, area_km2=0.005)
    df = spark.createDataFrame(pairs, "q long, r long").select("q", "r", cells.pack(F.col("q"), F.col("r")).alias("cell"))
    centre = cells.cell_centre(F.col("cell"), grid)
    rows = df.select(
        "q", "r", "cell", cells.axial_q(F.col("cell")).alias("q_again"), cells.axial_r(F.col("cell")).alias("r_again"),
        cells.cell_of(centre["lat"], centre["lng"], grid).alias("again"),
        cells.cell_parent(F.col("cell")).alias("parent"),
    ).collect()
    assert all((r["q"], r["r"], r["cell"]) == (r["q_again"], r["r_again"], r["again"]) for r in rows)
    parents = spark.createDataFrame([(r["parent"],) for r in rows], "parent long")
    again = cells.cell_parent(cells.central_child(F.col("parent")))
    assert all(r[0] == r[1] for r in parents.select("parent", again).collect())


def test_points_belong_to_the_nearest_centre(spark):
    """No neighbouring centre is closer than the centre of the cell a point was given."""
    points = spark.range(20_000).select((F.rand(3) * 0.3 + 47.3).alias("lat"), (F.rand(4) * 0.3 - 122.3).alias("lng"))
    cell = cells.cell_of(F.col("lat"), F.col("lng"))

    def gap(centre):
        x = (F.col("lng") - centre["lng"]) * DEFAULT_GRID.km_per_lng
        y = (F.col("lat") - centre["lat"]) * cells.KM_PER_LAT
        return x * x + y * y

    indexed = points.withColumn("cell", cell)
    q, r = cells.axial_q(F.col("cell")), cells.axial_r(F.col("cell"))
    around = [cells.pack(q + dq, r + dr) for dq, dr in [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]]
    own = gap(cells.cell_centre(F.col("cell")))
    closest = F.least(*[gap(cells.cell_centre(c)) for c in around])
    assert indexed.where(own > closest + 1e-9).count() == 0


def test_every_parent_has_seven_children(spark):
    span = spark.range(-40, 41)
    grid = span.select(F.col("id").alias("q"), F.explode(F.sequence(F.lit(-40), F.lit(40))).alias("r"))
    children = grid.select(cells.pack(F.col("q"), F.col("r")).alias("cell"), "q", "r").withColumn(
        "parent", cells.cell_parent(F.col("cell")))
    inner = children.groupBy("parent").agg(F.count("*").alias("n"), F.max(F.abs("q")).alias("q"), F.max(F.abs("r")).alias("r"))
    sizes = {row["n"] for row in inner.where("q < 36 and r < 36").select("n").distinct().collect()}
    assert sizes == {7}


@pytest.mark.parametrize("coarser", [0, 1, 2])
def test_boundary_is_a_closed_hexagon_around_the_centre(spark, coarser):
    cell = cells.pack(F.lit(12), F.lit(-5))
    row = spark.range(1).select(
        cells.cell_boundary(cell, coarser=coarser).alias("ring"),
        cells.cell_centre(cell, coarser=coarser).alias("centre")).first()
    ring, centre = row["ring"], row["centre"]
    assert len(ring) == 7 and ring[0] == ring[-1]
    radius = DEFAULT_GRID.size_km * math.sqrt(7) ** coarser
    for corner in ring:
        x = (corner["lng"] - centre["lng"]) * DEFAULT_GRID.km_per_lng
        y = (corner["lat"] - centre["lat"]) * cells.KM_PER_LAT
        assert math.hypot(x, y) == pytest.approx(radius, rel=1e-9)


def test_parent_centre_matches_its_central_child(spark):
    cell = cells.pack(F.lit(101), F.lit(-77))
    parent = cells.cell_parent(cell)
    row = spark.range(1).select(
        cells.cell_centre(parent, coarser=1).alias("a"),
        cells.cell_centre(cells.central_child(parent)).alias("b")).first()
    assert row["a"]["lng"] == pytest.approx(row["b"]["lng"], abs=1e-9)
    assert row["a"]["lat"] == pytest.approx(row["b"]["lat"], abs=1e-9)


def test_points_without_a_cell(spark):
    rows = spark.createDataFrame(
        [(None, -122.0), (47.0, None), (91.0, 0.0), (47.0, 181.0), (47.5, -122.1)], "lat double, lng double")
    got = [r["cell"] for r in ops.with_cell(rows, "lat", "lng").collect()]
    assert got[:4] == [None] * 4 and got[4] is not None
    assert ops.indexable(rows, "lat", "lng").count() == 1


def test_rollup_counts_every_point(spark):
    rows = spark.range(5000).select(
        (F.rand(1) * 0.5 + 47.2).alias("lat"), (F.rand(2) * 0.5 - 122.4).alias("lng"))
    indexed = ops.with_cell(rows, "lat", "lng")
    assert ops.cell_rollup(indexed).agg(F.sum("n")).first()[0] == 5000


def test_clusters_nest(spark):
    rows = spark.range(3000).select(
        (F.rand(1) * 0.5 + 47.2).alias("latitude"), (F.rand(2) * 0.5 - 122.4).alias("longitude"))
    got = ops.zoom_clusters(rows).groupBy("zoom").agg(F.sum("n").alias("n"), F.count("*").alias("clusters")).collect()
    assert len(got) == 12 and all(r["n"] == 3000 for r in got)
    clusters = [r["clusters"] for r in sorted(got, key=lambda r: r["zoom"])]
    assert clusters == sorted(clusters)
