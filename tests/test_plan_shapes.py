"""The physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from geomarket import fixtures as fx
from geomarket import queries, session
from geomarket.operators import cells, clean, filters, near, polygons, regions, surface, trends
from geomarket.plans import dashboard


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    clean.with_year_month(fx.sales(spark, sf_dir)).write.parquet(f"{tmp_path}/sales")
    stored = spark.read.parquet(f"{tmp_path}/sales")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(filters.filter_sales(stored, month_min=199901, beds_min=2, beds_max=3, bounds=queries.AREA).select("sale_price"))
    pushed = text.split("PushedFilters: ")[1]
    for part in ("GreaterThanOrEqual(beds,2)", "LessThanOrEqual(beds,3)", "GreaterThanOrEqual(year_month,199901)",
                 "GreaterThanOrEqual(lat,47.35)"):
        assert part in pushed
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "sqft" not in schema and "year_built" not in schema


def test_latest_sales_do_not_sort_everything(spark, sf_dir):
    text = plan(trends.recent_sales(clean.with_price_per_sqft(fx.sales(spark, sf_dir))))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_first_per_key_limits_before_the_shuffle(spark, sf_dir):
    text = plan(clean.first_per_key(fx.listings_b(spark, sf_dir), ["zpid"], ["pos"]))
    above, below = text.split("Exchange", 1)
    assert "WindowGroupLimit" in above and "Final" in above
    assert "WindowGroupLimit" in below and "Partial" in below


def test_duplicate_counts_combine_before_the_shuffle(spark, sf_dir):
    text = plan(clean.flag_duplicates(fx.listings_b(spark, sf_dir), "zpid"))
    assert "partial_count" in text and "Window" not in text


@pytest.mark.parametrize("name", [
    "points_in_polygons", "points_in_region", "points_within_buffer", "listings_near_places", "nearest_place",
    "kriging_neighbours", "variogram", "rebase_sales",
])
def test_no_join_without_an_equality(spark, small_dir, name):
    text = plan(queries.QUERIES[name](spark, small_dir))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_column_operators_stay_in_the_engine(spark, small_dir):
    for name in queries.QUERIES:
        if name in ("simplify_polygons", "kriging_surface"):
            continue
        if name.startswith("stream_"):
            continue
        text = plan(queries.QUERIES[name](spark, small_dir))
        assert "Python" not in text and "Pandas" not in text, name


def test_market_report(spark, small_dir):
    sales = clean.with_year_month(clean.prepare_sales(fx.sales(spark, small_dir)))
    listings = clean.with_listing_ppsf(cells.with_cell(fx.listings_a(spark, small_dir), "latitude", "longitude"))
    places = fx.places(spark, small_dir)
    whole = dashboard.market_report(sales, listings, places, dashboard.Selection(month_min=None), link_base="x/")
    area = dashboard.market_report(
        sales, listings, places, dashboard.Selection(month_min=199801, beds_min=1, beds_max=3, bounds=queries.AREA),
        link_base="x/")
    assert set(whole) == set(area)
    assert whole["sales_metrics"].first()["count"] == sales.count()
    assert 0 < area["sales_metrics"].first()["count"] < sales.count()
    labels = {r["location"] for r in area["monthly_sales"].select("location").distinct().collect()}
    assert labels == {"All areas", "Filtered area"}
    for part in area.values():
        assert part.count() > 0
    controls = dashboard.controls(sales, listings)
    assert controls["months"].count() > 50 and controls["price"].count() == 1


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_multiplied_sides_are_measured_before_a_broadcast(spark, small_dir, monkeypatch):
    """The source tables are tiny, their cells are not: above the limit nothing is broadcast."""
    sales, districts = fx.sales(spark, small_dir).select("lat", "lng"), fx.districts(spark, small_dir)
    listings, places = fx.listings_a(spark, small_dir), fx.places(spark, small_dir)
    samples = surface.lattice_samples(fx.sales(spark, small_dir), "sale_price")

    def joins():
        return [
            polygons.points_in_polygons(sales, districts), regions.points_in_region(sales, districts),
            near.near_places(listings, places), near.nearest_place(listings, places, key="pos"),
            surface.kriging_neighbours(samples, surface.grid_nodes(samples, 5, 5), k=4),
        ]

    few = joins()
    assert all("BroadcastHashJoin" in plan(df) for df in few)
    monkeypatch.setattr(session, "BROADCAST_UNITS", 5)
    many = joins()
    assert all("SortMergeJoin" in plan(df) for df in many)
    for a, b in zip(few, many):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_crowded_cell_is_split(spark, sf_dir, settings, monkeypatch):
    """Half of all points in one cell: its partition is read in pieces, and nothing is lost."""
    points = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, F.rand(1) * 0.01 - 122.419).otherwise(F.rand(2) * 0.8 - 122.5).alias("lng"),
        F.when(F.col("id") % 2 == 0, F.rand(3) * 0.01 + 47.241).otherwise(F.rand(4) * 0.6 + 47.2).alias("lat"),
    )
    districts = fx.districts(spark, sf_dir)
    expected = {r["name"]: r["count"] for r in polygons.points_in_polygons(points, districts).groupBy("name").count().collect()}
    monkeypatch.setattr(session, "BROADCAST_UNITS", 0)
    settings(
        shuffle__partitions="32", adaptive__advisoryPartitionSizeInBytes="256KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="256KB", adaptive__skewJoin__skewedPartitionFactor="2",
    )
    joined = polygons.points_in_polygons(points, districts).groupBy("name").agg(
        F.count("*").alias("count"), F.sum("lat"), F.sum("lng"))
    text = final_plan(joined)
    assert "skew=true" in text
    assert {r["name"]: r["count"] for r in joined.collect()} == expected
