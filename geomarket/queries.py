"""The registered queries: every operator on tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomarket import fixtures as fx
from geomarket import schema
from geomarket.functions import cells as cell_functions
from geomarket.functions import colour, geometry, text
from geomarket.operators import (
    cells, clean, filters, labels, near, polygons, quantiles, regions, summary, surface, trends,
)
from geomarket.plans import acquisition, dashboard, rebasing
from geomarket.session import scratch_path, written
from geomarket.sources import geojson, pages, tables
from geomarket.streaming import listings as listing_stream
from geomarket.streaming import monthly as monthly_stream

AREA = filters.Bounds(south=47.35, west=-122.3, north=47.6, east=-122.0)
PAGE_SIZE = 41
DISTRICTS = ["NATION_1", "NATION_2", "NATION_3", "NATION_7", "NATION_11", "NATION_12", "NATION_18"]
LINK_BASE = "https://listings.example/homedetails/"
MAX_LAG = 0.006
BUFFER = 0.004

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Inputs ---------------------------------------------------------------------------------------

def _sales(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_year_month(clean.prepare_sales(fx.sales(spark, sf)))


def _listings(spark: SparkSession, sf: str) -> DataFrame:
    """Feed A with its cell and price per area."""
    return clean.with_listing_ppsf(cells.with_cell(fx.listings_a(spark, sf), "latitude", "longitude"))


def _districts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.districts(spark, sf)


def _plain_date(df: DataFrame, column: str = "sale_date") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


# Sources and sinks ----------------------------------------------------------------------------

@query
def load_sales(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sales-csv")
    tables.write_csv(fx.sales(spark, sf), path)
    return _plain_date(tables.load_data(spark, path, schema=schema.SALES, wrangle_sales=True, add_month=True))


@query
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "listings-csv")
    feed = fx.listings_a(spark, sf)
    tables.write_csv(feed, path)
    return tables.read_csv(spark, path, feed.schema)


@query
def load_polygons(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "districts-geojson")
    districts = _districts(spark, sf).select(F.col("name").alias("NAME"), F.col("rings")[0].alias("outline"))
    geojson.write_features(geojson.with_feature(districts, "outline", ["NAME"], x="x", y="y"), path)
    return polygons.polygon_vertices(geojson.read_polygons(spark, path, "NAME"), "name")


def _page_meta(feed: DataFrame) -> dict:
    total = feed.agg(F.count("*")).scalar()
    return {
        "resultsPerPage": F.lit(PAGE_SIZE),
        "totalPages": F.ceil(total / F.lit(float(PAGE_SIZE))),
        "totalResultCount": total,
    }


def _paged(feed: DataFrame, call: str, position: str, records: str, fields: list) -> DataFrame:
    """Group records into pages of at most ``PAGE_SIZE``, as a landed folder holds them."""
    return (
        feed.groupBy(F.floor(F.col(position) / float(PAGE_SIZE)).alias(call))
        .agg(F.collect_list(F.struct(*fields)).alias(records))
    )


def _land(payload: DataFrame, label: str) -> str:
    path = scratch_path(payload.sparkSession, label)
    payload.write.json(path)
    return path


def _land_pages(spark: SparkSession, sf: str) -> str:
    feed = fx.listings_b(spark, sf)
    payload = _paged(feed, "page", "pos", "results", schema.LISTING_B.fieldNames())
    return _land(payload.withColumns(_page_meta(feed)), "pages")


@query
def normalize_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.normalize_pages(pages.read_pages(spark, _land_pages(spark, sf), schema.PAGES_PAYLOAD))


@query
def normalize_search(spark: SparkSession, sf: str) -> DataFrame:
    feed = fx.listings_a(spark, sf)
    payload = _paged(feed, "api_call_no", "pos", "props", schema.LISTING_A.fieldNames()).withColumns({
        **_page_meta(feed),
        "currentPage": F.lit(1),
        "search_long_lat": text.search_string(
            F.col("api_call_no") % 100 / 1000.0 - 122.5, F.col("api_call_no") % 50 / 100.0 + 47.25),
    })
    return pages.normalize_search(pages.read_pages(spark, _land(payload, "searches"), schema.SEARCH_PAYLOAD))


def _land_places(spark: SparkSession, sf: str) -> str:
    """Place searches; every third place is found by the next search as well."""
    key = F.col("fsq_id")
    found = fx.places(spark, sf).withColumn("again", F.explode(
        F.when(key % 3 == 0, F.array(F.lit(0), F.lit(PAGE_SIZE))).otherwise(F.array(F.lit(0)))
    )).withColumn("at", key + F.col("again"))
    fields = [
        "fsq_id", "name", F.struct("formatted_address").alias("location"),
        F.struct(F.struct("latitude", "longitude").alias("main")).alias("geocodes"),
    ]
    centre = F.struct(
        (F.col("call") % 50 / 100.0 + 47.25).alias("latitude"),
        (F.col("call") % 100 / 1000.0 - 122.5).alias("longitude"),
    )
    circle = F.struct(centre.alias("center"), F.lit(2000).alias("radius"))
    payload = _paged(found, "call", "at", "results", fields).select(
        "results", F.struct(F.struct(circle.alias("circle")).alias("geo_bounds")).alias("context")
    )
    return _land(payload, "places")


@query
def normalize_places(spark: SparkSession, sf: str) -> DataFrame:
    return pages.normalize_places(pages.read_pages(spark, _land_places(spark, sf), schema.PLACES_PAYLOAD))


@query
def geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature text of the cell layer, parsed again to compare its values."""
    path = scratch_path(spark, "cells-geojson")
    geojson.write_features(dashboard.cell_features(dashboard.cell_layer(_listings(spark, sf), exact=True)), path)
    layout = ("type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, "
              "properties struct<median_ppsf:double,cell:bigint,count:bigint>")
    ring = F.col("geometry.coordinates")[0]
    return spark.read.schema(layout).json(path).select(
        "type", F.col("geometry.type").alias("shape"), "properties.median_ppsf", "properties.cell",
        "properties.count", F.size(ring).alias("corners"),
        F.round(ring[0][0], 6).alias("lng"), F.round(ring[0][1], 6).alias("lat"),
    )


@query
def geojson_collections(spark: SparkSession, sf: str) -> DataFrame:
    """FeatureCollection documents of the cell layer, opened again."""
    documents = dashboard.cell_collections(dashboard.cell_layer(_listings(spark, sf), exact=True))
    layout = "type string, features array<struct<properties:struct<median_ppsf:double,cell:bigint,count:bigint>>>"
    return documents.select(F.from_json("document", layout).alias("d")).select(
        "d.type", F.explode("d.features").alias("f")).select("type", "f.properties.*")


# Projections and filters ----------------------------------------------------------------------

@query
def price_per_sqft(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_price_per_sqft(fx.sales(spark, sf)).select("sale_price", "sqft", "price_per_sqft", "lat", "lng")


@query
def listing_ppsf(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_listing_ppsf(fx.listings_a(spark, sf)).select("zpid", "pos", "price", "livingArea", "pricePerSqft")


@query
def baths(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_baths(fx.sales(spark, sf)).select("bath_full", "bath_3qtr", "bath_half", "baths", "lat", "lng")


@query
def year_month(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_year_month(fx.sales(spark, sf)).select("year_month", "sale_price", "lat", "lng")


@query
def filter_sales(spark: SparkSession, sf: str) -> DataFrame:
    chosen = filters.filter_sales(_sales(spark, sf), beds_min=2, beds_max=4, month_min=199601, month_max=199812)
    return chosen.select("beds", "year_month", "sale_price", "lat", "lng")


@query
def filter_sales_open(spark: SparkSession, sf: str) -> DataFrame:
    """Only the lower month is given, and one end of the bedroom range, which then does not apply."""
    chosen = filters.filter_sales(_sales(spark, sf), beds_min=2, month_min=199901)
    return chosen.select("beds", "year_month", "sale_price", "lat", "lng")


@query
def filter_listings(spark: SparkSession, sf: str) -> DataFrame:
    chosen = filters.filter_listings(
        fx.listings_a(spark, sf), beds_min=1, beds_max=3, price_min=460000.7, price_max=490000.2)
    return chosen.select("zpid", "pos", "bedrooms", "price")


@query
def bbox_listings(spark: SparkSession, sf: str) -> DataFrame:
    chosen = filters.filter_listings(fx.listings_a(spark, sf), bounds=AREA)
    return chosen.select("zpid", "pos", "latitude", "longitude")


@query
def bbox_sales(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_sales(_sales(spark, sf), bounds=AREA).select("sale_price", "year_month", "lat", "lng")


@query
def indexable_listings(spark: SparkSession, sf: str) -> DataFrame:
    return cells.indexable(fx.listings_a(spark, sf)).select("zpid", "pos", "cell")


@query
def district_subset(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.polygon_vertices(filters.by_name(_districts(spark, sf), "name", DISTRICTS), "name")


@query
def distinct_sorted(spark: SparkSession, sf: str) -> DataFrame:
    sales = _sales(spark, sf)
    both = [summary.distinct_sorted(sales, c).select(F.lit(c).alias("variable"), F.col(c).alias("value"))
            for c in ("beds", "year_month")]
    return both[0].unionByName(both[1])


# Summaries ------------------------------------------------------------------------------------

@query
def price_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.numerical_summary(fx.listings_a(spark, sf), "price", exact=True)


@query
def slider_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return summary.slider_bounds(summary.numerical_summary(fx.listings_a(spark, sf), "price", exact=True))


@query
def price_quartiles_linear(spark: SparkSession, sf: str) -> DataFrame:
    return summary.linear_quartiles(fx.listings_a(spark, sf), "price").select(
        F.round("lq", 6).alias("lq"), F.round("uq", 6).alias("uq"))


@query
def approx_price_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.approx_quantiles(
        _sales(spark, sf), "price_per_sqft", {"lq": 0.25, "median": 0.5, "uq": 0.75}, by=["year_month"],
        extra=[quantiles.Total("n", "count", "price_per_sqft")],
    )


@query
def approx_rank_error(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each approximate quantile's rank is as near to the wanted one as the sketches promise."""
    probs = {"lq": 0.25, "median": 0.5, "uq": 0.75}
    found = approx_price_quantiles(spark, sf).withColumnRenamed("year_month", "month")
    sales = _sales(spark, sf).select("year_month", "price_per_sqft")
    counted = sales.join(F.broadcast(found), F.col("year_month").eqNullSafe(F.col("month"))).groupBy("year_month", "n").agg(*(
        F.count_if(F.col("price_per_sqft") < F.col(q)).alias(f"below_{q}") for q in probs), *(
        F.count_if(F.col("price_per_sqft") <= F.col(q)).alias(f"upto_{q}") for q in probs))
    slack = F.col("n") / quantiles.SKETCH_ACCURACY + 1
    return counted.select("year_month", "n", *(
        ((F.col(f"below_{q}") <= F.col("n") * p + slack) & (F.col(f"upto_{q}") >= F.col("n") * p - slack)).alias(f"{q}_ok")
        for q, p in probs.items()))


@query
def headline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    listings = filters.filter_listings(fx.listings_a(spark, sf), bounds=AREA)
    sales = filters.filter_sales(_sales(spark, sf), bounds=AREA)
    parts = [
        summary.headline_metrics(listings, "price", exact=True).withColumn("table", F.lit("listings")),
        summary.headline_metrics(sales, "sale_price", exact=True).withColumn("table", F.lit("sales")),
    ]
    return parts[0].unionByName(parts[1]).select(
        "table", "count", F.round("sum", 2).alias("sum"), "median", text.thousands(F.col("median")).alias("shown"))


@query
def map_centre(spark: SparkSession, sf: str) -> DataFrame:
    return summary.map_centre(fx.listings_a(spark, sf)).select(F.round("lat", 8).alias("lat"), F.round("lng", 8).alias("lng"))


# Trends ---------------------------------------------------------------------------------------

@query
def monthly_medians(spark: SparkSession, sf: str) -> DataFrame:
    return trends.monthly_medians(_sales(spark, sf), exact=True)


@query
def monthly_sales(spark: SparkSession, sf: str) -> DataFrame:
    sales = filters.filter_sales(_sales(spark, sf), beds_min=2, beds_max=5, month_min=199601)
    in_area = F.col("lat").between(AREA.south, AREA.north) & F.col("lng").between(AREA.west, AREA.east)
    return trends.monthly_sales(sales, in_area, exact=True)


@query
def recent_sales(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_date(trends.recent_sales(_sales(spark, sf)), "date")


@query
def month_adjustment(spark: SparkSession, sf: str) -> DataFrame:
    return trends.month_adjustment(trends.monthly_medians(_sales(spark, sf), exact=True))


@query
def rebase_sales(spark: SparkSession, sf: str) -> DataFrame:
    return rebasing.rebased_prices(_sales(spark, sf), exact=True).select(
        "year_month", "price_per_sqft", "adjustment", "ppsf_adj", "lat", "lng")


# Feeds and duplicates -------------------------------------------------------------------------

@query
def align_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return clean.align_feeds(*fx.split_feeds(spark, sf))


@query
def flag_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return clean.flag_duplicates(fx.listings_b(spark, sf), "zpid").select("zpid", "pos", "page", "price", "dup")


@query
def duplicate_records(spark: SparkSession, sf: str) -> DataFrame:
    return clean.duplicate_records(fx.listings_b(spark, sf), "zpid").select("zpid", "pos", "page", "price")


@query
def dedupe_listings(spark: SparkSession, sf: str) -> DataFrame:
    both = clean.align_feeds(*fx.split_feeds(spark, sf))
    return clean.first_per_key(both, ["zpid"], ["feed", "pos"])


@query
def dedupe_places(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.normalize_places(pages.read_pages(spark, _land_places(spark, sf), schema.PLACES_PAYLOAD))
    return clean.first_per_key(found, ["fsq_id"], ["search_longitude", "search_latitude"])


@query
def listings_table(spark: SparkSession, sf: str) -> DataFrame:
    table = acquisition.listings_table(*fx.split_feeds(spark, sf))
    return table.withColumn("corners", F.size("boundary")).drop("boundary")


# Cells ----------------------------------------------------------------------------------------

@query
def cell_index(spark: SparkSession, sf: str) -> DataFrame:
    return cells.with_cell(fx.sales(spark, sf), "lat", "lng").select("lat", "lng", "sale_price", "cell")


@query
def cell_parent(spark: SparkSession, sf: str) -> DataFrame:
    indexed = cells.with_cell(fx.sales(spark, sf), "lat", "lng").select("cell").distinct()
    return indexed.withColumn("parent", cell_functions.cell_parent(F.col("cell")))


@query
def cell_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return cells.cell_rollup(cells.with_cell(fx.sales(spark, sf), "lat", "lng"))


@query
def cell_medians(spark: SparkSession, sf: str) -> DataFrame:
    return cells.cell_medians(_listings(spark, sf), exact=True)


@query
def cell_boundary(spark: SparkSession, sf: str) -> DataFrame:
    occupied = cells.indexable(fx.listings_a(spark, sf)).select("cell").distinct()
    ring = cell_functions.cell_boundary(F.col("cell"))
    return occupied.select("cell", F.posexplode(ring).alias("seq", "p")).select(
        "cell", "seq", F.round("p.lng", 6).alias("lng"), F.round("p.lat", 6).alias("lat"))


@query
def zoom_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cells.zoom_clusters(fx.listings_a(spark, sf)).select(
        "zoom", "cluster_x", "cluster_y", "n", F.round("lat", 8).alias("lat"), F.round("lng", 8).alias("lng"))


# Polygons -------------------------------------------------------------------------------------

@query
def points_in_polygons(spark: SparkSession, sf: str) -> DataFrame:
    sales = fx.sales(spark, sf).select("sale_price", "lat", "lng")
    return polygons.points_in_polygons(sales, _districts(spark, sf))


@query
def points_in_region(spark: SparkSession, sf: str) -> DataFrame:
    sales = fx.sales(spark, sf).select("sale_price", "lat", "lng")
    return regions.points_in_region(sales, filters.by_name(_districts(spark, sf), "name", DISTRICTS))


@query
def points_within_buffer(spark: SparkSession, sf: str) -> DataFrame:
    sales = fx.sales(spark, sf).select("sale_price", "lat", "lng")
    return polygons.points_within_buffer(sales, filters.by_name(_districts(spark, sf), "name", DISTRICTS), BUFFER)


@query
def dissolve_outline(spark: SparkSession, sf: str) -> DataFrame:
    return regions.dissolve_outline(fx.squares(spark, sf))


@query
def dissolved_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = regions.dissolve(fx.blocks(spark, sf), side=0.5)
    edges = geometry.polygon_edges(F.col("rings"))
    length = F.aggregate(edges, F.lit(0.0), lambda a, e: a + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
    return parts.select("area", length.alias("length"), F.size("rings").cast("long").alias("n_rings"))


@query
def points_in_dissolved(spark: SparkSession, sf: str) -> DataFrame:
    return regions.points_in_region(fx.lattice(spark, sf), fx.blocks(spark, sf), x="x", y="y", side=0.5)


@query
def region_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.region_bounds(_districts(spark, sf), ["name"])


@query
def grid_points(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.grid_points(polygons.region_bounds(_districts(spark, sf)), 10, 13)


@query
def uniform_points(spark: SparkSession, sf: str) -> DataFrame:
    return regions.uniform_points(_districts(spark, sf), 20, 20)


@query
def search_points(spark: SparkSession, sf: str) -> DataFrame:
    return acquisition.search_points(_districts(spark, sf), DISTRICTS, 10, 13, 3200)


@query
def polygon_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Two-part shapes, a district and its copy one degree east, taken apart again."""
    east = F.transform("rings", lambda ring: F.transform(
        ring, lambda p: F.struct((p["x"] + 1.0).alias("x"), p["y"].alias("y"))))
    shapes = _districts(spark, sf).select("name", F.array("rings", east).alias("parts"))
    parts = polygons.polygon_parts(shapes, "name")
    return parts.select("name", "part", F.size(F.col("rings")[0]).alias("corners"),
                        F.col("rings")[0][0]["x"].alias("x"), F.col("rings")[0][0]["y"].alias("y"))


@query
def polygon_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.polygon_vertices(_districts(spark, sf), "name")


@query
def closed_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Rings without their last point, closed again."""
    open_rings = _districts(spark, sf).withColumn(
        "rings", F.transform("rings", lambda ring: F.slice(ring, F.lit(1), F.size(ring) - 1)))
    return polygons.polygon_vertices(polygons.closed_rings(open_rings), "name")


@query
def simplify_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """District outlines with twenty points per edge, reduced to what the tolerance needs."""
    def dense(ring):
        return F.flatten(F.transform(geometry.ring_edges(ring), lambda e: F.transform(
            F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(
                (e["x1"] + (e["x2"] - e["x1"]) * i / 20.0).alias("x"),
                (e["y1"] + (e["y2"] - e["y1"]) * i / 20.0).alias("y"),
            ))))

    detailed = _districts(spark, sf).withColumn("rings", F.transform("rings", dense))
    return polygons.polygon_vertices(polygons.simplify_polygons(detailed, "name", 0.005), "name")


# Proximity ------------------------------------------------------------------------------------

@query
def listings_near_places(spark: SparkSession, sf: str) -> DataFrame:
    chosen = near.near_places(fx.listings_a(spark, sf), fx.places(spark, sf))
    return chosen.select("zpid", "pos", "price", "propertyType", "bedrooms", "latitude", "longitude")


@query
def nearest_place(spark: SparkSession, sf: str) -> DataFrame:
    return near.nearest_place(fx.listings_a(spark, sf), fx.places(spark, sf), key="pos")


def _search_points(spark: SparkSession, sf: str) -> DataFrame:
    grid = polygons.grid_points(polygons.region_bounds(_districts(spark, sf)), 10, 13)
    return grid.withColumn("api_call_no", F.col("grid_x") * 13 + F.col("grid_y"))


@query
def covered_search_points(spark: SparkSession, sf: str) -> DataFrame:
    found = near.covered_search_points(_search_points(spark, sf), fx.listings_a(spark, sf), "api_call_no")
    return found.select("api_call_no", "x", "y")


@query
def uncovered_search_points(spark: SparkSession, sf: str) -> DataFrame:
    missed = near.covered_search_points(
        _search_points(spark, sf), fx.listings_a(spark, sf), "api_call_no", covered=False)
    return missed.select("api_call_no", "x", "y")


# Surface --------------------------------------------------------------------------------------

def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return written(surface.lattice_samples(_sales(spark, sf), "price_per_sqft"), "samples")


@query
def variogram(spark: SparkSession, sf: str) -> DataFrame:
    return surface.variogram(_samples(spark, sf), max_lag=MAX_LAG).select(
        "bin", F.round("distance", 8).alias("distance"), F.round("semivariance", 4).alias("semivariance"), "pairs")


@query
def kriging_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    samples = _samples(spark, sf)
    return surface.kriging_neighbours(samples, surface.grid_nodes(samples)).select("node", "rank", "i", "j")


@query
def kriging_surface(spark: SparkSession, sf: str) -> DataFrame:
    return rebasing.price_surface(rebasing.rebased_prices(_sales(spark, sf)), max_lag=MAX_LAG)


# Text and labels ------------------------------------------------------------------------------

@query
def listing_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.listing_labels(_listings(spark, sf), LINK_BASE)


@query
def place_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.place_labels(fx.places(spark, sf))


@query
def price_band(spark: SparkSession, sf: str) -> DataFrame:
    return labels.price_band(fx.listings_a(spark, sf)).select(
        "zpid", "pos", F.round("band", 8).alias("band"),
        *[colour.ramp_channel(F.col("band"), [c[i] for c in colour.LISTING_RAMP]).alias(name)
          for i, name in enumerate(("red", "green", "blue"))],
    )


@query
def cell_price_band(spark: SparkSession, sf: str) -> DataFrame:
    return labels.cell_price_band(cells.cell_medians(_listings(spark, sf), exact=True), exact=True).select(
        "cell", F.round("band", 8).alias("band"),
        *[colour.ramp_channel(F.col("band"), [c[i] for c in colour.CELL_RAMP]).alias(name)
          for i, name in enumerate(("red", "green", "blue"))])


@query
def search_strings(spark: SparkSession, sf: str) -> DataFrame:
    lat, lng = F.col("latitude"), F.col("longitude")
    return fx.places(spark, sf).select(
        "fsq_id", text.search_string(lng, lat).alias("lng_lat"), text.search_string(lat, lng).alias("lat_lng"),
        text.search_string(lat, lng, ",").alias("lat_comma_lng"),
    )


@query
def search_area(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.search_area(_districts(spark, sf), "name")


@query
def wkt_coords(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.transform(F.col("rings")[0], lambda p: text.search_string(p["x"], p["y"]))
    wkt = F.concat(F.lit("POLYGON (("), F.array_join(ring, ", "), F.lit("))"))
    return _districts(spark, sf).select("name", F.posexplode(text.wkt_rings(wkt)).alias("ring", "coordinates"))


@query
def extract_coords(spark: SparkSession, sf: str) -> DataFrame:
    pairs = text.extract_pairs(F.col("text"))
    return fx.chat(spark, sf).select("event_id", F.size(pairs).alias("pairs"), pairs[0].alias("first_pair"))


@query
def coords_records(spark: SparkSession, sf: str) -> DataFrame:
    records = text.pairs_to_records(text.extract_pairs(F.col("text")))
    return fx.chat(spark, sf).select("event_id", F.inline(records))


@query
def parse_props(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# Streams --------------------------------------------------------------------------------------

@query
def stream_listings(spark: SparkSession, sf: str) -> DataFrame:
    landed = _land_pages(spark, sf)
    table, checkpoint = scratch_path(spark, "current-listings"), scratch_path(spark, "stream-state")
    listing_stream.ingest_listings(spark, landed, table, checkpoint).awaitTermination()
    layout = pages.normalize_pages(pages.read_pages(spark, landed, schema.PAGES_PAYLOAD)).schema
    return listing_stream.current_listings(spark, table, layout)


def _sales_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The sales table read as a stream."""
    return fx.sales_from(
        spark.readStream.schema(fx.table(spark, sf, "lineitem").schema).parquet(f"{sf}/lineitem.parquet*"))


def _counted_sales(spark: SparkSession, sf: str) -> str:
    table = scratch_path(spark, "value-counts")
    monthly_stream.start_value_counts(_sales_stream(spark, sf), table, scratch_path(spark, "stream-state")).awaitTermination()
    return table


@query
def stream_monthly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_stream.monthly_counts(spark, _counted_sales(spark, sf))


@query
def stream_monthly_medians(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_stream.monthly_medians(spark, _counted_sales(spark, sf))
