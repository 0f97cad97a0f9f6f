import json

import pytest
from pyspark.sql import functions as F

from geomarket import fixtures as fx
from geomarket import schema
from geomarket.operators import polygons
from geomarket.plans import acquisition, dashboard
from geomarket.operators import cells, clean
from geomarket.session import scratch_path
from geomarket.sources import geojson, pages, tables


def test_load_data(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(
        "sale_date,sale_price,beds,sqft,bath_full,bath_half,bath_3qtr,year_built,lat,lng\n"
        "2021-05-06,100.0,2,50,1,0,1,1990,47.5,-122.1\n2021-06-07,100.0,2,0,1,,1,1990,,\n")
    for declared in (schema.SALES, None):
        df = tables.load_data(spark, str(tmp_path / "sales.csv"), schema=declared, cell_from=("lat", "lng"),
                              wrangle_sales=True, add_month=True)
        assert df.columns == [*schema.SALES_REPORT_COLUMNS, "cell", "year_month"]
        first, second = df.orderBy("sale_date").collect()
        assert (first["price_per_sqft"], first["year_month"]) == (2.0, 202105)
        assert first["cell"] is not None
        assert (second["price_per_sqft"], second["cell"], second["bath_half"]) == (None, None, None)


def test_clustered_parquet_spreads_a_hot_key(spark, tmp_path, settings):
    settings(adaptive__coalescePartitions__enabled="false")
    df = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 202101).otherwise(202000 + F.col("id") % 12).alias("year_month"),
        (F.col("id") % 2).alias("same"))
    path = f"{tmp_path}/clustered"
    tables.write_parquet(df, path, ["year_month"])
    stored = spark.read.parquet(path).withColumn("file", F.input_file_name())
    assert stored.count() == 60_000
    assert stored.where("year_month = 202101").select("file").distinct().count() > 1
    spans = stored.groupBy("file").agg(F.min("year_month").alias("low"), F.max("year_month").alias("high")).collect()
    assert all(r["high"] - r["low"] < 101 for r in spans)
    assert spark.read.parquet(path).groupBy("year_month").count().exceptAll(df.groupBy("year_month").count()).isEmpty()


def test_polygon_documents(spark, tmp_path):
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]
    shift = [[x + 5, y] for x, y in square]
    features = [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square, shift]}, "properties": {"NAME": "one", "n": 3}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [shift]]}, "properties": {"NAME": "two"}},
        {"type": "Feature", "geometry": None, "properties": {"NAME": "none"}},
    ]
    (tmp_path / "whole.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "lines.geojsonl").write_text("\n".join(json.dumps(f) for f in features))
    whole = geojson.read_polygons(spark, str(tmp_path / "whole.geojson"), "NAME", lines=False)
    lines = geojson.read_polygons(spark, str(tmp_path / "lines.geojsonl"), "NAME")
    got = sorted((r["name"], r["part"], len(r["rings"])) for r in whole.collect())
    assert got == [("one", 0, 2), ("two", 0, 1), ("two", 1, 1)]
    assert sorted(map(str, whole.collect())) == sorted(map(str, lines.collect()))
    (tmp_path / "one-line.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    one_line = geojson.read_polygons(spark, str(tmp_path / "one-line.geojson"), "NAME")
    assert sorted(map(str, one_line.collect())) == sorted(map(str, lines.collect()))
    assert {r["name"]: r["properties"] for r in lines.collect()}["one"] == {"NAME": "one", "n": "3"}
    assert polygons.polygon_vertices(whole.where("part = 1"), "name").count() == 4


@pytest.mark.parametrize("record", [
    '{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {}}',
    '{"type": "Topology", "objects": {}}', '{"type": "FeatureCollection",', "{}"])
def test_other_records_fail_the_read(spark, tmp_path, record):
    (tmp_path / "odd.geojsonl").write_text(record)
    with pytest.raises(Exception, match="not a|MALFORMED|Malformed|FAILFAST"):
        geojson.read_polygons(spark, str(tmp_path / "odd.geojsonl"), "NAME").collect()


def test_collection_documents(spark, small_dir):
    listings = clean.with_listing_ppsf(cells.with_cell(fx.listings_a(spark, small_dir), "latitude", "longitude"))
    layer = dashboard.cell_layer(listings)
    documents = [json.loads(r["document"]) for r in dashboard.cell_collections(layer).collect()]
    assert {d["type"] for d in documents} == {"FeatureCollection"}
    features = [f for d in documents for f in d["features"]]
    assert len(features) == layer.count() > 0
    ring = features[0]["geometry"]["coordinates"][0]
    assert features[0]["geometry"]["type"] == "Polygon" and len(ring) == 7 and ring[0] == ring[-1]
    assert set(features[0]["properties"]) == {"median_ppsf", "cell", "count"}


def test_empty_pages_yield_no_records(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"page":1,"results":[],"resultsPerPage":41,"totalPages":0,"totalResultCount":0}\n'
        '{"page":2,"resultsPerPage":41}\n'
        '{"page":3,"results":[{"zpid":9,"price":1.5,"pos":4}],"resultsPerPage":41,"totalPages":1,"totalResultCount":1}\n')
    rows = pages.normalize_pages(pages.read_pages(spark, str(tmp_path), schema.PAGES_PAYLOAD)).collect()
    assert [(r["zpid"], r["price"], r["page"], r["totalPages"], r["homeType"]) for r in rows] == [(9, 1.5, 3, 1, None)]


def test_search_points(spark, small_dir):
    points = acquisition.search_points(fx.districts(spark, small_dir), ["NATION_1", "NATION_2"], 10, 13, 2000)
    row = points.first()
    assert row["lat_lng"].split(",")[0] == row["lng_lat"].split(" ")[1]
    assert points.where(F.col("name").isin("NATION_1", "NATION_2")).count() == points.count() > 0


class Session:
    """Only the settings of a session."""

    def __init__(self, **settings):
        self.settings = settings
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


def test_scratch_folder():
    shared = Session(spark_master="spark://head:7077", spark_checkpoint_dir="hdfs://shared/checkpoints/")
    a, b = scratch_path(shared, "x"), scratch_path(shared, "x")
    assert a != b and a.startswith("hdfs://shared/checkpoints/x-")
    assert scratch_path(Session(spark_master="local[4]"), "x").startswith("/")
    with pytest.raises(ValueError):
        scratch_path(Session(spark_master="spark://head:7077"), "x")
