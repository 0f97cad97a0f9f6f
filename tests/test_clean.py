import datetime as dt

from pyspark.sql import functions as F

from geomarket.functions import colour, text
from geomarket.operators import clean, filters, labels, summary, trends
from geomarket.operators.filters import Bounds


def test_ratio_with_zero_and_missing_area(spark):
    df = spark.createDataFrame([(100.0, 0.0), (100.0, None), (100.0, 50.0)], "sale_price double, sqft double")
    assert [r["price_per_sqft"] for r in clean.with_price_per_sqft(df).collect()] == [None, None, 2.0]


def test_baths_need_every_part(spark):
    df = spark.createDataFrame([(2, 1, 1), (2, None, 1)], "bath_full int, bath_half int, bath_3qtr int")
    assert [r["baths"] for r in clean.with_baths(df).collect()] == [3.5, None]


def test_month_key(spark):
    df = spark.createDataFrame([(dt.date(2021, 3, 9),), (None,)], "sale_date date")
    got = clean.with_year_month(df)
    assert [r["year_month"] for r in got.collect()] == [202103, None]
    assert got.schema["year_month"].dataType.simpleString() == "int"


def test_align_keeps_the_common_columns_in_order(spark):
    a = spark.createDataFrame([(1, "x", 2.0)], "id int, kind string, only_a double")
    b = spark.createDataFrame([(5.0, "y", 2)], "only_b double, homeKind string, id int")
    got = clean.align_union(a, b, {"homeKind": "kind"})
    assert got.columns == ["id", "kind"]
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y")]


def test_first_per_key_ignores_partitioning(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("key"), (-F.col("id")).alias("pos"))
    results = {
        tuple(sorted(map(tuple, clean.first_per_key(rows.repartition(n), ["key"], ["pos"]).collect()))) for n in (1, 3, 8)}
    assert len(results) == 1


def test_flag_marks_every_member_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    got = {r["v"]: r["dup"] for r in clean.flag_duplicates(df, "k").collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": True}


def test_ranges(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "n int")

    def kept(frame):
        return sorted(r["n"] or 0 for r in frame.collect())

    assert kept(filters.closed_range(df, "n", 1.9, 2.9)) == [1, 2]
    assert kept(filters.closed_range(df, "n", 2, None)) == [0, 1, 2, 3]
    assert kept(filters.open_range(df, "n", low=2)) == [2, 3]
    assert kept(filters.open_range(df, "n", high=2)) == [1, 2]


def test_bounds_include_their_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 3.1), (None, 1.0)], "latitude double, longitude double")
    assert filters.filter_listings(df, bounds=Bounds(1.0, 1.0, 2.0, 3.0)).count() == 2
    assert filters.filter_listings(df).count() == 4


def test_summary_and_slider(spark):
    df = spark.createDataFrame([(float(v),) for v in (25_000, 35_000, 114_999, 1_000_000)], "price double")
    got = summary.numerical_summary(df, "price", exact=True).first()
    assert (got["min"], got["max"], got["lq"], got["uq"]) == (25_000, 1_000_000, 25_000, 114_999)
    slider = summary.slider_bounds(summary.numerical_summary(df, "price", exact=True)).first()
    assert tuple(slider) == (20_000, 1_000_000, 20_000, 110_000)
    ends = summary.slider_bounds(summary.numerical_summary(df, "price", with_quartiles=False)).first()
    assert tuple(ends) == (20_000, 1_000_000, 20_000, 1_000_000)


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "price double")
    for exact in (True, False):
        row = summary.headline_metrics(empty, "price", exact=exact).first()
        assert (row["count"], row["sum"], row["median"]) == (0, None, None)


def test_distinct_puts_null_last(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (3,)], "n int")
    assert [r["n"] for r in summary.distinct_sorted(df, "n").collect()] == [1, 3, None]


def test_map_centre(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, None)], "latitude double, longitude double")
    assert tuple(summary.map_centre(df).first()) == (2.0, 10.0)
    assert tuple(summary.map_centre(df, at=(47.5, -122.0)).first()) == (47.5, -122.0)


def sales(spark, rows):
    return clean.with_price_per_sqft(spark.createDataFrame(rows, "year_month int, sale_price double, sqft double"))


def test_rebasing_leaves_the_latest_month_alone(spark):
    df = sales(spark, [(202101, 100.0, 1.0), (202101, 300.0, 1.0), (202102, 400.0, 1.0), (202103, 50.0, 0.0)])
    monthly = trends.monthly_medians(df, exact=True)
    by_month = {r["year_month"]: r for r in trends.month_adjustment(monthly.where("year_month < 202103")).collect()}
    assert by_month[202102]["adjustment"] == 1.0
    assert by_month[202101]["adjustment"] == 4.0
    prices = trends.rebase_sales(df, trends.month_adjustment(monthly.where("year_month < 202103"))).collect()
    assert sorted(r["ppsf_adj"] for r in prices) == [400.0, 400.0, 1200.0]


def test_thin_base_month_can_be_skipped(spark):
    df = sales(spark, [(202101, 100.0, 1.0)] * 5 + [(202102, 400.0, 1.0)])
    monthly = trends.monthly_medians(df, exact=True)
    rows = trends.month_adjustment(monthly, min_observations=3).collect()
    assert {r["year_month"]: r["adjustment"] for r in rows} == {202101: 1.0, 202102: 0.25}


def test_series_for_all_and_for_the_area(spark):
    df = sales(spark, [(202101, 100.0, 1.0), (202101, 300.0, None), (202102, 400.0, 2.0)])
    for exact in (True, False):
        got = sorted(map(tuple, trends.monthly_sales(df, F.col("year_month") == 202101, exact=exact).select(
            "year_month", "location", "median_price_per_sqft", "observations").collect()))
        assert got == [(202101, "All areas", 100.0, 1), (202101, "Filtered area", 100.0, 1), (202102, "All areas", 200.0, 1)]


def test_the_series_is_in_month_order(spark):
    df = sales(spark, [(m, 100.0, 1.0) for m in (202109, 199803, 202101, 200002, 202012)])
    got = [(r["year_month"], r["location"]) for r in trends.monthly_sales(df, F.lit(True), exact=True).collect()]
    assert got == sorted(got) and len(got) == 10


def test_duplicate_records_are_ordered(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (3, "c"), (2, "d"), (1, "e"), (None, "f"), (None, "g")], "k int, v string")
    got = [(r["k"], r["v"]) for r in clean.duplicate_records(df, "k").collect()]
    assert [k for k, _ in got] == [None, None, 1, 1, 3, 3] and {v for _, v in got} == set("bceafg")


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.five_places(F.lit(47.2)).alias("a"), text.five_places(F.lit(-122.123456)).alias("b"),
        text.five_places(F.lit(3.0)).alias("c"),
        text.wkt_rings(F.lit("POLYGON ((1 2, 3 4, 1 2))")).alias("wkt"),
        text.wkt_rings(F.lit("MULTIPOLYGON (((0 0, 4 0, 0 4),( 1 1, 2 1, 1 2 )), ((5 5, 6 5, 5 6)))")).alias("parts"),
        text.title_case(F.lit("3BR_O'NEIL_HOME")).alias("home"),
        text.extract_pairs(F.lit("at [47.6, -122.3] and [1, 2], not [x, 3]")).alias("pairs"),
        text.pairs_to_records(F.array(F.lit("47.6, -122.3"))).alias("records"),
        text.title_case(F.lit("SINGLE_FAMILY")).alias("title"),
        text.thousands(F.lit(1234567.5)).alias("money"), text.whole(F.lit(2.5)).alias("even"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == ("47.2", "-122.12346", "3.0")
    assert row["wkt"] == ["1 2, 3 4, 1 2"]
    assert row["parts"] == ["0 0, 4 0, 0 4", "1 1, 2 1, 1 2", "5 5, 6 5, 5 6"]
    assert row["home"] == "3Br O'Neil Home"
    assert row["pairs"] == ["47.6, -122.3", "1, 2"]
    assert row["records"][0].asDict() == {"lat": 47.6, "lng": -122.3}
    assert (row["title"], row["money"], row["even"]) == ("Single Family", "1,234,568", "2")


def test_colour_ramp(spark):
    values = spark.createDataFrame([(-5.0,), (0.0,), (5.0,), (10.0,), (99.0,), (None,)], "v double")
    position = colour.ramp_position(F.col("v"), F.lit(0.0), F.lit(10.0))
    got = [r[0] for r in values.select(colour.ramp_hex(position, colour.CELL_RAMP)).collect()]
    assert got[:5] == ["#008000", "#008000", "#ffff00", "#ff0000", "#ff0000"]
    flat = colour.ramp_position(F.col("v"), F.lit(1.0), F.lit(1.0))
    assert [r[0] for r in values.select(flat).collect()] == [0.0] * 5 + [None]


def test_price_band_uses_the_quartiles(spark):
    df = spark.createDataFrame([(float(v),) for v in range(5)], "price double")
    got = [(r["price"], r["band"], r["colour"]) for r in labels.price_band(df).orderBy("price").collect()]
    assert [b for _, b, _ in got] == [0.0, 0.0, 0.5, 1.0, 1.0]
    assert (got[0][2], got[-1][2]) == ("#ffdf8e", "#c65824")
