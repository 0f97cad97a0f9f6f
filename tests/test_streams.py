import pytest
from pyspark.sql import functions as F

from geomarket import fixtures as fx
from geomarket import schema
from geomarket.operators import clean, trends
from geomarket.sources import pages
from geomarket.streaming import listings as listing_stream
from geomarket.streaming import monthly as monthly_stream


def land(spark, sf_dir, path, files):
    feed = fx.listings_b(spark, sf_dir)
    payload = (
        feed.groupBy(F.floor(F.col("pos") / 41.0).alias("page"))
        .agg(F.collect_list(F.struct(*schema.LISTING_B.fieldNames())).alias("results"))
        .withColumns({"resultsPerPage": F.lit(41), "totalPages": F.lit(1).cast("long"), "totalResultCount": F.lit(1).cast("long")})
    )
    payload.repartition(files, F.rand(7)).write.json(path)


def rows(df):
    return sorted(tuple(sorted(r.asDict().items(), key=lambda item: item[0])) for r in df.collect())


@pytest.mark.parametrize("compact_every", [2, 50])
def test_many_batches_equal_one_batch(spark, small_dir, tmp_path, compact_every):
    landed, table = f"{tmp_path}/pages", f"{tmp_path}/table"
    land(spark, small_dir, landed, 5)

    def ingest():
        listing_stream.ingest_listings(
            spark, landed, table, f"{tmp_path}/state", files_per_batch=1, compact_every=compact_every).awaitTermination()

    ingest()
    records = pages.normalize_pages(pages.read_pages(spark, landed, schema.PAGES_PAYLOAD))
    expected = rows(clean.first_per_key(records, ["zpid"], listing_stream.ORDER))
    assert rows(listing_stream.current_listings(spark, table, records.schema)) == expected
    assert listing_stream._folded_upto(spark, table) == (3 if compact_every == 2 else -1)
    # A restart finds nothing new.
    ingest()
    assert rows(listing_stream.current_listings(spark, table, records.schema)) == expected


def test_a_retried_batch_changes_nothing(spark, small_dir, tmp_path):
    landed, table = f"{tmp_path}/pages", f"{tmp_path}/table"
    land(spark, small_dir, landed, 2)
    records = pages.normalize_pages(pages.read_pages(spark, landed, schema.PAGES_PAYLOAD))
    expected = rows(clean.first_per_key(records, ["zpid"], listing_stream.ORDER))
    for batch_id in (0, 0, 1, 1):
        listing_stream.store_batch(records.where(f"page % 2 = {batch_id}"), batch_id, table, compact_every=2)
    assert rows(listing_stream.current_listings(spark, table, records.schema)) == expected


def test_a_fold_that_did_not_finish_is_ignored(spark, small_dir, tmp_path):
    landed, table = f"{tmp_path}/pages", f"{tmp_path}/table"
    land(spark, small_dir, landed, 2)
    records = pages.normalize_pages(pages.read_pages(spark, landed, schema.PAGES_PAYLOAD))
    expected = rows(clean.first_per_key(records, ["zpid"], listing_stream.ORDER))
    listing_stream.store_batch(records, 0, table)
    records.limit(3).write.parquet(f"{table}/folded/upto=0")
    assert rows(listing_stream.current_listings(spark, table, records.schema)) == expected
    listing_stream.compact(spark, table, records.schema, 0)
    assert rows(listing_stream.current_listings(spark, table, records.schema)) == expected


def test_empty_table(spark, tmp_path):
    layout = spark.createDataFrame([], "zpid long, page long, pos long").schema
    assert listing_stream.current_listings(spark, f"{tmp_path}/none", layout).count() == 0


def stream_of(spark, path, sales):
    return spark.readStream.schema(sales.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_daily_counts_over_batches(spark, small_dir, tmp_path, settings, zone):
    settings(session__timeZone=zone)
    sales = fx.sales(spark, small_dir)
    sales.repartition(4, F.rand(3)).write.parquet(f"{tmp_path}/sales")
    query = monthly_stream.start_daily_counts(
        stream_of(spark, f"{tmp_path}/sales", sales), f"{tmp_path}/days", f"{tmp_path}/state", lateness="4000 days")
    query.awaitTermination()
    expected = clean.with_year_month(sales).groupBy("year_month").agg(
        F.count("*").alias("sales"), F.count("sqft").alias("observations"))
    assert rows(monthly_stream.daily_totals(spark, f"{tmp_path}/days")) == rows(expected)
    assert len(query.recentProgress) >= 4


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    for name, days in (("a", ["2021-03-01", "2021-03-02"]), ("b", ["2021-03-20"]), ("c", ["2021-01-01", "2021-03-19"])):
        batch = spark.createDataFrame([(d, 1.0) for d in days], "sale_date string, sqft double")
        batch.withColumn("sale_date", F.to_date("sale_date")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/sales")
    sales = spark.read.parquet(f"{tmp_path}/sales")
    query = monthly_stream.start_daily_counts(
        stream_of(spark, f"{tmp_path}/sales", sales), f"{tmp_path}/days", f"{tmp_path}/state", lateness="5 days")
    query.awaitTermination()
    got = {r["year_month"]: r["sales"] for r in monthly_stream.daily_totals(spark, f"{tmp_path}/days").collect()}
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert got == {202103: 4}
    assert dropped == 1


def by_month(df):
    return {r["year_month"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("fold_every", [3, 100])
def test_counts_and_medians_over_batches(spark, small_dir, tmp_path, fold_every):
    """Undated and late sales included; each sale is read once."""
    sales = fx.sales(spark, small_dir).withColumn("sale_date", F.expr("if(year_built % 7 = 0, null, sale_date)"))
    sales.repartition(7, F.rand(3)).write.parquet(f"{tmp_path}/sales")
    query = monthly_stream.start_value_counts(
        stream_of(spark, f"{tmp_path}/sales", sales), f"{tmp_path}/counts", f"{tmp_path}/state", fold_every=fold_every)
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == sales.count()
    assert len(query.recentProgress) >= 7
    expected = by_month(clean.with_year_month(sales).groupBy("year_month").agg(
        F.count("*").alias("sales"), F.count("sqft").alias("observations")))
    assert None in expected
    assert by_month(monthly_stream.monthly_counts(spark, f"{tmp_path}/counts")) == expected
    medians = trends.monthly_medians(clean.with_year_month(clean.with_price_per_sqft(sales)), exact=True)
    assert by_month(monthly_stream.monthly_medians(spark, f"{tmp_path}/counts")) == by_month(medians)


def test_a_retried_batch_counts_once(spark, small_dir, tmp_path):
    sales = fx.sales(spark, small_dir)
    sales.repartition(4, F.rand(3)).write.parquet(f"{tmp_path}/sales")
    monthly_stream.start_value_counts(
        stream_of(spark, f"{tmp_path}/sales", sales), f"{tmp_path}/counts", f"{tmp_path}/state", fold_every=2).awaitTermination()
    before = by_month(monthly_stream.monthly_counts(spark, f"{tmp_path}/counts"))
    # What a batch that ran again would do: its own folder, then the fold that ends with it.
    again = spark.read.schema(monthly_stream._COUNTS).parquet(f"{tmp_path}/counts/batches/batch=3")
    monthly_stream._added_up(monthly_stream._parts(spark, f"{tmp_path}/counts", 3)).write.mode("overwrite").parquet(
        f"{tmp_path}/counts/folds/upto=3")
    assert again.count() > 0 and by_month(monthly_stream.monthly_counts(spark, f"{tmp_path}/counts")) == before
