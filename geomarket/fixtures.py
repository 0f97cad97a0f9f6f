"""The input tables of the registered queries, derived from the given star schema.

Each function mirrors one definition in ``FIXTURES.md``; the SQL there is what
the oracle runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(mixed: Column, modulus: int, origin: float, span: float) -> Column:
    """Place rows on a fixed lattice of ``modulus`` steps inside ``span`` degrees."""
    return F.lit(origin) + (mixed % modulus) / F.lit(float(modulus)) * F.lit(span)


def _latitude(key: Column) -> Column:
    return _spread(key * 7919, 1009, 47.2, 0.6)


def _longitude(key: Column) -> Column:
    return _spread(key * 104729, 997, -122.5, 0.8)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_from(table(spark, sf_dir, "lineitem"))


def sales_from(lineitem: DataFrame) -> DataFrame:
    order, part, supp, line = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    quantity = F.col("l_quantity")
    return lineitem.select(
        F.col("l_shipdate").cast("date").alias("sale_date"),
        F.col("l_extendedprice").alias("sale_price"),
        line.alias("beds"),
        F.when(quantity == 50, 0.0).when(quantity != 49, quantity * 40.0).alias("sqft"),
        (supp % 4).cast("int").alias("bath_full"),
        F.when(part % 50 != 0, (part % 2).cast("int")).alias("bath_half"),
        (order % 2).cast("int").alias("bath_3qtr"),
        (part % 122 + 1900).cast("int").alias("year_built"),
        _spread(order * 7919 + line * 104729 + part * 1299709 + supp * 15485863, 100003, 47.2, 0.6).alias("lat"),
        _spread(order * 32452843 + line * 49979687 + part * 86028121 + supp * 611953, 100003, -122.5, 0.8)
        .alias("lng"),
    )


def _listings(parts: DataFrame, repeated: Column, surcharge: float) -> DataFrame:
    """Feed rows; parts matching ``repeated`` appear twice."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return (
        parts.withColumn("rep", F.explode(F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            key.alias("zpid"),
            (F.col("p_retailprice") * 500.0 + size * 1000.0 + surcharge).alias("price"),
            (size % 6).cast("int").alias("bedrooms"),
            (size % 4).cast("int").alias("bathrooms"),
            F.when(size % 10 == 0, 0.0).otherwise(size * 40.0).alias("livingArea"),
            F.concat("p_type", F.lit("_HOME")).alias("propertyType"),
            F.lit("FOR_SALE").alias("listingStatus"),
            F.when(key % 97 != 0, _latitude(key)).alias("latitude"),
            _longitude(key).alias("longitude"),
            F.concat(F.lit("https://img.example/"), key.cast("string")).alias("imgSrc"),
            (key * 2 + F.col("rep")).alias("pos"),
            "rep",
        )
    )


def listings_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a listing of the first feed."""
    feed = _listings(table(spark, sf_dir, "part"), F.col("p_partkey") % 20 == 0, 0.0)
    return feed.withColumn("api_call_no", (F.col("zpid") % 13 + F.col("rep")).cast("int")).drop("rep")


def listings_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a listing of the second feed."""
    feed = _listings(table(spark, sf_dir, "part"), F.col("p_partkey") % 25 == 9, 1.0)
    return (
        feed.withColumn("page", (F.col("zpid") % 28 + 1 + F.col("rep")).cast("int"))
        .drop("rep")
        .withColumnsRenamed({"propertyType": "homeType", "listingStatus": "homeStatus"})
    )


def split_feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two feeds that share some listings: what merging them is about. Together they hold every part."""
    digit = F.col("zpid") % 10
    return listings_a(spark, sf_dir).where(digit < 7), listings_b(spark, sf_dir).where(digit >= 4)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("fsq_id"),
        F.col("s_name").alias("name"),
        F.concat(key.cast("string"), F.lit(" Example St, NATION_"), F.col("s_nationkey").cast("string"))
        .alias("formatted_address"),
        _latitude(key).alias("latitude"),
        _longitude(key).alias("longitude"),
    )


def _ring(corners: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notched polygon per nation on a 5 x 5 layout."""
    key = F.col("n_nationkey")
    west = F.lit(-122.5) + F.lit(0.16) * (key % 5)
    south = F.lit(47.2) + F.lit(0.12) * F.floor(key / F.lit(5.0))
    # Corner offsets of the notched outline, as fractions of the district box.
    outline = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.4), (0.0, 1.0), (0.0, 0.0)]
    corners = [(west + F.lit(ax) * 0.16, south + F.lit(ay) * 0.12) for ax, ay in outline]
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.array(_ring(corners)).alias("rings")
    )


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit squares that share exact edges, one missing in the middle."""
    key = F.col("n_nationkey")
    west, south = key % 5, F.floor(key / F.lit(5.0))
    outline = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    corners = [((west + ax).cast("double"), (south + ay).cast("double")) for ax, ay in outline]
    return (
        table(spark, sf_dir, "nation").where(key != 12)
        .select(key.alias("k"), F.array(_ring(corners)).alias("rings"))
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that overlap, repeat, meet in T-junctions and have holes, on a lattice of quarters."""
    key = F.col("n_nationkey")
    kind = key % 4
    west, south = key % 5 + F.when(kind == 2, 0.5).otherwise(0.0), F.floor(key / F.lit(5.0)).cast("double")
    wide, high = F.when(kind == 1, 1.5).when(kind == 2, 0.5).otherwise(1.0), F.when(kind == 2, 0.75).otherwise(1.0)

    def box(low: Column, x: Column, y: Column) -> Column:
        return _ring([(west + low, south + low), (west + x, south + low), (west + x, south + y), (west + low, south + y),
                      (west + low, south + low)])

    outer, hole = box(F.lit(0.0), wide, high), box(F.lit(0.25), F.lit(0.75), F.lit(0.75))
    return table(spark, sf_dir, "nation").where(key != 12).select(
        key.alias("k"), F.when(kind == 3, F.array(outer, hole)).otherwise(F.array(outer))
        .cast("array<array<struct<x:double,y:double>>>").alias("rings"),
        F.explode(F.when(key % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per part, on eighths: inside the blocks, on their borders, and beside them."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key, (key % 53 / 8.0 - 0.25).alias("x"), (F.floor(key / F.lit(53.0)) % 45 / 8.0 - 0.25).alias("y"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        "event_type", F.lit(" near [47."), (F.col("event_id") % 900 + 100).cast("string"),
        F.lit(", -122."), (F.col("user_id") % 400 + 100).cast("string"), F.lit("] please"),
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))
