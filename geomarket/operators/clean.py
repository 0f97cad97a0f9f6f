"""Cleaning: derived columns, schema alignment, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomarket import schema
from geomarket.functions import text

# What each kind of bathroom counts for.
BATH_WEIGHTS = {"bath_full": 1.0, "bath_half": 0.5, "bath_3qtr": 1.0}


def with_price_per_sqft(sales: DataFrame, price: str = "sale_price", area: str = "sqft") -> DataFrame:
    """Ratio column; null where the area is zero or missing."""
    return sales.withColumn("price_per_sqft", F.try_divide(F.col(price), F.col(area)))


def with_year_month(df: DataFrame, date: str = "sale_date") -> DataFrame:
    return df.withColumn("year_month", text.year_month(F.col(date)))


def prepare_sales(sales: DataFrame, columns: Sequence[str] = tuple(schema.SALES_REPORT_COLUMNS)) -> DataFrame:
    """Add the ratio, then keep a fixed list of columns in a fixed order."""
    return with_price_per_sqft(sales).select(*columns)


def with_listing_ppsf(listings: DataFrame) -> DataFrame:
    """Price per area, only where the area is positive."""
    area = F.col("livingArea")
    return listings.withColumn("pricePerSqft", F.when(area > 0, F.col("price") / area))


def with_baths(sales: DataFrame) -> DataFrame:
    """Weighted bath count; any missing part makes it null."""
    weighted = [F.col(column) * weight for column, weight in BATH_WEIGHTS.items()]
    return sales.withColumn("baths", reduce(add, weighted))


def align_union(first: DataFrame, second: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Stack two feeds on the columns they share after renaming the second's."""
    second = second.withColumnsRenamed(dict(renames))
    common = [c for c in first.columns if c in set(second.columns)]
    return first.select(*common).unionByName(second.select(*common))


def align_feeds(feed_a: DataFrame, feed_b: DataFrame) -> DataFrame:
    """Both listing feeds under one schema, with ``feed`` to order them."""
    return align_union(
        feed_a.withColumn("feed", F.lit(1)),
        feed_b.withColumn("feed", F.lit(2)),
        {"homeType": "propertyType", "homeStatus": "listingStatus"},
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row of each key.

    The engine turns ``row_number = 1`` into a per-task limit ahead of the
    shuffle, so even a key that holds a third of the rows sends one row per task.
    ``order`` must be total within a key for the result not to depend on partitioning.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def flag_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Mark every row whose key occurs more than once.

    Keys are counted with a map-side combine, and only the repeated ones are
    joined back, rather than counted in a window that would bring a hot key's
    rows into one task; the adaptive skew join splits such a key's rows.
    """
    repeated = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    return (
        df.join(repeated, F.col(key).eqNullSafe(F.col("_key")), "left")
        .withColumn("dup", F.col("_n").isNotNull()).drop("_key", "_n")
    )


def duplicate_records(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs more than once, ordered by it."""
    return flag_duplicates(df, key).where("dup").drop("dup").orderBy(key)
