"""Monthly series, recent sales, and prices re-based to one month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomarket.operators.clean import with_baths
from geomarket.operators.quantiles import Total, quantiles

# The labels of the two series.
ALL_AREAS, FILTERED_AREA = "All areas", "Filtered area"


def monthly_medians(sales: DataFrame, *, exact: bool = False) -> DataFrame:
    """Per month: median price per area, and the number of sales with a known area."""
    return quantiles(
        sales, "price_per_sqft", {"median_price_per_sqft": 0.5}, exact=exact, by=["year_month"],
        extra=[Total("observations", "count", "sqft")], bounded_groups=True,
    )


def monthly_sales(sales: DataFrame, in_area: Column, *, exact: bool = False) -> DataFrame:
    """The monthly series twice, for all sales and for those in the area.

    Every row carries the labels it counts for, so both series come out of the
    same scan instead of a union of two aggregates.
    """
    labels = F.filter(
        F.array(F.lit(ALL_AREAS), F.when(in_area, F.lit(FILTERED_AREA))), lambda label: label.isNotNull()
    )
    labelled = sales.select("year_month", "price_per_sqft", "sqft", F.explode(labels).alias("location"))
    return quantiles(
        labelled, "price_per_sqft", {"median_price_per_sqft": 0.5}, exact=exact, by=["year_month", "location"],
        extra=[Total("observations", "count", "sqft")], bounded_groups=True,
    ).orderBy("year_month", "location")


def recent_sales(sales: DataFrame, n: int = 20) -> DataFrame:
    """The latest sales under report names; ties fall back on the remaining columns."""
    report = with_baths(sales).select(
        F.col("sale_date").alias("date"), F.col("sale_price").alias("price"), "beds", "sqft", "price_per_sqft",
        F.col("year_built").alias("built"), "lat", "lng", "baths",
    )
    ties = [F.col(c).asc_nulls_last() for c in report.columns if c != "date"]
    return report.orderBy(F.col("date").desc_nulls_last(), *ties).limit(n)


def month_adjustment(monthly: DataFrame, *, min_observations: int = 0) -> DataFrame:
    """Multiplier that brings each month's median to that of the latest month.

    ``min_observations`` skips base months with too few sales; the default takes
    the latest one whatever its size.
    """
    latest = monthly.where(F.col("observations") >= min_observations).agg(
        F.max_by("median_price_per_sqft", "year_month").alias("base")
    )
    return monthly.withColumn(
        "adjustment", F.try_divide(latest.select("base").scalar(), F.col("median_price_per_sqft"))
    )


def rebase_sales(sales: DataFrame, adjustment: DataFrame) -> DataFrame:
    """Sales with ``ppsf_adj``; months without a multiplier row drop out.

    The multiplier table has one row per calendar month (a date column spans at
    most 120,000 of them), so it is always small enough to broadcast.
    """
    months = F.broadcast(adjustment.select("year_month", "adjustment"))
    return sales.join(months, "year_month").withColumn("ppsf_adj", F.col("price_per_sqft") * F.col("adjustment"))
