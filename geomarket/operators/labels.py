"""Text and colour columns for cards, tooltips and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomarket.functions import colour, text
from geomarket.operators.summary import linear_quartiles, numerical_summary


def listing_labels(listings: DataFrame, link_base: str) -> DataFrame:
    """Headline, detail line, property type and detail link per listing."""
    return listings.select(
        "zpid",
        text.title_case(F.col("propertyType")).alias("type_label"),
        F.concat(F.lit("$"), text.thousands(F.col("price"))).alias("price_label"),
        F.concat(
            F.lit("Beds: "), text.whole(F.col("bedrooms")), F.lit(" Baths: "), text.whole(F.col("bathrooms"))
        ).alias("rooms_label"),
        F.concat(F.lit("Living Area: "), text.thousands(F.col("livingArea"))).alias("area_label"),
        F.concat(F.lit("$/SqFt: "), text.whole(F.col("pricePerSqft"))).alias("ppsf_label"),
        F.concat(F.lit(link_base), F.col("zpid").cast("bigint").cast("string"), F.lit("_zpid")).alias("link"),
        F.col("imgSrc").alias("image"),
    )


def place_labels(places: DataFrame) -> DataFrame:
    """Name alone for the tooltip, name and address for the card."""
    return places.select(
        "fsq_id", F.col("name").alias("tooltip"),
        F.concat_ws("\n", "name", "formatted_address").alias("card"), "latitude", "longitude",
    )


def price_band(listings: DataFrame, column: str = "price",
               ramp: list[tuple[int, int, int]] = colour.LISTING_RAMP, *, linear: bool = True,
               exact: bool = True) -> DataFrame:
    """Marker colour: position between the quartiles of the column, on a colour ramp.

    Listings take quartiles interpolated between neighbours, ``linear=False`` takes elements
    of the column; ``exact=False`` is one pass with sketches, which know elements only.
    """
    if linear and exact:
        quartiles = linear_quartiles(listings, column)
    else:
        quartiles = numerical_summary(listings, column, exact=exact)
    ends = quartiles.select(F.struct("lq", "uq").alias("ends")).scalar()
    position = colour.ramp_position(F.col(column), F.col("_ends.lq"), F.col("_ends.uq"))
    return (
        listings.withColumn("_ends", ends)
        .withColumn("band", position)
        .withColumn("colour", colour.ramp_hex(F.col("band"), ramp))
        .drop("_ends")
    )


def cell_price_band(cells: DataFrame, column: str = "median_ppsf", *, exact: bool = False) -> DataFrame:
    """Cell colour: position between the lower and the upper quartile of all cells, from green over yellow to red."""
    return price_band(cells, column, colour.CELL_RAMP, linear=False, exact=exact)
