"""From landed feeds to the listings table, and the searches that fill the feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomarket.functions import cells as cell_functions
from geomarket.functions import text
from geomarket.operators import cells, clean, regions


def search_points(districts: DataFrame, names: list[str], number_x: int, number_y: int, radius_m: int) -> DataFrame:
    """Evenly spaced points within the union of the named districts, with their search strings."""
    chosen = districts.where(F.col("name").isin(*names))
    points = regions.uniform_points(chosen, number_x, number_y)
    return points.withColumns({
        "radius": F.lit(radius_m),
        "lng_lat": text.search_string(F.col("x"), F.col("y")),
        "lat_lng": text.search_string(F.col("y"), F.col("x"), ","),
    })


def listings_table(feed_a: DataFrame, feed_b: DataFrame) -> DataFrame:
    """Both feeds merged: one row per listing, with cell, parent, boundary and price per area.

    The first record wins: feed A before feed B, then the order of arrival.
    """
    merged = clean.align_feeds(feed_a, feed_b)
    unique = clean.first_per_key(merged, ["zpid"], ["feed", "pos"]).drop("feed", "pos")
    return clean.with_listing_ppsf(cells.indexable(unique)).withColumns({
        "parent": cell_functions.cell_parent(F.col("cell")),
        "boundary": cell_functions.cell_boundary(F.col("cell")),
    })
