"""Proximity joins within a radius, and coverage of search points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomarket.functions import geometry
from geomarket.session import build_side

# Two miles, and metres per degree of a great circle.
TWO_MILES_M = 3218.688
METRES_PER_DEGREE = math.radians(1) * geometry.EARTH_RADIUS_M


# Search sizes of the nearest-place join: the radius halved this many times.
_HALVINGS = 8


def _height(reach: Column) -> Column:
    """Height of a latitude band in degrees: the reach, and a little more for rounding."""
    return reach * (1.001 / METRES_PER_DEGREE)


def _width(band: Column, reach: Column) -> Column:
    """Width of the cells in a band; they widen towards the poles, band by band, so
    that the reach never spans more than one cell on either side."""
    farthest = F.greatest(F.abs(band - 1), F.abs(band + 2)) * _height(reach)
    return _height(reach) * 1.01 / F.greatest(F.cos(F.radians(farthest)), F.lit(0.01))


def _located(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """Add the cell of each row; ``reach`` is the distance its neighbours may have."""
    return (
        df.withColumn("_band", F.floor(F.col(lat) / _height(F.col("reach"))))
        .withColumn("_cell", F.floor(F.col(lng) / _width(F.col("_band"), F.col("reach"))))
    )


def _copied(spots: DataFrame) -> DataFrame:
    """Spots (``_lat``, ``_lng``, ``reach``) copied to their own and all neighbouring cells.

    A point's cell then lists every spot within reach of it. Cells above 89
    degrees and across the date line are not joined up.
    """
    band = F.floor(F.col("_lat") / _height(F.col("reach")))
    cell = F.floor(F.col("_lng") / _width(F.col("_band"), F.col("reach")))
    return (
        spots.withColumn("_band", F.explode(F.sequence(band - 1, band + 1)))
        .withColumn("_cell", F.explode(F.sequence(cell - 1, cell + 1)))
    )


def _metres(lat: str, lng: str) -> Column:
    return geometry.haversine_m(F.col(lat), F.col(lng), F.col("_lat"), F.col("_lng"))


def near_places(listings: DataFrame, places: DataFrame, radius_m: float = TWO_MILES_M, *, lat: str = "latitude",
                lng: str = "longitude") -> DataFrame:
    """Listings with at least one place inside the radius, each once.

    Only distinct place coordinates matter, and a listing stops at its first hit.
    The copies of the places are counted before the join, and broadcast only when
    they are few.
    """
    spots = (
        places.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
        .select(F.col(lat).alias("_lat"), F.col(lng).alias("_lng")).distinct()
        .withColumn("reach", F.lit(float(radius_m)))
    )
    copies = build_side(_copied(spots).drop("reach"), "place-cells", F.lit(1))
    probe = _located(listings.withColumn("reach", F.lit(float(radius_m))), lat, lng)
    on = [probe["_band"] == copies["_band"], probe["_cell"] == copies["_cell"], _metres(lat, lng) <= radius_m]
    return probe.join(copies, on, "left_semi").drop("reach", "_band", "_cell")


def nearest_place(listings: DataFrame, places: DataFrame, radius_m: float = TWO_MILES_M, *, key: str = "zpid",
                  place_key: str = "fsq_id", lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """Per listing: the nearest place inside the radius and its distance in whole millimetres.

    Places at one spot collapse to the smallest key, and listings at one spot
    share one search. The search does not compare a listing with everything
    inside the radius: cells of several sizes tell how far the nearest spot can
    be at most, and only a cell of about that size is searched. In a crowded area
    that is a cell of a few metres.
    """
    sizes = F.explode(F.sequence(F.lit(0), F.lit(_HALVINGS)))
    reach = F.lit(float(radius_m)) / F.pow(F.lit(2.0), F.col("level"))
    spots = (
        places.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
        .groupBy(F.col(lat).alias("_lat"), F.col(lng).alias("_lng")).agg(F.min(place_key).alias(place_key))
        .withColumn("level", sizes).withColumn("reach", reach)
    )
    cell = ["level", "_band", "_cell"]
    copies = build_side(_copied(spots).drop("reach"), "place-cells", F.lit(1))
    wanted = listings.select(lat, lng).where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).distinct()

    # A copy in a point's cell lies at most two cells away either way. Such a hit
    # is a usable bound where that is no more than four times the reach, because
    # the cell two sizes up then lists everything as near as the hit.
    nearest_lat = F.least(F.abs(F.col("_band") - 1), F.abs(F.col("_band") + 2)) * _height(F.col("reach"))
    flattest = F.when(F.abs(F.col("_band") + 0.5) < 2, 1.0).otherwise(F.cos(F.radians(nearest_lat)))
    across = _width(F.col("_band"), F.col("reach")) * flattest
    farthest = F.hypot(_height(F.col("reach")), across) * (2 * METRES_PER_DEGREE)
    probes = _located(wanted.withColumn("level", sizes).withColumn("reach", reach), lat, lng).where(
        (F.col("level") == 0) | (farthest <= F.col("reach") * 4)
    )
    finest = (
        probes.join(copies.select(*cell).distinct(), cell, "left_semi")
        .groupBy(lat, lng).agg(F.greatest(F.max("level") - 2, F.lit(0)).alias("level"))
    )
    searched = _located(finest.withColumn("reach", reach), lat, lng)
    metres = _metres(lat, lng)
    best = (
        searched.join(copies, cell).where(metres <= radius_m)
        .groupBy(F.col(lat).alias("_at_lat"), F.col(lng).alias("_at_lng"))
        .agg(F.min(F.struct(F.round(metres * 1000).cast("bigint").alias("distance_mm"), place_key)).alias("_best"))
    )
    return (
        listings.join(best, (F.col(lat) == F.col("_at_lat")) & (F.col(lng) == F.col("_at_lng")))
        .select(key, F.col(f"_best.{place_key}").alias(place_key), F.col("_best.distance_mm").alias("distance_mm"))
    )


def covered_search_points(search_points: DataFrame, results: DataFrame, key: str, *,
                          covered: bool = True) -> DataFrame:
    """Search points that did (or did not) bring any result."""
    seen = results.select(key).distinct()
    return search_points.join(seen, key, "left_semi" if covered else "left_anti")
