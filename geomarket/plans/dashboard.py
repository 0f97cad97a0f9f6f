"""Everything a market page shows, as DataFrames; only the cell medians are computed up front."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomarket.functions import cells as cell_functions
from geomarket.functions import colour
from geomarket.operators import cells, filters, labels, summary, trends
from geomarket.session import written
from geomarket.sources import geojson


@dataclass(frozen=True)
class Selection:
    """What the user picked; what is not given does not filter."""

    beds_min: int | None = None
    beds_max: int | None = None
    month_min: int | None = None
    month_max: int | None = None
    price_min: int | None = None
    price_max: int | None = None
    bounds: filters.Bounds | None = None
    centre: tuple[float, float] | None = None


def controls(sales: DataFrame, listings: DataFrame) -> dict[str, DataFrame]:
    """Choices offered by the filter controls."""
    return {
        "beds": summary.distinct_sorted(sales, "beds"),
        "months": summary.distinct_sorted(sales, "year_month"),
        "price": summary.slider_bounds(summary.numerical_summary(listings, "price")),
    }


def cell_layer(listings: DataFrame, *, exact: bool = False) -> DataFrame:
    """Cell medians with boundary ring and fill colour.

    The medians set their own colour scale, so they are written once (one row
    per occupied cell) rather than computed for every reader.
    """
    medians = written(cells.cell_medians(listings, exact=exact), "cell-medians")
    coloured = labels.price_band(medians, "median_ppsf", colour.CELL_RAMP)
    return coloured.withColumn("boundary", cell_functions.cell_boundary(F.col("cell")))


def cell_features(layer: DataFrame) -> DataFrame:
    return geojson.with_feature(layer, "boundary", ["median_ppsf", "cell", "count"])


def cell_collections(layer: DataFrame, coarser: int = 4) -> DataFrame:
    """The layer as FeatureCollection documents, one per cell some levels up.

    Four levels up a document holds at most 7 ** 4 features.
    """
    tiled = cell_features(layer).withColumn("tile", F.col("cell"))
    for _ in range(coarser):
        tiled = tiled.withColumn("tile", cell_functions.cell_parent(F.col("tile")))
    return geojson.collections(tiled, "feature", "tile")


def market_report(sales: DataFrame, listings: DataFrame, places: DataFrame, selection: Selection, *,
                  link_base: str, exact: bool = False) -> dict[str, DataFrame]:
    """All parts of the page.

    ``sales`` carry ``price_per_sqft`` and ``year_month``; ``listings`` carry
    ``pricePerSqft`` and ``cell``. Without bounds the area is everything. Every
    part reads its inputs again, so hand over stored tables, best clustered by
    month or cell, rather than long derivations.
    """
    chosen_sales = filters.filter_sales(
        sales, month_min=selection.month_min, month_max=selection.month_max,
        beds_min=selection.beds_min, beds_max=selection.beds_max,
    )
    chosen_listings = filters.filter_listings(
        listings, beds_min=selection.beds_min, beds_max=selection.beds_max,
        price_min=selection.price_min, price_max=selection.price_max,
    )
    bounds = selection.bounds
    area_sales = filters.in_bounds(chosen_sales, bounds, "lat", "lng")
    area_listings = filters.in_bounds(chosen_listings, bounds, "latitude", "longitude")
    in_area = (
        F.col("lat").between(bounds.south, bounds.north) & F.col("lng").between(bounds.west, bounds.east)
        if bounds else F.lit(True)
    )
    return {
        "listing_metrics": summary.headline_metrics(area_listings, "price", exact=exact),
        "sales_metrics": summary.headline_metrics(area_sales, "sale_price", exact=exact),
        "monthly_sales": trends.monthly_sales(chosen_sales, in_area, exact=exact),
        "recent_sales": trends.recent_sales(area_sales),
        "map_centre": summary.map_centre(chosen_listings, at=selection.centre),
        "cells": cell_layer(listings, exact=exact),
        "markers": labels.price_band(chosen_listings),
        "clusters": cells.zoom_clusters(chosen_listings),
        "listing_labels": labels.listing_labels(chosen_listings, link_base),
        "place_labels": labels.place_labels(places),
    }
