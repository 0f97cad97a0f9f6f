"""Row filters; each leaves plain comparisons for the scan to push down."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bounds(NamedTuple):
    """Map bounds in degrees, all edges inclusive."""

    south: float
    west: float
    north: float
    east: float


def closed_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Keep ``low <= column <= high``; does nothing unless both ends are given."""
    if low is None or high is None:
        return df
    return df.where(F.col(column).between(int(low), int(high)))


def open_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Each end applies on its own."""
    if low is not None:
        df = df.where(F.col(column) >= int(low))
    if high is not None:
        df = df.where(F.col(column) <= int(high))
    return df


def in_bounds(df: DataFrame, bounds: Bounds | None, lat: str, lng: str) -> DataFrame:
    if not bounds:
        return df
    return df.where(
        F.col(lat).between(bounds.south, bounds.north) & F.col(lng).between(bounds.west, bounds.east)
    )


def filter_sales(sales: DataFrame, *, month_min=None, month_max=None, beds_min=None, beds_max=None,
                 bounds: Bounds | None = None) -> DataFrame:
    sales = closed_range(sales, "beds", beds_min, beds_max)
    sales = open_range(sales, "year_month", month_min, month_max)
    return in_bounds(sales, bounds, "lat", "lng")


def filter_listings(listings: DataFrame, *, beds_min=None, beds_max=None, price_min=None, price_max=None,
                    bounds: Bounds | None = None) -> DataFrame:
    listings = in_bounds(listings, bounds, "latitude", "longitude")
    listings = closed_range(listings, "bedrooms", beds_min, beds_max)
    return closed_range(listings, "price", price_min, price_max)


def by_name(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(*names))
