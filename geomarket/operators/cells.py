"""Cell columns and per-cell aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomarket.functions import cells
from geomarket.functions.cells import DEFAULT_GRID, CellGrid
from geomarket.operators.quantiles import Total, quantiles

# Fixed value: markers closer than this many pixels share a cluster; a world tile is 256 pixels wide.
CLUSTER_PIXELS = 80
TILE_PIXELS = 256


def with_cell(df: DataFrame, lat: str, lng: str, *, grid: CellGrid = DEFAULT_GRID, name: str = "cell") -> DataFrame:
    return df.withColumn(name, cells.cell_of(F.col(lat), F.col(lng), grid))


def indexable(df: DataFrame, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """Rows whose cell can be computed; the scan can check the coordinates itself."""
    return with_cell(df.where(F.col(lat).between(-90, 90) & F.col(lng).between(-180, 180)), lat, lng)


def cell_medians(listings: DataFrame, *, exact: bool = False) -> DataFrame:
    """Per cell: median price per area and number of listings."""
    known = listings.where(F.col("pricePerSqft").isNotNull() & F.col("cell").isNotNull())
    return quantiles(
        known, "pricePerSqft", {"median_ppsf": 0.5}, exact=exact, by=["cell"], extra=[Total("count", "count", "zpid")]
    )


def cell_rollup(df: DataFrame, cell: str = "cell") -> DataFrame:
    """Row counts per parent cell, added up from counts per cell."""
    per_cell = df.groupBy(cell).agg(F.count(cell).alias("n")).where("n > 0")
    return (
        per_cell.groupBy(cells.cell_parent(F.col(cell)).alias("parent"))
        .agg(F.count("*").cast("int").alias("cells"), F.sum("n").alias("n"))
    )


def zoom_clusters(df: DataFrame, lat: str = "latitude", lng: str = "longitude", *, off_from_zoom: int = 12,
                  coarsest: int = 0) -> DataFrame:
    """One row per zoom level and marker cluster: size and centroid.

    Square cells of a fixed pixel width halve with every zoom level, so each
    level is the level below with halved indexes. Rows are added up once, at the
    finest level; the coarser levels read those sums.
    """
    finest = off_from_zoom - 1
    side = 360.0 / 2**finest * CLUSTER_PIXELS / TILE_PIXELS
    base = (
        df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
        .groupBy(F.floor((F.col(lng) + 180.0) / side).alias("x"), F.floor((F.col(lat) + 90.0) / side).alias("y"))
        .agg(F.count("*").alias("n"), F.sum(lat).alias("lat"), F.sum(lng).alias("lng"))
    )
    return (
        base.withColumn("zoom", F.explode(F.sequence(F.lit(coarsest), F.lit(finest))))
        .groupBy(
            "zoom",
            F.expr(f"shiftright(x, {finest} - zoom)").alias("cluster_x"),
            F.expr(f"shiftright(y, {finest} - zoom)").alias("cluster_y"),
        )
        .agg(F.sum("n").alias("n"), F.sum("lat").alias("lat"), F.sum("lng").alias("lng"))
        .select(
            "zoom", "cluster_x", "cluster_y", "n",
            (F.col("lat") / F.col("n")).alias("lat"), (F.col("lng") / F.col("n")).alias("lng"),
        )
    )
