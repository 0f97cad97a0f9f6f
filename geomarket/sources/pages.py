"""Landed API pages: one JSON object per call, records in an array, metadata alongside.

Pages are stored one per line, so a file of many pages splits across tasks. All
pages of a folder are one read; there is no accumulator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomarket import schema

PAGE_META = ["resultsPerPage", "totalPages", "totalResultCount"]


def read_pages(spark: SparkSession, path: str, payload: schema.T.StructType, *, lines: bool = True) -> DataFrame:
    """One page per line, or with ``lines=False`` one page per file."""
    return spark.read.schema(payload).option("multiLine", not lines).json(path)


def normalize_pages(payload: DataFrame) -> DataFrame:
    """Records under ``results``, each with its page number and page metadata."""
    return payload.select("page", *PAGE_META, F.explode("results").alias("_r")).select("_r.*", "page", *PAGE_META)


def normalize_search(payload: DataFrame) -> DataFrame:
    """Records under ``props``, each with metadata and the request that brought it."""
    lineage = [*PAGE_META, "currentPage", "api_call_no", "search_long_lat"]
    return payload.select(*lineage, F.explode("props").alias("_r")).select("_r.*", *lineage)


def normalize_places(payload: DataFrame) -> DataFrame:
    """Places under ``results`` flattened to snake case, with the circle that was searched."""
    circle = "context.geo_bounds.circle"
    return payload.select(
        F.explode("results").alias("_r"),
        F.col(f"{circle}.center.latitude").alias("search_latitude"),
        F.col(f"{circle}.center.longitude").alias("search_longitude"),
        F.col(f"{circle}.radius").alias("search_radius"),
    ).select(
        "_r.fsq_id", "_r.name",
        F.col("_r.location.formatted_address").alias("formatted_address"),
        F.col("_r.geocodes.main.latitude").alias("latitude"),
        F.col("_r.geocodes.main.longitude").alias("longitude"),
        "search_latitude", "search_longitude", "search_radius",
    )
