"""Summaries that feed sliders, headline figures and the map centre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomarket.operators.quantiles import Total, exact_quantiles, quantiles

QUARTILES = {"lq": 0.25, "uq": 0.75}


def numerical_summary(df: DataFrame, column: str, *, with_quartiles: bool = True, exact: bool = False) -> DataFrame:
    """One row: ``min``, ``max`` and, on request, the lower and upper quartile."""
    ends = [Total("min", "min", column), Total("max", "max", column)]
    if not with_quartiles:
        return df.agg(*(end.part() for end in ends))
    return quantiles(df, column, QUARTILES, exact=exact, extra=ends)


def linear_quartiles(df: DataFrame, column: str) -> DataFrame:
    """Quartiles interpolated between neighbours, exact."""
    return exact_quantiles(df, column, QUARTILES, linear=True)


def slider_bounds(summary: DataFrame, digits: int = 4) -> DataFrame:
    """Slider ends and defaults: the summary rounded to tens of thousands, half-even."""
    names = {"min": "slider_min", "max": "slider_max", "lq": "default_min", "uq": "default_max"}
    present = [c for c in names if c in summary.columns]
    rounded = [F.bround(F.col(c), -digits).cast("bigint").alias(names[c]) for c in present]
    if "lq" not in present:
        rounded += [rounded[0].alias("default_min"), rounded[1].alias("default_max")]
    return summary.select(*rounded)


def headline_metrics(df: DataFrame, column: str, *, exact: bool = False) -> DataFrame:
    """One row: ``count`` of all rows, ``sum`` and ``median`` of a column."""
    totals = [Total("count", "count"), Total("sum", "sum", column)]
    return quantiles(df, column, {"median": 0.5}, exact=exact, extra=totals)


def map_centre(df: DataFrame, lat: str = "latitude", lng: str = "longitude", *,
               at: tuple[float, float] | None = None) -> DataFrame:
    """Mean of the coordinates, unless a place to centre on is given (latitude first)."""
    if at:
        return df.sparkSession.range(1).select(F.lit(at[0]).alias("lat"), F.lit(at[1]).alias("lng"))
    return df.agg(F.avg(lat).alias("lat"), F.avg(lng).alias("lng"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in ascending order, a missing value last."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())
