"""Prices brought to one month, and a price surface over them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geomarket.operators import surface, trends
from geomarket.session import written


def rebased_prices(sales: DataFrame, *, exact: bool = False, min_observations: int = 0) -> DataFrame:
    monthly = trends.monthly_medians(sales, exact=exact)
    return trends.rebase_sales(sales, trends.month_adjustment(monthly, min_observations=min_observations))


def price_surface(prices: DataFrame, value: str = "ppsf_adj", *, max_lag: float, number_x: int = 40,
                  number_y: int = 40, k: int = 32, decimals: int = 3) -> DataFrame:
    """Predicted value and variance on an even grid over the extent of the prices.

    The lattice samples feed the variogram, the extent, the counts and the
    search, so they are written once: a table bounded by the area.
    """
    samples = written(surface.lattice_samples(prices, value, decimals=decimals), "samples")
    model = surface.fit_gaussian(surface.variogram(samples, max_lag=max_lag, decimals=decimals))
    nodes = surface.grid_nodes(samples, number_x, number_y, decimals=decimals)
    return surface.kriging_surface(surface.kriging_neighbours(samples, nodes, k, decimals=decimals), model)
