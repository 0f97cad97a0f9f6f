"""Variogram and local ordinary kriging on lattice samples.

Raw points are first averaged per node of a fine coordinate lattice (a duplicate
coordinate would make the kriging system singular anyway). That is the only pass
over the data; what follows is bounded by the area, not by the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomarket.operators.polygons import grid_points
from geomarket.session import build_side

# Fixed value: the factor between the range and the width of the gaussian model.
GAUSSIAN_WIDTH = 4.0 / 7.0
# Smallest squares of the neighbour search, as a power of two of the node spacing.
_FINEST = -4


def lattice_samples(points: DataFrame, value: str, *, lat: str = "lat", lng: str = "lng",
                    decimals: int = 3) -> DataFrame:
    """Mean value and row count per lattice node, ``10**-decimals`` degrees apart.

    ``i`` and ``j`` are the integer lattice coordinates of longitude and latitude.
    """
    scale = float(10**decimals)
    return (
        points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull() & F.col(value).isNotNull())
        .groupBy(
            F.floor(F.col(lng) * scale + 0.5).alias("i"), F.floor(F.col(lat) * scale + 0.5).alias("j")
        )
        .agg(F.avg(value).alias("z"), F.count("*").alias("n"))
    )


def variogram(samples: DataFrame, *, max_lag: float, lags: int = 6, decimals: int = 3) -> DataFrame:
    """Mean semivariance, mean distance and pair count per lag bin.

    Samples are bucketed into squares as wide as the largest lag. A square holds
    at most as many samples as it has lattice nodes, so neither a crowded place
    nor more data can make a bucket grow. Each pair is formed once.
    """
    scale = float(10**decimals)
    reach = int(np.ceil(max_lag * scale))

    def square(column: Column, row: Column) -> Column:
        """One bigint per square, so that the join hashes a single long."""
        return F.shiftleft(column, 32) + row

    column, row = F.floor(F.col("i") / float(reach)), F.floor(F.col("j") / float(reach))
    # Partners lie in the same column of squares or the next one east. The copies
    # are six times the samples, which the engine cannot foresee: never broadcast.
    neighbours = [(east, north) for east in (-1, 0) for north in (-1, 0, 1)]
    left = samples.select(
        F.col("i").alias("i1"), F.col("j").alias("j1"), F.col("z").alias("z1"), square(column, row).alias("square")
    )
    right = samples.select(
        F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("z").alias("z2"),
        F.explode(F.array(*[square(column + east, row + north) for east, north in neighbours])).alias("square"),
    ).hint("merge")
    d_i, d_j, d_z = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"), F.col("z2") - F.col("z1")
    distance = F.sqrt((d_i * d_i + d_j * d_j).cast("double")) / scale
    pairs = left.join(right, "square").where((d_i > 0) | ((d_i == 0) & (d_j > 0)))
    return (
        pairs.select(distance.alias("h"), (d_z * d_z * 0.5).alias("g"))
        .where(F.col("h") < max_lag)
        .groupBy(F.floor(F.col("h") / (max_lag / lags)).cast("int").alias("bin"))
        .agg(F.avg("h").alias("distance"), F.avg("g").alias("semivariance"), F.count("*").alias("pairs"))
    )


class GaussianModel(NamedTuple):
    nugget: float
    psill: float
    reach: float

    def __call__(self, distance: np.ndarray) -> np.ndarray:
        """Semivariance; zero at distance zero, so samples are honoured exactly."""
        rise = self.psill * (1 - np.exp(-(distance**2) / (self.reach * GAUSSIAN_WIDTH) ** 2)) + self.nugget
        return np.where(distance > 0, rise, 0.0)


def fit_gaussian(bins: DataFrame, *, min_nugget_share: float = 1e-3) -> GaussianModel:
    """Weighted least squares on the lag bins (a handful of rows).

    For a given range the model is linear in nugget and sill, so only the range
    is searched. A small nugget keeps the kriging systems well conditioned.
    """
    rows = bins.where("pairs > 0").orderBy("distance").collect()
    if not rows:
        raise ValueError("no pairs of samples within the largest lag")
    h = np.array([r["distance"] for r in rows])
    g = np.array([r["semivariance"] for r in rows])
    weight = np.sqrt([r["pairs"] for r in rows])
    best = None
    for reach in np.geomspace(h[0] / 4, h[-1] * 4, 400):
        rise = 1 - np.exp(-(h**2) / (reach * GAUSSIAN_WIDTH) ** 2)
        design = np.column_stack([np.ones_like(h), rise]) * weight[:, None]
        nugget, psill = np.linalg.lstsq(design, g * weight, rcond=None)[0]
        if nugget < 0 or psill < 0:
            flat, steep = np.average(g, weights=weight**2), (rise * g) @ weight**2 / ((rise**2) @ weight**2)
            nugget, psill = (0.0, steep) if nugget < 0 else (flat, 0.0)
        error = float(np.sum((weight * (nugget + psill * rise - g)) ** 2))
        if best is None or error < best[0]:
            best = (error, nugget, psill, reach)
    _, nugget, psill, reach = best
    floor = min_nugget_share * max(nugget + psill, np.finfo(float).tiny)
    return GaussianModel(float(max(nugget, floor)), float(psill), float(reach))


def grid_nodes(samples: DataFrame, number_x: int = 40, number_y: int = 40, *, decimals: int = 3) -> DataFrame:
    """Evenly spaced nodes over the extent of the samples.

    ``spacing`` is the wider of the two steps, ``levels`` how often it doubles
    until it spans the extent.
    """
    scale = float(10**decimals)
    extent = samples.agg(
        (F.min("i") / scale).alias("min_x"), (F.min("j") / scale).alias("min_y"),
        (F.max("i") / scale).alias("max_x"), (F.max("j") / scale).alias("max_y"),
    )
    wide, high = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    steps = extent.where("min_x is not null").withColumn(
        # A single point still needs a positive spacing.
        "spacing", F.greatest(wide / max(number_x - 1, 1), high / max(number_y - 1, 1), F.lit(1 / scale))
    ).withColumn(
        "levels", F.ceil(F.log2(F.greatest(wide, high, F.col("spacing")) / F.col("spacing"))).cast("int")
    )
    node = (F.col("grid_y") * number_x + F.col("grid_x")).cast("bigint").alias("node")
    return grid_points(steps, number_x, number_y).select(node, "x", "y", "spacing", "levels")


def kriging_neighbours(samples: DataFrame, nodes: DataFrame, k: int = 32, *, decimals: int = 3) -> DataFrame:
    """The ``k`` nearest samples of every node, exact.

    Samples are counted in squares of several sizes. A node uses the smallest
    size whose 3 x 3 block around it already holds ``k`` samples: none of the k
    nearest can then be farther than the block's far corner, less than three
    squares away, so only those squares are searched. The largest squares span
    the whole extent, so no node is left short while samples exist.
    """
    scale = float(10**decimals)
    shape = nodes.select(F.struct("spacing", "levels").alias("shape")).limit(1)

    def squares(df: DataFrame, x: Column, y: Column) -> DataFrame:
        """One row per size, with the square that holds the point."""
        return (
            df.withColumn("level", F.explode(F.sequence(F.lit(_FINEST), F.col("levels"))))
            .withColumn("size", F.col("spacing") * F.pow(F.lit(2.0), F.col("level")))
            .withColumns({"sx": F.floor(x / F.col("size")), "sy": F.floor(y / F.col("size"))})
        )

    def around(df: DataFrame, reach: int) -> DataFrame:
        return (
            df.withColumn("sx", F.explode(F.sequence(F.col("sx") - reach, F.col("sx") + reach)))
            .withColumn("sy", F.explode(F.sequence(F.col("sy") - reach, F.col("sy") + reach)))
        )

    placed = samples.withColumn("_shape", shape.scalar()).select(
        "i", "j", "z", (F.col("i") / scale).alias("sample_x"), (F.col("j") / scale).alias("sample_y"), "_shape.*"
    )
    located = squares(placed, F.col("sample_x"), F.col("sample_y"))
    counts = located.groupBy("level", "sx", "sy").agg(F.count("*").alias("held"))

    # The node side depends on the size of the grid, which may be broadcast or not.
    centred = squares(nodes, F.col("x"), F.col("y"))
    level = (
        build_side(around(centred, 1), "node-squares", F.lit(1)).join(counts, ["level", "sx", "sy"])
        .groupBy("node", "level", "levels").agg(F.sum("held").alias("held"))
        .groupBy("node").agg(F.coalesce(F.min(F.when(F.col("held") >= k, F.col("level"))), F.max("levels")).alias("level"))
    )
    # Three squares: the far corner of the block is 2 * sqrt(2) sizes away.
    searched = around(centred.join(level, ["node", "level"]), 3).select("node", "x", "y", "level", "sx", "sy")
    gap_x, gap_y = F.col("sample_x") - F.col("x"), F.col("sample_y") - F.col("y")
    nearest = Window.partitionBy("node").orderBy("distance_sq", "i", "j")
    return (
        build_side(searched, "node-search", F.lit(1))
        .join(located.select("level", "sx", "sy", "i", "j", "z", "sample_x", "sample_y"), ["level", "sx", "sy"])
        .withColumn("distance_sq", gap_x * gap_x + gap_y * gap_y)
        .withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
        .select("node", "x", "y", "rank", "i", "j", "sample_x", "sample_y", "z", "distance_sq")
    )


def _krige(x0: np.ndarray, y0: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray,
           model: GaussianModel) -> tuple[np.ndarray, np.ndarray]:
    """Solve one ordinary kriging system per row; ``x``, ``y``, ``z`` are (nodes, samples)."""
    nodes, size = x.shape
    system = np.ones((nodes, size + 1, size + 1))
    system[:, :size, :size] = model(np.hypot(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]))
    system[:, size, size] = 0.0
    target = np.ones((nodes, size + 1))
    target[:, :size] = model(np.hypot(x - x0[:, None], y - y0[:, None]))
    try:
        weights = np.linalg.solve(system, target[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        weights = (np.linalg.pinv(system, rcond=1e-13, hermitian=True) @ target[:, :, None])[:, :, 0]
    return (weights[:, :size] * z).sum(axis=1), (weights * target).sum(axis=1)


def kriging_surface(neighbours: DataFrame, model: GaussianModel) -> DataFrame:
    """Prediction and variance per node from its neighbours.

    A node's neighbours (at most k rows) become arrays; tasks then solve whole
    Arrow batches of small systems at once. The result equals the global solution
    when k reaches the number of samples and approximates it below that.
    """
    gathered = neighbours.groupBy("node", "x", "y").agg(
        F.array_sort(F.collect_list(F.struct("rank", "sample_x", "sample_y", "z"))).alias("_near")
    ).select(
        "node", "x", "y", F.col("_near.sample_x").alias("sx"), F.col("_near.sample_y").alias("sy"),
        F.col("_near.z").alias("sz"),
    )

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, same in frame.groupby(frame["sz"].str.len()):
                stacks = [np.vstack(same[c].to_list()) for c in ("sx", "sy", "sz")]
                value, variance = _krige(same["x"].to_numpy(), same["y"].to_numpy(), *stacks, model)
                yield pd.DataFrame({
                    "node": same["node"], "longitude": same["x"], "latitude": same["y"],
                    "predicted": value, "variance": variance,
                })

    return gathered.mapInPandas(
        solve, "node bigint, longitude double, latitude double, predicted double, variance double"
    )


# What tasks run here travels with the job, so executors need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
