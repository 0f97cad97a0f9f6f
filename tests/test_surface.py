import numpy as np
import pytest
from pyspark.sql import functions as F

from geomarket.operators import surface
from geomarket.operators.surface import GaussianModel


def samples(spark, n=120, seed=4, span=300):
    rng = np.random.default_rng(seed)
    flat = rng.choice(span * span, size=n, replace=False)
    rows = [(int(p % span), int(p // span), float(np.sin(p % span / 40) + p // span / 100), 1) for p in flat]
    return spark.createDataFrame(rows, "i long, j long, z double, n long")


def arrays(df):
    rows = df.collect()
    return (np.array([r["i"] for r in rows]) / 1000, np.array([r["j"] for r in rows]) / 1000,
            np.array([r["z"] for r in rows]))


def dense(x, y, z, x0, y0, model):
    """The global ordinary kriging system, solved directly."""
    n = len(x)
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = model(np.hypot(x[:, None] - x, y[:, None] - y))
    a[n, n] = 0
    b = np.ones((n + 1, len(x0)))
    b[:n] = model(np.hypot(x[:, None] - x0, y[:, None] - y0))
    w = np.linalg.solve(a, b)
    return w[:n].T @ z, (w * b).sum(0), w[:n].sum(0)


def test_all_samples_equal_the_dense_solution(spark):
    df = samples(spark)
    model = GaussianModel(0.01, 1.0, 0.2)
    nodes = surface.grid_nodes(df, 6, 5)
    got = surface.kriging_surface(surface.kriging_neighbours(df, nodes, k=120), model).orderBy("node").collect()
    x, y, z = arrays(df)
    value, variance, weights = dense(
        x, y, z, np.array([r["longitude"] for r in got]), np.array([r["latitude"] for r in got]), model)
    assert len(got) == 30
    assert np.allclose([r["predicted"] for r in got], value, atol=1e-7)
    assert np.allclose([r["variance"] for r in got], variance, atol=1e-7)
    assert np.allclose(weights, 1)


def test_exact_at_samples(spark):
    """Samples on the corners of a 3 x 3 grid are the nodes themselves."""
    rows = [(100 * i, 100 * j, float(i * 3 + j * j), 1) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(rows, "i long, j long, z double, n long")
    got = surface.kriging_surface(
        surface.kriging_neighbours(df, surface.grid_nodes(df, 3, 3), k=9), GaussianModel(0.01, 1.0, 0.1))
    by_node = {(round(r["longitude"] * 1000), round(r["latitude"] * 1000)): r for r in got.collect()}
    for i, j, z, _ in rows:
        assert by_node[(i, j)]["predicted"] == pytest.approx(z, abs=1e-8)
        assert by_node[(i, j)]["variance"] == pytest.approx(0, abs=1e-8)


@pytest.mark.parametrize("k,number_x,number_y", [(1, 8, 8), (7, 8, 8), (40, 8, 8), (5, 150, 2), (5, 1, 9), (200, 4, 4)])
def test_neighbours_equal_brute_force_when_crowded(spark, k, number_x, number_y):
    """Half of all samples sit in one corner, most nodes are far from any."""
    rng = np.random.default_rng(9)
    corner = {(int(a), int(b)) for a, b in rng.integers(0, 12, (100, 2))}
    wide = {(int(a), int(b)) for a, b in rng.integers(0, 2000, (60, 2))}
    points = sorted(corner | wide)
    df = spark.createDataFrame([(i, j, 1.0, 1) for i, j in points], "i long, j long, z double, n long")
    got = surface.kriging_neighbours(df, surface.grid_nodes(df, number_x, number_y), k=k).collect()
    nodes = {r["node"]: (r["x"], r["y"]) for r in got}
    assert len(nodes) == number_x * number_y
    for node, (x, y) in nodes.items():
        order = sorted(((i / 1000 - x) ** 2 + (j / 1000 - y) ** 2, i, j) for i, j in points)[:k]
        mine = sorted((r["rank"], r["i"], r["j"]) for r in got if r["node"] == node)
        assert [(i, j) for _, i, j in mine] == [(i, j) for _, i, j in order]


def test_fewer_samples_than_neighbours(spark):
    df = samples(spark, n=5)
    got = surface.kriging_neighbours(df, surface.grid_nodes(df, 4, 4), k=32).groupBy("node").count().collect()
    assert len(got) == 16 and all(r["count"] == 5 for r in got)


def test_single_sample(spark):
    df = spark.createDataFrame([(5, 5, 3.0, 1)], "i long, j long, z double, n long")
    got = surface.kriging_surface(
        surface.kriging_neighbours(df, surface.grid_nodes(df, 2, 2), k=4), GaussianModel(0.1, 1.0, 0.1)).collect()
    assert [r["predicted"] for r in got] == pytest.approx([3.0] * 4)


def test_duplicates_are_averaged(spark):
    df = spark.createDataFrame(
        [(47.1, -122.3, 1.0), (47.1, -122.3, 3.0), (47.1001, -122.3001, 5.0), (None, -122.3, 9.0)],
        "lat double, lng double, v double")
    got = surface.lattice_samples(df, "v").collect()
    assert [(r["i"], r["j"], r["z"], r["n"]) for r in got] == [(-122300, 47100, 3.0, 3)]


def test_variogram_equals_brute_force(spark):
    df = samples(spark, n=300, span=60)
    got = {r["bin"]: r for r in surface.variogram(df, max_lag=0.02, lags=5).collect()}
    x, y, z = arrays(df)
    upper = np.triu_indices(len(x), 1)
    h = np.hypot(x[:, None] - x, y[:, None] - y)[upper]
    g = (0.5 * (z[:, None] - z) ** 2)[upper]
    for b in range(5):
        inside = (h < 0.02 - 1e-12) & (np.floor(h / 0.004 + 1e-9) == b)
        if not inside.any():
            assert b not in got
            continue
        assert got[b]["pairs"] == inside.sum()
        assert got[b]["semivariance"] == pytest.approx(g[inside].mean())


def test_fit_recovers_a_gaussian_model(spark):
    model = GaussianModel(2.0, 10.0, 0.01)
    h = np.linspace(0.001, 0.02, 12)
    bins = spark.createDataFrame(
        [(i, float(a), float(model(np.array([a]))[0]), 100) for i, a in enumerate(h)],
        "bin int, distance double, semivariance double, pairs long")
    fitted = surface.fit_gaussian(bins)
    assert fitted.nugget == pytest.approx(2, rel=0.05)
    assert fitted.psill == pytest.approx(10, rel=0.05)
    assert fitted.reach == pytest.approx(0.01, rel=0.05)


def test_empty(spark):
    empty = spark.createDataFrame([], "i long, j long, z double, n long")
    assert surface.kriging_neighbours(empty, surface.grid_nodes(empty)).count() == 0
    assert surface.variogram(empty, max_lag=0.01).count() == 0
    with pytest.raises(ValueError):
        surface.fit_gaussian(surface.variogram(empty, max_lag=0.01))
    assert surface.lattice_samples(empty.select(F.col("z").alias("lat"), F.col("z").alias("lng"), "z"), "z").count() == 0
