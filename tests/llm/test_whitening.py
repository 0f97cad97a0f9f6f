import numpy as np
import pytest

from geomarket.llm import whitening


def plain(vectors, k=8):
    """Eigenvectors and the rest by numpy's own solver, all rows in memory."""
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - sums)**2).sum(axis=1), y @ v / np.sqrt(e), e / np.trace(y.T @ y / n), e


def compare(found, ids, vectors):
    n, deviation, w, explained, e = plain(vectors)
    by = {}
    for r in found:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, w.shape[1] + 1)) and len(found) == w.size
    for c, rows in by.items():
        got = np.array([rows[i].pop().whitened for i in ids])
        same = np.sign(got @ w[:, c - 1])
        assert np.allclose(got * same, w[:, c - 1], atol=1e-6)
    assert {r.n for r in found} == {n}
    expected = dict(zip(ids, deviation.tolist(), strict=True))
    assert all(r.deviation == expected[r.vec_id] for r in found)
    assert all(abs(r.explained - explained[r.component - 1]) <= 1e-9 for r in found)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-8


def test_given_embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(3)
    rows = table.collect()
    compare(whitening.whiten(table).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def matrices():
    r = np.random.default_rng(5)
    q = np.linalg.qr(r.standard_normal((30, 30)))[0]
    yield "random", (lambda a: a @ a.T)(r.standard_normal((30, 40)))
    yield "one", np.array([[3.0]])
    yield "two", np.array([[2.0, 1.0], [1.0, 2.0]])
    yield "unit", np.eye(12)
    yield "zero", np.zeros((9, 9))
    yield "diagonal", np.diag(r.random(20))
    yield "repeated", q @ np.diag(np.repeat([5.0, 5.0, 2.0, 1.0, 1.0], 6)) @ q.T
    yield "close", q @ np.diag(1 + 1e-9 * np.arange(30)) @ q.T
    yield "scales", q @ np.diag(10.0**np.arange(-20, 10)) @ q.T
    yield "blocks", np.kron(np.eye(4), np.array([[2.0, 1, 0], [1, 2, 1], [0, 1, 2]]))
    yield "tiny", 1e-200 * np.diag([3.0, 2, 1, 5])


@pytest.mark.parametrize("name,matrix", list(matrices()), ids=[m[0] for m in matrices()])
def test_eigenvectors(name, matrix):
    matrix = (matrix + matrix.T) / 2
    k = min(8, len(matrix))
    t = whitening.tridiagonalise(matrix)
    values = whitening.leading_eigenvalues(t, k)
    size = np.abs(matrix).max() or 1
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], rtol=0, atol=1e-13 * size * len(matrix))
    v = whitening.components(t, values)
    assert np.abs(v @ v.T - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ v.T - v.T * values).max() <= 1e-12 * size


def test_sturm_counts():
    a = np.random.default_rng(1).standard_normal((25, 25))
    a += a.T
    t = whitening.tridiagonalise(a)
    shifts = np.linspace(-15, 15, 40)
    assert whitening.below(t, shifts).tolist() == [(np.linalg.eigvalsh(a) < s).sum() for s in shifts]


@pytest.fixture
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(3)
    good = [(None if i == 4 else i % 17, [float(v) for v in r.standard_normal(5)]) for i in range(40)]
    good += [good[7], good[7], (99, [1e3, -3.0, 0.0, 2.0, 1.0])]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0, 4.0]), (53, [1.0, nan, 2.0, 3.0, 4.0]), (54, [inf] * 5),
           (55, [1.0] * 4), (56, [1.0] * 6), (None, None)]
    df = spark.createDataFrame(odd[:4] + good + odd[4:], "vec_id long, embedding array<double>").selectExpr(
        "*", "1 as id", "2 as vector", "3 as n", "4 as component", "5 as at", "6 as i", "7 as total")
    return df, good


def test_odd_vectors(odd_vectors):
    df, good = odd_vectors
    found = whitening.whiten(df.repartition(4)).collect()
    ids = [i for i, _ in good]
    n, deviation, w, _, _ = plain([v for _, v in good])
    assert len(found) == w.size and {r.n for r in found} == {n}
    assert sorted((str(r.vec_id), r.deviation) for r in found if r.component == 1) == sorted(
        zip(map(str, ids), deviation.tolist(), strict=True))
    assert found[0].identity_error < 1e-8


def test_no_variance_and_no_rows(spark, odd_vectors):
    df, _ = odd_vectors
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id = 50")).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25, 0.1]) for i in range(20)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    plane = spark.createDataFrame([(i, [i * 0.5, -i * 0.5, 0.1]) for i in range(20)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(plane).collect()} == {1}


def test_entries_out_of_range(spark):
    rows = [(i, [1e300 if i % 2 else -1e300, float(i)]) for i in range(10)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    # The other component is smaller than the rounding of the first.
    assert len(found) == 10 and all(np.isfinite(r.whitened) for r in found)
    assert all(r.deviation is None for r in found)
