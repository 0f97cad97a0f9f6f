import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geomarket.operators.quantiles import Total, approx_quantiles, exact_quantiles, key_value, with_ordered_key


def frame(spark, groups, partitions=6):
    rows = [(g, v) for g, values in groups.items() for v in values]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(partitions)


def discrete(values, p):
    known = sorted(v for v in values if v is not None)
    return known[max(int(np.ceil(p * len(known))), 1) - 1] if known else None


@pytest.mark.parametrize("bounded", [True, False])
def test_discrete_per_group(spark, bounded):
    rng = random.Random(1)
    groups = {
        "hot": [round(rng.lognormvariate(3, 1), 2) for _ in range(30_000)],
        "ties": [7.0] * 5000 + [8.0] * 4999,
        "few": [3.0, 1.0, 2.0, None],
        "one": [5.0],
        "none": [None, None],
        None: [1.0, 4.0],
    }
    got = {r["g"]: r for r in exact_quantiles(
        frame(spark, groups), "v", {"q1": 0.25, "median": 0.5, "top": 1.0}, by=["g"],
        extra=[Total("n", "count")], bounded_groups=bounded).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for name, p in (("q1", 0.25), ("median", 0.5), ("top", 1.0)):
            assert got[g][name] == discrete(values, p), (g, name)


def test_linear_equals_numpy(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 100) for _ in range(20_001)]
    got = exact_quantiles(frame(spark, {"x": values}), "v", {"a": 0.25, "b": 0.9}, linear=True).first()
    assert got["a"] == pytest.approx(np.quantile(values, 0.25), rel=1e-12)
    assert got["b"] == pytest.approx(np.quantile(values, 0.9), rel=1e-12)


def test_more_rows_than_the_sketch_keeps(spark):
    """Far more distinct values than sketch entries, in many partitions, sorted to be awkward."""
    n = 3_000_000
    df = spark.range(0, n, 1, 40).select((F.col("id") * F.col("id") / float(n)).alias("v"))
    got = exact_quantiles(df, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}).first()
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        k = int(np.ceil(p * n)) - 1
        assert got[name] == k * k / float(n)


def test_groups_of_all_sizes(spark):
    rng = random.Random(8)
    groups = {str(n): [rng.expovariate(0.01) for _ in range(n)] for n in (1, 2, 3, 10, 999, 5999, 6000, 6001, 7203, 10_001, 12_345)}
    df = frame(spark, groups)
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.99}
    for r in exact_quantiles(df, "v", probs, by=["g"]).collect():
        assert all(r[k] == discrete(groups[r["g"]], p) for k, p in probs.items()), r["g"]
    for r in exact_quantiles(df, "v", probs, by=["g"], linear=True).collect():
        assert all(r[k] == pytest.approx(np.quantile(groups[r["g"]], p), rel=1e-12) for k, p in probs.items()), r["g"]


def test_keys_order_all_doubles(spark):
    rng = np.random.default_rng(4)
    bits = rng.integers(-2**63, 2**63, 4000)
    values = [v for v in bits.view(np.float64).tolist() if v == v]
    values += [0.0, -0.0, 1.0, 2.0, np.nextafter(2, 0), np.nextafter(2, 3), 5e-324, -5e-324, 2.2250738585072014e-308,
               np.nextafter(2.2250738585072014e-308, 0), 1.7976931348623157e308, float("inf"), -float("inf")]
    values += [float(np.nextafter(2.0**e, 0)) for e in range(-1070, 1024, 7)] + [2.0**e for e in range(-1070, 1024, 7)]
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = with_ordered_key(df, F.col("v"), "k").withColumn("back", key_value(F.col("k"))).collect()
    known = [r for r in got if r.v is not None and r.v == r.v]
    assert len(known) == len(values) and all(r.back == r.v for r in known)
    expected = [abs(int(np.float64(v).view(np.int64)) & (2**63 - 1)) * (-1 if v < 0 else 1) for v in values]
    assert [r.k for r in known] == expected
    assert [r.k for r in got if r.v is None] == [None]
    (nan,) = [r for r in got if r.v is not None and r.v != r.v]
    assert nan.k > max(expected) and nan.back != nan.back


def awkward():
    """Clusters, ties, gaps and values of every size."""
    rng = random.Random(9)
    yield "cluster", [1e6 + rng.random() * 1e-9 for _ in range(4000)] + [-1e300, 1e300]
    yield "gap", [rng.random() for _ in range(2500)] + [1e12 + rng.random() for _ in range(2501)]
    yield "tie", [3.25] * 9000 + [rng.gauss(3.25, 1e-6) for _ in range(100)]
    yield "neighbours", [float(np.nextafter(1.0, 2) + k * 2.220446049250313e-16) for k in range(700)]
    yield "sizes", [rng.choice([-1, 1]) * 10.0 ** rng.randint(-320, 300) for _ in range(3000)]
    yield "around zero", [rng.gauss(0, 1e-310) for _ in range(500)] + [0.0, -0.0] * 200
    yield "infinite", [float("inf")] * 30 + [-float("inf")] * 30 + [1.0] * 3


def test_awkward_values(spark):
    groups = dict(awkward())
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.999, "g": 1.0}
    got = exact_quantiles(frame(spark, groups).withColumnRenamed("g", "name"), "v", probs, by=["name"]).collect()
    for r in got:
        assert all(r[k] == discrete(groups[r["name"]], p) for k, p in probs.items()), r
    assert len(got) == len(groups)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_any_values(spark, values, p):
    got = exact_quantiles(frame(spark, {"x": values}, 2), "v", {"m": p}).first()["m"]
    assert got == discrete(values, p)


def test_a_group_is_spread_over_the_tasks(spark, sf_dir):
    """One group holds all rows: no task of the selection reads more than its counts of leading bits."""
    df = spark.range(0, 2_000_000, 1, 16).select((F.rand(5) * 1000 + 1).alias("v"))
    digits = with_ordered_key(df, F.col("v"), "k").groupBy(F.shiftright("k", 64 - 18)).count()
    assert digits.count() < 1200
    kept = digits.agg((F.max("count") / F.sum("count")).alias("share")).first()["share"]
    assert kept < 0.02, "a digit's share of the rows is what the second scan keeps"


def test_weights_stand_for_equal_rows(spark):
    rng = random.Random(12)
    rows = [("a", rng.randint(0, 50) / 7, rng.randint(0, 9)) for _ in range(300)] + [("a", None, 5), ("b", 2.5, 0)]
    got = {r["g"]: r for r in exact_quantiles(
        spark.createDataFrame(rows, "g string, v double, w int"), "v", {"q1": 0.25, "m": 0.5}, by=["g"], weight="w").collect()}
    values = [v for g, v, w in rows for _ in range(w) if g == "a"]
    assert (got["a"]["q1"], got["a"]["m"]) == (discrete(values, 0.25), discrete(values, 0.5))
    assert got["b"]["m"] is None


def test_empty_frame(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, "v", {"m": 0.5}, by=["g"]).collect() == []
    assert exact_quantiles(empty, "v", {"m": 0.5}).first()["m"] is None
    assert exact_quantiles(empty, "v", {"m": 0.5}, linear=True).first()["m"] is None


def test_approximate_rank_error(spark):
    n = 400_000
    df = spark.range(0, n, 1, 16).select(F.col("id").cast("double").alias("v"))
    got = approx_quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert abs(got - n / 2) <= n / 10_000 + 1
