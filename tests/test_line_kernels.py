"""Line kernels and selection on wide, hot and far-spread inputs, against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadframe.operators import common as C, network as N, raster as A


def brute_rows(g, ty, has):
    out = np.zeros(g.shape, int)
    for r in range(len(g)):
        cols = np.flatnonzero(has[r])
        for x in range(g.shape[1]):
            out[r, x] = min(cols, key=lambda j: (g[r, j] ** 2 + (x - j) ** 2, ty[r, j], j), default=0)
    return out


@pytest.mark.parametrize("seed, share, far", [(1, 0.9, 4), (2, 0.3, 30), (3, 0.05, 300), (4, 1.0, 1), (5, 0.5, 2)])
def test_lower_envelope_is_the_minimum_with_its_ties(seed, share, far):
    r = np.random.default_rng(seed)
    g, ty = r.integers(0, far, (40, 37)), r.integers(0, 5, (40, 37))
    has = r.random((40, 37)) < share
    has[0] = False
    assert (N.lower_envelope(g, ty, has) == brute_rows(g, ty, has)).all()


def test_lower_envelope_of_a_wide_row_with_one_target_takes_seconds():
    n = 65536
    has = np.zeros((1, n), bool)
    has[0, 17] = True
    t = time.time()
    assert (N.lower_envelope(np.full((1, n), N.FAR), np.zeros((1, n), np.int64), has) == 17).all()
    g = np.abs(np.arange(n) - 30000)[None, :] % 5000
    N.lower_envelope(g, np.zeros((1, n), np.int64), np.ones((1, n), bool))
    assert time.time() - t < 30


def test_sides_beyond_the_limit_are_an_error(spark):
    d = spark.createDataFrame([(1, N.FAR + 5, 0, False), (1, 0, 0, False)], "image_id long, y int, x int, inside boolean")
    with pytest.raises(Exception, match="image sides are limited"):
        N.distance_transform(d).collect()


def test_splitters_stay_even_beside_an_outlier(spark):
    r = np.random.default_rng(3)
    values = np.unique(np.concatenate([r.normal(size=20000), [1e12, -1e15]]))
    d = spark.createDataFrame([(1, float(v), 1, 0) for v in values], "k int, _v double, _n long, _r long")
    sizes = [x["count"] for x in C.split_ranges(d, ["k"], 64).groupBy("_k").count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 2 * len(values) / 64


@pytest.mark.parametrize("most", [3, 50, 1 << 18])
def test_quantiles_in_rounds(spark, most):
    r = np.random.default_rng(5)
    groups = {1: np.concatenate([r.normal(size=900), [1e12], np.zeros(300)]), 2: np.array([5.0]), 3: 2.0 ** r.integers(-300, 300, 200), 4: r.integers(0, 4, 100).astype(float)}
    d = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(5, None)], "k int, v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}
    got = {x.k: x for x in C.exact_quantiles(d, ["k"], "v", probs, buckets=8, most=most).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for k, vs in groups.items():
        for q, p in probs.items():
            assert np.isclose(got[k][q], np.percentile(vs, 100 * p), rtol=1e-12, atol=1e-12)
    whole = C.exact_quantiles(d, [], "v", {"c": 0.5}, buckets=8, most=most).first()
    assert np.isclose(whole["c"], np.percentile(np.concatenate(list(groups.values())), 50))
    assert C.exact_quantiles(d.filter("v is null"), ["k"], "v", probs).collect() == []


def test_autocorrelation_of_wide_and_flat_profiles(spark):
    r = np.random.default_rng(6)
    lines = {(1, "x"): r.normal(size=5000) * 40, (1, "y"): np.tile([0.0, 0.0, 100.0, 100.0, 0.0], 600), (2, "x"): np.full(30, 7.0), (2, "y"): r.normal(size=10)}
    d = spark.createDataFrame([(i, a, k, float(v)) for (i, a), p in lines.items() for k, v in enumerate(p)], "image_id long, axis string, pos int, p double")
    got = {}
    for x in A.autocorrelation(d).collect():
        got.setdefault((x.image_id, x.axis), {})[x.lag] = x.ac
    for (i, a), p in lines.items():
        c, most = p - p.mean(), min(len(q) // 3 for (j, _), q in lines.items() if j == i)
        whole = float(c @ c) or 1.0
        want = {k: float(c[:len(c) - k] @ c[k:]) / whole for k in range(min(most, len(p) - 1) + 1)}
        assert got[i, a].keys() == want.keys() and all(abs(got[i, a][k] - want[k]) < 1e-6 for k in want)
