"""Merged libraries: patches at one size, statistics weighed by pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadframe.operators import synth as S, training as T


def test_sides_that_vary_by_row(spark):
    rng, rows, want = np.random.default_rng(1), [], {}
    for k, (n, m) in enumerate([(8, 5), (5, 8), (4, 4), (3, 7), (7, 3), (1, 4), (6, 1), (16, 15)]):
        a = rng.random((n, n))
        rows += [(k, y, x, n, m, float(a[y, x])) for y in range(n) for x in range(n)]
        w = np.zeros((m, n))
        for o, i, v in S.resize_weights(n, m):
            w[o, i] = v
        want |= {(k, y, x): v for (y, x), v in np.ndenumerate(w @ a @ w.T)}
    d = spark.createDataFrame(rows, "id int, y int, x int, n int, m int, v double")
    got = {(r["id"], r["y"], r["x"]): r["v"] for r in S.resize_to(d, ["id"], "n", "m", ["v"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


LIBS = "part string, pair_id long, pixels long, patches long, size_px int, mean double, grain double, local_contrast double"


def test_statistics_weigh_pairs_by_pixels(spark):
    libs = [("a", 1, 100, 2, 4, 10.0, 1.0, 2.0), ("a", 2, 300, 5, 9, 30.0, 3.0, None), ("a", 3, 900, 0, 30, 99.0, 9.0, 9.0), ("b", 1, 7, 1, 6, None, 0.5, 0.25)]
    got = {r["part"]: r.asDict() for r in T.merged_statistics(spark.createDataFrame(libs, LIBS)).collect()}
    assert got["a"] == dict(part="a", size_px=6, count=7, pairs=2, pixels=400, tone=25.0, grain=2.5, contrast=0.5, sizes_seen=[4, 9])
    assert got["b"] == dict(part="b", size_px=6, count=1, pairs=1, pixels=7, tone=0.0, grain=0.5, contrast=0.25, sizes_seen=[6])
    assert T.merged_statistics(spark.createDataFrame([], LIBS)).collect() == []


def test_merged_pixels(spark):
    px = [("a", p, k, y, x, float(p)) for p, n in ((1, 4), (2, 9)) for k in range(3) for y in range(n) for x in range(n)]
    px = spark.createDataFrame(px, "part string, pair_id long, patch int, y int, x int, v double")
    libs = T.library_measures(px, "v")
    got = T.merged_patches(libs, px, ["v"])
    assert got.columns == ["part", "pair_id", "patch", "size_px", "y", "x", "v"]
    assert {(r["pair_id"], r["patch"], r["n"], r["low"], r["high"]) for r in got.groupBy("pair_id", "patch").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("v"), 9).alias("low"), F.round(F.max("v"), 9).alias("high")).collect()} == {(p, k, 36, p, p) for p in (1, 2) for k in range(3)}
    few = T.merged_patches(libs, px, ["v"], cap=4)
    assert few.select("pair_id", "patch").distinct().count() == 4
    assert T.merged_patches(libs.limit(0), px, ["v"]).count() == 0
