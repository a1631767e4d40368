"""Components of near discs against all pairs, on crowds, mixed sizes, ties and edge inputs."""

import time

import numpy as np
import pandas as pd
import pytest

from roadframe.operators import discs as D, network as N

SCHEMA = "image_id long, pid long, x double, y double, r double"


def brute(rows, scale, gap):
    out = {}
    for img in {r[0] for r in rows}:
        d = [r for r in rows if r[0] == img]
        x, y, r = (np.array([q[i] for q in d], float) for i in (2, 3, 4))
        near = np.hypot(x[:, None] - x, y[:, None] - y) < (r[:, None] + r) * scale + gap
        reach = r * scale + gap / 2
        near &= ~((reach[:, None] < D.POINT) & (reach < D.POINT))
        label = np.array([q[1] for q in d])
        while True:
            low = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
            if (low == label).all():
                break
            label = low
        out.update({(img, q[1]): int(v) for q, v in zip(d, label)})
    return out


def got(spark, rows, scale, gap):
    df = D.disc_components(spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "pid", "x", "y", "r"]), SCHEMA), scale, gap)
    return {(r.image_id, r.pid): r.label for r in df.collect()}


def made(seed, n, span, widest, images=2, zeros=0.0):
    r = np.random.default_rng(seed)
    pid = r.permutation(n) * 7 - 50
    rad = widest ** r.random(n) * (r.random(n) >= zeros)
    return [(int(i % images), int(pid[i]), float(np.round(r.random() * span - span / 3, 2)), float(np.round(r.random() * span, 2)), float(rad[i]))
            for i in range(n)]


@pytest.mark.parametrize("seed, n, span, widest, zeros, scale, gap", [
    (1, 600, 400, 8, 0.0, 1.6, 0.0), (2, 500, 900, 100, 0.1, 1.0, 0.0), (3, 600, 300, 2, 0.5, 1.0, 3.5), (4, 300, 3, 0.01, 0.2, 1.0, 0.0)])
def test_components_are_those_of_all_pairs(spark, seed, n, span, widest, zeros, scale, gap):
    rows = made(seed, n, span, widest, zeros=zeros)
    want = brute(rows, scale, gap)
    assert 2 < len({(k[0], v) for k, v in want.items()}) < len(rows)
    assert got(spark, rows, scale, gap) == want


def test_crowded_cells_that_nearly_touch_are_cut_and_compared(spark):
    """Two crowds on facing arcs, with and without a disc between them, near and beyond the limit."""
    t = np.linspace(-0.6, 0.6, 400)
    left = [(0, i, float(np.sin(a) * 3), float(-np.cos(a)), 1.0) for i, a in enumerate(t)]
    right = [(0, 1000 + i, float(np.sin(a) * 3), float(1.2 + np.cos(a) * 0.3), 1.0) for i, a in enumerate(t)]
    for lone in ([], [(0, 5000, 0.0, 0.4, 0.001)]):
        for gap in (0.0, 0.3):
            rows = left + right + lone
            assert got(spark, rows, 0.5, gap) == brute(rows, 0.5, gap)


def test_the_limit_itself_is_no_link(spark):
    rows = [(0, 1, 0.0, 0.0, 2.0), (0, 2, 5.0, 0.0, 3.0), (0, 3, 9.99, 0.0, 2.0), (1, 1, 0.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.0),
            (1, 3, 0.5, 0.0, 1.0), (2, 4, 0.0, 0.0, 0.0), (2, 5, 0.0, 0.0, 0.0)]
    assert got(spark, rows, 1.0, 0.0) == {(0, 1): 1, (0, 2): 2, (0, 3): 2, (1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 4): 4, (2, 5): 5}


def test_a_crowd_in_one_spot_stays_linear(spark):
    """100,000 candidates in a few pixels: all pairs would be 5e9 rows; nodes and links stay few."""
    r = np.random.default_rng(7)
    n = 100_000
    at = np.append(r.normal(500, 4, (n, 2)), [[5000.0, 5000.0]], axis=0)
    df = pd.DataFrame({"image_id": 0, "pid": np.arange(n + 1), "x": at[:, 0], "y": at[:, 1], "r": r.uniform(2, 9, n + 1)})
    t = time.time()
    members, links = D.disc_nodes(spark.createDataFrame(df, SCHEMA), 1.6)
    nodes = members.select("head").distinct().count()
    assert nodes < 1000 and links.count() <= nodes * 144 * 3 / 2      # three sizes of discs, 144 cells around a node
    assert time.time() - t < 60
    labels = {r["label"]: r["count"] for r in D.disc_components(spark.createDataFrame(df, SCHEMA), 1.6).groupBy("label").count().collect()}
    assert labels == {0: n, n: 1}


def test_no_rows_and_rows_without_a_place(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.disc_components(empty, 1.0).count() == 0 and D.disc_forest(empty).count() == 0
    rows = [(0, 1, None, 0.0, 2.0), (0, 2, 0.0, float("nan"), 2.0), (0, 3, 0.0, 0.0, 1.0), (0, 4, 0.0, 0.0, None)]
    assert [tuple(r) for r in D.disc_components(spark.createDataFrame(rows, SCHEMA)).collect()] == [(0, 3, 3)]
    cands = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0), (0, 2, None, 0.0, 1.0)], "image_id long, cand_id long, x double, y double, hw double")
    assert {r.cand_id: r.root for r in N.merge_candidates(cands).collect()}[1] == 1
