"""Whitening against exact fractions and the definition of each column."""

import math
from fractions import Fraction

import numpy as np
import pytest

from roadframe.llm import whitening as Z
from roadframe.llm.queries import QUERIES


def verify(got, kept, most=32):
    """Every column of the result by its definition, from the kept (id, vector) rows."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in kept]
    n, width = len(x), len(x[0])
    total = [sum(r[k] for r in x) for k in range(width)]
    v = np.array([[float(Fraction(sum((n * r[i] - total[i]) * (n * r[j] - total[j]) for r in x), n ** 3)) for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(most, int((values > values.sum() * 1e-12).sum()))
    assert len(got) == n * count
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, total)] for r in x])
    expected = centred @ vectors[:, :count] / np.sqrt(values[:count])
    w = {}
    for r in got:
        w.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k in range(count):
        mine = np.array([w[i, k + 1][0]["whitened"] for i, _ in kept])
        sign = 1 if mine @ expected[:, k] > 0 else -1
        assert np.allclose(sign * mine, expected[:, k], atol=1e-6)
        assert all(abs(r["explained"] - values[k] / np.trace(v)) < 1e-9 for i, _ in kept for r in w[i, k + 1])
    for (i, _), r in zip(kept, x):
        assert {q["deviation"] for q in w[i, 1]} >= {sum((n * c - t) ** 2 for c, t in zip(r, total))}
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    return w


def test_query_by_definition(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    verify(QUERIES["op13_whitening"](spark, sf).collect(), [(r["vec_id"], r["embedding"]) for r in rows])


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, n int, component string")


def test_unusable_rows_are_dropped_and_repeats_kept(spark):
    r = np.random.default_rng(1)
    good = [(k, [float(np.float32(c)) for c in r.normal(size=5)]) for k in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (104, [float("inf")] * 5), (105, [None] * 5)]
    got = Z.whiten(table(spark, good + bad + good[:3]).repartition(4)).collect()
    assert len(got) == 33 * 5 and {q["n"] for q in got} == {33}
    verify(Z.whiten(table(spark, good + bad)).collect(), good)
    one = Z.whiten(table(spark, [*good, (None, good[0][1])])).collect()
    assert sum(q["vec_id"] is None for q in one) == 5


def test_flat_directions_are_no_components(spark):
    r = np.random.default_rng(2)
    rows = [(k, [float(a), float(2 * a), 7.0, float(b)]) for k, (a, b) in enumerate(r.integers(-50, 50, (40, 2)))]
    got = Z.whiten(table(spark, rows, "double")).collect()
    assert {q["component"] for q in got} == {1, 2} and got[0]["identity_error"] < 1e-9
    for few in ([], rows[:1], [(k, [1.0, 2.0]) for k in range(5)]):
        assert Z.whiten(table(spark, few, "double")).collect() == []


def test_wide_numbers_stay_exact(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(r.integers(-(1 << 28), 1 << 28, (6, 2)) / 64)]
    verify(Z.whiten(table(spark, rows, "double")).collect(), rows)
    rows = [(0, [0.0, 1.0]), (1, [float(1 << 40), 0.0])]
    with pytest.raises(Exception, match="does not fit"):
        Z.whiten(table(spark, rows, "double")).collect()
    assert {int(q["deviation"]) for q in Z.whiten(table(spark, rows, "double"), wide=True).collect()} == {64 ** 2 * ((1 << 80) + 1)}
    with pytest.raises(ValueError, match="too large"):
        Z.whiten(table(spark, [(0, [1e300]), (1, [0.0])], "double"))
    with pytest.raises(ValueError, match="different lengths"):
        Z.whiten(table(spark, [(0, [1.0]), (1, [0.0, 1.0])], "double"))


@pytest.mark.parametrize("bits", [1, 9, 19, 21, 40])
def test_bit_planes_give_exact_products(bits):
    r = np.random.default_rng(bits)
    x = r.integers(0, 1 << bits, (131, 4))
    expected = x.astype(object).T @ x.astype(object)
    assert Z.scatter(x, bits) == [[int(expected[i, j]) for j in range(i, 4)] for i in range(4)]


def test_blocks_add_up(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(r.normal(size=(500, 3)) * 100)]
    v = Z.usable(table(spark, rows, "double").repartition(5), "vec_id", "embedding")
    x = np.array([[math.floor(64 * c) + 1000000 for c in q] for _, q in rows])
    low = x.min(axis=0)
    got = Z.cross_products(v, low.tolist(), int((x.max(axis=0) - low).max()).bit_length(), block=64)
    y = (x - low).astype(object)
    assert got == {(i, j): int((y.T @ y)[i, j]) for i in range(3) for j in range(i, 3)}
