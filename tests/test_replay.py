"""Replays with sparse ids and hot keys, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from roadframe.operators import common as C, memory as M, routing as R


def half_even(u):
    h, odd = divmod(u, 2)
    return h + (odd and h % 2)


def sparse_steps(n, seed):
    rnd = random.Random(seed)
    return sorted(rnd.sample(range(-(1 << 40), 1 << 62), n // 2) + rnd.sample(range(1000), n - n // 2))


def test_position_chunks_are_even_for_any_ids(spark):
    ids = sparse_steps(1000, 1)
    d = spark.createDataFrame([(i,) for i in random.Random(2).sample(ids, len(ids))], "id long").repartition(5)
    out, chunks = C.position_chunks(d, ["id"], 16)
    got = sorted((r["_chunk"], r["id"]) for r in out.collect())
    assert [i for _, i in got] == ids
    sizes = {}
    for c, _ in got:
        sizes[c] = sizes.get(c, 0) + 1
    assert sorted(sizes) == list(range(chunks)) and max(sizes.values()) == 16 and chunks <= 1000 / 16 + 5
    assert C.position_chunks(d.limit(0), ["id"])[1] == 0


@pytest.mark.parametrize("chunk, fan, raw", [(40, 2, 60), (1000, 16, 256), (90, 4, 80)])
def test_one_pair_with_most_of_a_sparse_log(spark, chunk, fan, raw):
    rnd = random.Random(5)
    steps = sparse_steps(2000, 3)
    rows = [("open", 1 if rnd.random() < 0.8 else rnd.randint(2, 60), s, rnd.random() < 0.35) for s in steps]
    ev = spark.createDataFrame(rnd.sample(rows, len(rows)), "part string, pair_id long, step_id long, reject boolean").repartition(6)
    first = {i: 100 * rnd.randint(1, 98) for i in range(1, 70)}
    start = spark.createDataFrame([("open", i, u / 1e4) for i, u in first.items()], "part string, pair_id long, confidence double")
    want = dict(first)
    for _, p, _, rej in rows:
        want[p] = max(100, half_even(want[p])) if rej else min(9800, want[p] + 500)
    got = {r.pair_id: r.confidence for r in M.confidence_replay(ev, start, chunk=chunk, fan=fan, raw=raw).collect()}
    assert got == {p: round(u / 1e4, 4) for p, u in want.items()}


def test_no_row_holds_more_than_fan_functions(spark):
    """After the first level every row has one list of at most `raw` reviews or one step function."""
    rows = [("open", 1, 10 ** 12 * s, s % 3 == 0) for s in range(900)]
    placed, chunks = C.position_chunks(spark.createDataFrame(rows, "part string, pair_id long, step_id long, reject boolean"), ["part", "pair_id", "step_id"], 50)
    merge = M._merge_pieces(20)
    seen = []

    def watched(ps):
        seen.append(1)
        return merge(ps)

    ev = placed.groupBy("part", "pair_id", "_chunk").agg(F.sort_array(F.collect_list(F.struct("step_id", "reject")))["reject"].alias("ev"))
    one = F.array(F.struct(F.col("ev").alias("events"), F.array().cast("array<struct<lo:int,out:int>>").alias("steps")))
    pieces = ev.select("part", "pair_id", "_chunk", merge(one).alias("piece"))
    assert pieces.agg(F.max(F.size("piece.events"))).first()[0] <= 20
    out = C.merge_rounds(pieces, ["part", "pair_id"], chunks, 4, watched).collect()
    assert len(out) == 1 and len(seen) == 3 and len(out[0]["piece"]["steps"]) >= 1 and chunks >= 18


def test_clamped_moves_with_sparse_ids(spark):
    rnd = random.Random(7)
    rows = [(1 if rnd.random() < 0.8 else rnd.randint(2, 5), s, "wear", rnd.choice([-15, 15, 40])) for s in sparse_steps(600, 9)]
    d = spark.createDataFrame(rnd.sample(rows, len(rows)), "session int, step_id long, setting string, delta int")
    want = {}
    for k, _, _, v in rows:
        want[k] = max(0, min(100, want.get(k, 50) + v))
    assert {r.session: r.wear for r in R.apply_adjustments(d, chunk=9).collect()} == want


def test_tree_versions_and_as_of_with_sparse_ids(spark):
    steps = sparse_steps(300, 11)
    saves = [("t" if k % 5 else "u", s, "x", str(k)) for k, s in enumerate(steps)]
    v = M.save_tree(spark.createDataFrame(saves, "name string, step_id long, source string, data string"))
    asks = [("t", s + 1) for s in steps[::7]]
    got = {r.step_id: r.version for r in M.tree_as_of(v, spark.createDataFrame(asks, "name string, step_id long")).collect()}
    mine = [s for n, s, *_ in saves if n == "t"]
    assert got == {s: (sum(m <= s for m in mine) or None) for _, s in asks}
    assert sorted((r.step_id, r.version) for r in v.filter("name = 't'").collect()) == [(s, k + 1) for k, s in enumerate(mine)]
