"""Streams on keyed state: any order of arrival, many blocks, restarts."""

import os
import random

import pytest

from roadframe.streaming import log_streams as S

SCHEMA = "part string, pair_id long, step_id long, outcome string"


def half_even(u):
    h, odd = divmod(u, 2)
    return h + (odd and h % 2)


def put(spark, folder, name, rows, schema, at):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")
    for f in os.listdir(f"{folder}/{name}"):
        os.utime(f"{folder}/{name}/{f}", (at, at))


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def folded(rows, start=6000):
    want = {}
    for p, i, s, o in sorted({r[2]: r for r in rows}.values(), key=lambda r: r[2]):
        u, rej, acc = want.get(i, (start, 0, 0))
        u = max(100, half_even(u)) if o == "rejected" else min(9800, u + 500)
        want[i] = (u, rej + (o == "rejected"), acc + (o == "accepted"))
    return {i: (round(u / 1e4, 4), r, a) for i, (u, r, a) in want.items()}


@pytest.mark.parametrize("order", ["rising", "shuffled", "falling"])
def test_replay_over_many_blocks_and_a_restart(spark, tmp_path, order):
    rnd = random.Random(order)
    steps = sorted(rnd.sample(range(1 << 50), 1500)) + sorted(range(1 << 51, (1 << 51) + 300))
    rows = [("open", 1 if rnd.random() < 0.8 else 2, s, "rejected" if rnd.random() < 0.3 else "accepted") for s in steps]
    if order == "shuffled":
        rnd.shuffle(rows)
    elif order == "falling":
        rows.reverse()
    library = spark.createDataFrame([("open", 1, 0.6), ("open", 2, 0.6), ("open", 3, 0.6)], "part string, pair_id long, confidence0 double")
    cuts = [rows[:700], rows[700:1000] + rows[:5], rows[1000:], rows[300:310]]
    read = lambda: {r.pair_id: (r.confidence, r.rejections, r.acceptances) for r in S.latest(spark, f"{tmp_path}/out", ["part", "pair_id"]).collect()}
    for k, part in enumerate(cuts[:2]):
        put(spark, f"{tmp_path}/in", k, part, SCHEMA, 1000 + k)
    S.run_available(S.stream_replay_index(source(spark, f"{tmp_path}/in", SCHEMA), library), "update", f"{tmp_path}/out")
    assert read() == folded(cuts[0] + cuts[1])
    for k, part in enumerate(cuts[2:], 2):
        put(spark, f"{tmp_path}/in", k, part, SCHEMA, 1000 + k)
    S.run_available(S.stream_replay_index(source(spark, f"{tmp_path}/in", SCHEMA), library), "update", f"{tmp_path}/out")
    assert read() == folded(rows)


def test_appends_and_new_pairs_survive_a_restart_without_the_sink(spark, tmp_path):
    """What was seen before is known from the state alone: the first results are moved out of sight."""
    trained = spark.createDataFrame([(1, 1, 0.25)], "mask_id long, photo_id long, scale double")
    log, asks = "step_id long, v int", "mask_id long, photo_id long, scale double"
    put(spark, f"{tmp_path}/log", 0, [(1, 0), (2, 0), (2, 0)], log, 1000)
    put(spark, f"{tmp_path}/ask", 0, [(1, 1, 0.25), (1, 1, 0.5), (1, 1, -0.5), (1, 2, 0.25), (1, 1, None)], asks, 1000)
    S.append_once(source(spark, f"{tmp_path}/log", log), f"{tmp_path}/a", "step_id")
    S.append_new_pairs(source(spark, f"{tmp_path}/ask", asks), trained, f"{tmp_path}/b")
    found = [sorted(tuple(r)[:k] for r in spark.read.parquet(f"{tmp_path}/{f}").collect()) for f, k in (("a", 1), ("b", 3))]
    assert found == [[(1,), (2,)], [(1, 1, -0.5), (1, 1, 0.5), (1, 2, 0.25)]]
    for f in ("a", "b"):
        os.rename(f"{tmp_path}/{f}", f"{tmp_path}/{f}-seen")
    put(spark, f"{tmp_path}/log", 1, [(2, 1), (3, 1)], log, 1001)
    put(spark, f"{tmp_path}/ask", 1, [(1, 1, 0.5 + 5e-7), (1, 1, -0.5 - 5e-7), (1, 1, 0.75), (1, 2, 0.25 + 2e-6)], asks, 1001)
    S.append_once(source(spark, f"{tmp_path}/log", log), f"{tmp_path}/a", "step_id")
    S.append_new_pairs(source(spark, f"{tmp_path}/ask", asks), trained, f"{tmp_path}/b")
    found = [sorted(tuple(r)[:k] for r in spark.read.parquet(f"{tmp_path}/{f}").collect()) for f, k in (("a", 1), ("b", 3))]
    assert found == [[(3,)], [(1, 1, 0.75), (1, 2, 0.25 + 2e-6)]]


def test_new_pairs_in_one_crowded_zone(spark, tmp_path):
    rnd = random.Random(4)
    scales = [round(rnd.random() * 4e-4, 8) for _ in range(1500)]
    asks = "mask_id long, photo_id long, scale double"
    for k in range(3):
        put(spark, f"{tmp_path}/in", k, [(1, 1, s) for s in scales[500 * k:500 * k + 500]], asks, 1000 + k)
    S.append_new_pairs(source(spark, f"{tmp_path}/in", asks), spark.createDataFrame([], asks), f"{tmp_path}/out")
    want = []
    for k in range(3):
        for s in sorted(set(scales[500 * k:500 * k + 500])):
            if all(abs(s - w) >= 1e-6 for w in want):
                want.append(s)
    assert sorted(r["scale"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want)
